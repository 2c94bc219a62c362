"""Vectors as four one-byte codes: integer codebooks, whose nearest entry is looked up by grid cell."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import checkpointed

#: A component becomes floor(SCALE * x), held within +-LARGEST so that the squared distance of two vectors is a 64-bit number.
SCALE, LARGEST = 1024, 1 << 27
#: Side of a grid cell; size of what a task remembers of the cells of a part (an entry counts 1, a cell 64 besides);
#: (vector, entry) pairs that are evaluated at a time.
CELL, HELD, PAIRS = 32, 1 << 22, 1 << 18
#: A label with more than one row in this many is joined through a broadcast: there are at most so many of them.
HOT = 1_000


class Cells:
    """The nearest entry of one codebook, asked cell by cell.

    The grid cuts space into cubes of side ``side``. An entry whose least distance to a cube is above the greatest distance of
    another entry is nearest to no point of it; the others are kept per cube, and only these are evaluated for the vectors
    in it. Both distances are sums over the dimensions of numbers that depend on the place on that axis alone.
    """

    def __init__(self, entries: np.ndarray, side: int = CELL):
        self.entries, self.side = entries, side
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell (a row of places on the grid's axes) the entries, ascending, that may be nearest to a point of it."""
        out = []
        for lo in range(0, len(cells), 4096):
            part = cells[lo : lo + 4096]
            least = np.zeros((len(part), len(self.entries)), np.int64)
            most = np.zeros_like(least)
            for axis in range(part.shape[1]):
                places, at = np.unique(part[:, axis], return_inverse=True)
                below = places[:, None] * self.side - self.entries[None, :, axis]  # from the entry to the low face
                above = -(below + self.side - 1)  # from the high face, the last whole number of the cell, to the entry
                least += (np.maximum(0, np.maximum(below, above)) ** 2)[at]
                most += (np.maximum(np.abs(below), np.abs(above)) ** 2)[at]
            row, entry = np.nonzero(least <= most.min(1, keepdims=True))
            out += np.split(entry.astype(np.int16), np.searchsorted(row, np.arange(1, len(part))))
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lower index on ties, and its squared distance."""
        grid = np.ascontiguousarray(x // self.side)
        _, first, cell = np.unique(grid.view(f"V{grid.itemsize * grid.shape[1]}").ravel(), return_index=True, return_inverse=True)
        names = [grid[k].tobytes() for k in first]
        kept = {name: self.known[name] for name in names if name in self.known}
        fresh = [k for k, name in enumerate(names) if name not in kept]
        found = dict(zip((names[k] for k in fresh), self.candidates(grid[first[fresh]])))
        kept.update(found)
        self.held += sum(64 + len(c) for c in found.values())
        if self.held > HELD:
            self.known, self.held = {}, 0
        else:
            self.known.update((name, c.copy()) for name, c in found.items())  # a view would hold its whole block
        lists = [kept[name] for name in names]
        sizes = np.array([len(c) for c in lists])
        flat, begin = np.concatenate(lists), sizes.cumsum() - sizes
        code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        each = sizes[cell]
        total, lo = each.cumsum(), 0
        while lo < len(x):  # slices of about PAIRS pairs
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
            n = each[lo:hi]
            start = n.cumsum() - n
            entry = flat[np.repeat(begin[cell[lo:hi]] - start, n) + np.arange(n.sum())]
            apart = np.repeat(x[lo:hi], n, axis=0) - self.entries[entry]
            distance = np.einsum("ij,ij->i", apart, apart)
            low = np.minimum.reduceat(distance, start)
            at = np.flatnonzero(distance == np.repeat(low, n))
            code[lo:hi], error[lo:hi] = entry[at[np.searchsorted(at, start)]], low
            lo = hi
        return code, error


def whole_parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """The vectors as whole numbers, shape (rows, parts, width); those that are too short are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), parts * width), np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(sizes.cumsum() - sizes, sizes)] = np.clip(flat, -LARGEST, LARGEST)
    return out.reshape(-1, parts, width)


def _nearest(books: list[np.ndarray], column: str, side: int):
    """For a task: (batch, x, codes, errors) of each of its batches, the cells remembered from batch to batch."""
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cells = [Cells(book, side) for book in books]
        for batch in batches:
            if batch.num_rows:
                x = whole_parts(batch.column(column), width, parts)
                found = [c.nearest(x[:, p]) for p, c in enumerate(cells)]
                yield batch, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    return run


def _refined(rows: DataFrame, books: list[np.ndarray], side: int) -> list[np.ndarray]:
    """The codebooks after a round: the floor of the mean of the parts nearest to each entry; unused entries stay.

    A task adds up its own rows and hands on a number per component, so what is shuffled and collected has the size of the codebooks.
    """
    parts, (entries, width) = len(books), books[0].shape
    nearest = _nearest(books, "vector", side)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, x, code, _ in nearest(batches):
            for p in range(parts):
                total[p, :, width] += np.bincount(code[:, p], minlength=entries)
                for axis in range(width):  # sums of whole numbers, exact as doubles: a batch has far fewer than 2**26 rows
                    total[p, :, axis] += np.bincount(code[:, p], x[:, p, axis], entries).astype(np.int64)
        slots = np.flatnonzero((total[:, :, width] > 0).ravel()[:, None].repeat(width + 1, 1))
        yield pa.record_batch([pa.array(slots), pa.array(total.ravel()[slots])], ["slot", "total"])

    found = rows.mapInArrow(sums, "slot long, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {r["slot"]: int(r["total"]) for r in found.collect()}
    out = [book.copy() for book in books]
    for p in range(parts):
        for e in range(entries):
            slot = (p * entries + e) * (width + 1)
            if count := totals.get(slot + width, 0):
                out[p][e] = [totals[slot + axis] // count for axis in range(width)]
    return out


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, side: int = CELL, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """One row (vec_id, code, error, label_error, codebooks_sha256) per vector that has only finite components.

    Components become whole numbers, vectors are cut into ``parts`` equal consecutive parts, and each part position has a codebook that
    starts as the parts of the ``entries`` smallest ids and follows ``rounds`` rounds of means, rounded down. ``code`` has two hex
    digits per part, ``error`` the squared distance to the entries named, ``label_error`` its sum over equal labels. The codebooks (bounded
    by their size) are all that passes the driver. Assignments are exact: ``Cells`` only leaves out entries that cannot be nearest.
    Cases: null vectors and those with a null, NaN or infinite component give no row; of equal ids the smaller vector comes first,
    null ids come last; fewer than ``entries`` vectors make smaller codebooks; vectors whose length differs or is no multiple of
    ``parts`` count as filled up with zeros; whole components beyond +-2**27 count as that number, since squared distances would not fit 64
    bits; null labels are one group; repeated rows are a row each; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("group"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    width = max(1, -(-(longest or 0) // parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column("vector").combine_chunks()
    start = whole_parts(first, width, parts)
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    for _ in range(rounds if len(start) else 0):
        books = _refined(rows, books, side)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()
    nearest = _nearest(books, "vector", side) if len(start) else lambda batches: ()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, code, error in nearest(batches):
            text = code.astype(np.uint8).tobytes().hex()
            digits = 2 * parts
            codes = pa.array([text[k : k + digits] for k in range(0, len(text), digits)], pa.string())
            yield pa.record_batch([batch.column("id"), batch.column("group"), codes, pa.array(error.sum(1))], ["id", "group", "code", "error"])

    kinds = rows.select("id", "group").schema.simpleString()[7:-1] + ",code:string,error:bigint"
    out = checkpointed(rows.mapInArrow(coded, kinds))
    totals = out.groupBy("group").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("group", "of")
    totals = checkpointed(totals)
    many = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(totals.where(F.col("n") * HOT > many))
    same = F.col("group").eqNullSafe(F.col("of"))
    columns = [F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")]
    common = out.join(hot, same).select(*columns)
    rest = out.join(hot, same, "left_anti").join(totals.where(F.col("n") * HOT <= many), same).select(*columns)
    return common.unionByName(rest)
