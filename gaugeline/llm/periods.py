"""Periodic runs of words: block convolution at dyadic scales finds where blocks come again, extension makes runs of it."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import pieces_of

#: A prime below 2**32 with a root of unity of order 2**30: products of residues fit 64 bits, and any text of 2 GB a transform.
PRIME, GENERATOR = 3 * (1 << 30) + 1, 5
#: Text bytes searched at a time, numbers of a batch of transforms, words compared at a time by an extension.
BLOCK, NUMBERS, STRIP = 1 << 20, 1 << 19, 64
#: Words of a run at least.
LEAST = 12
_U = np.uint64


@functools.lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``, or of its inverse."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(1, _U)
    while 2 * len(out) < size:  # w^(n + i) = w^n * w^i
        out = np.concatenate([out, out * _U(pow(root, len(out), PRIME)) % _U(PRIME)])
    return out


def ntt(x: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two of residues modulo ``PRIME``), in the order that ``inverse_ntt`` takes.

    Every round splits each sequence into two of half its length, whose transforms are its even and its odd frequencies."""
    rows, size = x.shape
    x, p = x.reshape(rows, 1, size), _U(PRIME)
    while (half := x.shape[2] // 2) > 0:
        a, b = x[:, :, :half], x[:, :, half:]
        x = np.concatenate([(a + b) % p, (a + (p - b)) % p * _roots(2 * half, False) % p], 1)
    return x[:, :, 0]


def inverse_ntt(x: np.ndarray) -> np.ndarray:
    """Undoes the rounds of ``ntt``, the last one first."""
    rows, size = x.shape
    x, p = x.reshape(rows, size, 1), _U(PRIME)
    while (n := x.shape[1] // 2) > 0:
        even, odd = x[:, :n], x[:, n:] * _roots(2 * x.shape[2], True) % p
        x = np.concatenate([(even + odd) % p, (even + (p - odd)) % p], 2)
    return x[:, 0] * _U(pow(size, -1, PRIME)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each row and each shift the sum over the block of (block[t] - window[t + shift])**2 modulo ``PRIME``, exactly.

    The sum is the squares of the block, those of the window beneath it, less twice their correlation, which is a product of
    transforms."""
    p = _U(PRIME)
    rows, b = blocks.shape
    reach = windows.shape[1]
    size = 1 << (reach - 1).bit_length()
    wide = np.zeros((rows, size), _U)
    wide[:, :reach] = windows
    back = np.zeros((rows, size), _U)
    back[:, (-np.arange(b)) % size] = blocks  # reversed in time: the product is the correlation
    both = ntt(wide) * ntt(back) % p
    shifts = reach - b + 1
    cross = inverse_ntt(both)[:, :shifts]
    total = np.concatenate([np.zeros((rows, 1), _U), (windows * windows % p).cumsum(1, dtype=_U)], 1)
    squares = total[:, b:] - total[:, :shifts]
    return ((blocks * blocks % p).sum(1, dtype=_U)[:, None] + squares + _U(2) * (p - cross)) % p


def _same(ids: np.ndarray, at: np.ndarray, shift: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``at`` on (``step`` 1) or back (-1) equal the one ``shift`` further on, ``most`` at most."""
    out, open_, n = np.zeros(len(at), np.int64), np.arange(len(at)), len(ids)
    for lo in range(0, most, STRIP):
        strip = np.arange(lo, min(lo + STRIP, most))
        parts = []
        for part in np.array_split(open_, max(1, len(open_) * len(strip) // NUMBERS)):
            i = at[part, None] + step * strip
            j = i + shift[part, None]
            inside = (i >= 0) & (j < n)
            equal = inside & (ids[np.clip(i, 0, n - 1)] == ids[np.minimum(j, n - 1)])
            good = np.where(equal.all(1), len(strip), equal.argmin(1))
            out[part] += good
            parts.append(part[good == len(strip)])
        open_ = np.concatenate(parts)
        if not len(open_):
            break
    return out


def _occurrences(ids: np.ndarray, starts: np.ndarray, block: int, first: int, shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all blocks whose squared differences vanish ``first`` to ``first + shifts - 1`` words further on."""
    n, found = len(ids), []
    reach = shifts + block - 1
    size = 1 << (reach - 1).bit_length()
    padded = ids.astype(_U)
    for lo in range(0, len(starts), max(1, NUMBERS // size)):
        part = starts[lo : lo + max(1, NUMBERS // size)]
        at = part[:, None] + first + np.arange(reach)
        window = np.where(at < n, padded[np.minimum(at, n - 1)], _U(n))  # no word has that number
        row, shift = np.nonzero(squared_differences(padded[part[:, None] + np.arange(block)], window) == 0)
        found.append((part[row], shift + first))
    at, distance = (np.concatenate(c) for c in zip(*found))
    return at, distance


def runs(ids: np.ndarray, gaps: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs (start, end, smallest period) of at least ``LEAST`` words and two periods, by start, then period.

    ``ids`` are the words as numbers below their count, ``gaps`` the distance of each to its next occurrence (very large if there is none);
    no period above half of ``longest`` is looked for.

    Scale L looks for periods from L to 2L - 1 (the first for 1 to 7). A run repeats at least max(12 - q, q) words at distance q in
    a row, so one of the blocks of b = L/2 (3) words from the places 0, b, 2b, ... comes again at distance q, and a convolution with the words
    that follow finds it. Blocks with a word that does not come again within 2L words can not, and are left out; so are blocks
    with all their window in a run of period up to b found before, whose repetitions are known.
    Blocks in a row with the same distance are one seed, so that its ends are less than a block away. A stretch of period d that is
    a run has the run's smallest period as a divisor of d and the same ends: of equal stretches the least distance stays.
    """
    n, first, block = len(ids), 1, 3
    found = [np.zeros((0, 3), np.int64)]
    while first <= longest // 2:
        last = 7 if first == 1 else 2 * first - 1
        starts = np.arange(n // block) * block
        if block * len(starts):
            widest = gaps[: block * len(starts)].reshape(-1, block).max(1)
            starts = starts[widest <= last]
        if len(starts):
            known = np.concatenate(found)
            known = known[known[:, 2] <= block]
            known = known[known[:, 0].argsort(kind="stable")]
            ends = np.concatenate([[-1], np.maximum.accumulate(known[:, 1])]) if len(known) else np.array([-1])
            reach = ends[np.searchsorted(known[:, 0], starts, side="right")]  # how far the runs that began by then go
            starts = starts[reach < starts + last + block]
            at, distance = _occurrences(ids, starts, block, first, last - first + 1)
            reach = ends[np.searchsorted(known[:, 0], at, side="right")]
            new = reach < at + distance + block
            at, distance = at[new], distance[new]
            # A sum of zero modulo the prime may be a multiple of it: the words decide.
            good = _same(ids, at, distance, 1, block) == block
            at, distance = at[good], distance[good]
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + block)
            begin = np.flatnonzero(fresh)
            if len(begin):
                stop = at[np.append(begin[1:], len(at)) - 1] + block
                lo, d = at[begin], distance[begin]
                likely = stop - lo + 2 * block - 2 >= np.maximum(LEAST - d, d)
                lo, stop, d = lo[likely], stop[likely], d[likely]
                lo = lo - _same(ids, lo - 1, d, -1, block - 1)
                hi = stop + _same(ids, stop, d, 1, block - 1) + d
                long = hi - lo >= np.maximum(LEAST, 2 * d)
                found.append(np.column_stack([lo, hi, d])[long])
        block = 4 if first == 1 else 2 * block
        first = 8 if first == 1 else 2 * first
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    fresh = np.ones(len(all_), bool)
    fresh[1:] = (all_[1:, :2] != all_[:-1, :2]).any(1)
    all_ = all_[fresh]
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 0]))]
    return all_[:, 0], all_[:, 1], all_[:, 2]


def planted(n: int, doc: str) -> np.ndarray:
    """The places of the words of a text: some texts, chosen by the CRC32 of their id, end in a repetition of one passage."""
    h = zlib.crc32(doc.encode())
    at = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of all texts in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # an empty text splits into one empty word
    owner = np.repeat(np.arange(len(counts)), counts)
    return flat.filter(pa.array(~blank)), np.bincount(owner[~blank], minlength=len(counts))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the
    words that stay when each run is cut down to its first period.

    The words of many documents are searched as one sequence, in which equal words of different documents have different
    numbers, so that no run crosses a boundary. ``plant`` first repeats passages in some texts (``planted``).
    Cases: null and empty texts have no words and no run; of equally long runs the first counts, then the one of smaller period; a
    null id is the text ""; rows that repeat an id or a text are searched each; a text of any length is searched whole, in memory
    proportional to it; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BLOCK):
            flat, counts = words(batch.column("text"))
            ends = counts.cumsum()
            starts = ends - counts
            if plant:
                source = [planted(n, name) + lo for n, name, lo in zip(counts.tolist(), batch.column("name").to_pylist(), starts.tolist())]
                source = np.concatenate(source) if source else np.zeros(0, np.int64)
            else:
                source = np.arange(len(flat))
            owner = np.repeat(np.arange(len(counts)), counts)
            coded = flat.dictionary_encode()
            spelling = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[source]
            told = owner * max(1, len(coded.dictionary)) + spelling
            order = told.argsort(kind="stable")
            equal = told[order[1:]] == told[order[:-1]]
            ids, gaps = np.empty(len(told), np.int64), np.full(len(told), 1 << 60)
            ids[order] = np.concatenate([[0], np.cumsum(~equal)]) if len(told) else []
            gaps[order[:-1][equal]] = (order[1:] - order[:-1])[equal]
            start, stop, period = runs(ids, gaps, int(counts.max(initial=0)))
            of = owner[start]
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, stop, -1)
            keep = drop[:-1].cumsum() == 0
            left = np.bincount(owner[keep], minlength=len(counts))
            offsets = pa.array(np.concatenate([[0], left.cumsum()]).astype(np.int32))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(offsets, flat.take(pa.array(source[keep]))), " ")
            place, length = start - starts[of], stop - start
            exponent = 1000 * length // period
            texts: list[list[str]] = [[] for _ in range(len(counts))]
            best: list[tuple | None] = [None] * len(counts)
            for k, s, n, q, e in zip(of.tolist(), place.tolist(), length.tolist(), period.tolist(), exponent.tolist()):
                texts[k].append(f"{s},{n},{q}\n")
                if best[k] is None or (-n, s, q) < (-best[k][1], best[k][0], best[k][2]):
                    best[k] = (s, n, q, e)
            digests = [hashlib.sha256("".join(t).encode()).hexdigest() for t in texts]
            kept = [hashlib.sha256(v.as_buffer() or b"").hexdigest() for v in collapsed]
            columns = [pa.array([b and b[i] for b in best], pa.int64()) for i in range(4)]
            columns = [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), *columns, pa.array(digests), pa.array(kept)]
            yield pa.record_batch(columns, ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    return out.withColumnRenamed("id", key)
