"""Vectors within an angle of each other: an exact range join over cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import components
from gaugeline.session import checkpointed

#: Vectors per pivot, pivots per label at most, vectors of a cell compared at a time: sizes of the work, not of the result.
CELL, PIVOTS, CHUNK, SLICE = 2_000, 64, 2_000, 20_000


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows as doubles; all have the same length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # keeps the squares of very large and small numbers finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of the batches that lie in one group of equal keys, and whether the group begins there."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
            own = tuple(c[lo] for c in columns)
            yield own != last, batch.slice(lo, hi - lo)
            last = own


def _assigned(angle: float):
    """Rows with their cell: each vector is an inner one of its nearest pivot's cell, and a guest of every other cell in
    which an inner vector within ``angle`` may lie.

    By the triangle inequality a neighbour x of y with pivot p nearest to x has d(y, p) <= d(x, p) + angle <= d(x, q) + angle
    <= d(y, q) + 2 * angle for y's own pivot q, d being the angle between vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: list[np.ndarray] = []
        for fresh, batch in _groups(batches, ["label", "dim", "slice"]):
            if fresh:
                pivots = []
            role = batch.column("role").to_numpy()
            x = _units(_vectors(batch.column("vector")))
            if (role == 0).any():
                pivots.append(x[role == 0])
            rows = np.flatnonzero(role == 1)
            if not len(rows):
                continue
            d = np.arccos(np.clip(x[rows] @ np.concatenate(pivots).T, -1, 1))
            own = d.argmin(1)
            inside = d <= d[np.arange(len(rows)), own][:, None] + 2 * angle + 1e-6
            at, cell = np.nonzero(inside)
            guest = cell != own[at]
            out = batch.select(["label", "dim", "node", "copies", "vector"]).take(pa.array(rows[at]))
            extra = [pa.array(cell.astype(np.int32)), pa.array(guest), pa.array(d[at, cell])]
            yield pa.record_batch([*out.columns, *extra], [*out.schema.names, "cell", "guest", "distance"])

    return run


def _joined(least: float, angle: float):
    """Per group (cell, chunk): how many links each inner vector has, and edges that span the components of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def close() -> pa.RecordBatch:
            parts = [p for p in state.get("parts", ()) if len(p)]
            if not parts:
                return pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["node", "links", "other"])
            nodes, links = np.concatenate(state["nodes"]), state["links"]
            known = len(nodes)
            label = np.arange(known)  # of the inner vectors that are linked through some vector
            pairs = np.unique(np.concatenate(state["same"])) if state["same"] else np.zeros(0, np.int64)
            a, b = pairs // known, pairs % known
            while True:
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            ids = [nodes, *(p[:, 0] for p in state["edges"])]
            other = [nodes[label], *(nodes[label[p[:, 1]]] for p in state["edges"])]
            count = [links, *(np.full(len(p), -1) for p in state["edges"])]
            return pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in (ids, count, other)], ["node", "links", "other"])

        for fresh, batch in _groups(batches, ["label", "dim", "cell", "chunk"]):
            if fresh and state:
                yield close()
            if fresh:
                state = {"parts": [], "nodes": [], "distance": [], "links": None, "same": [], "edges": []}
            first = batch.column("part").to_numpy() == 0
            x, node = _units(_vectors(batch.column("vector"))), batch.column("node").to_numpy()
            distance, copies = batch.column("distance").to_numpy(), batch.column("copies").to_numpy()
            if first.any():
                state["parts"].append(x[first])
                state["nodes"].append(node[first])
                state["distance"].append(distance[first])
            if first.all():
                continue
            inner, nodes, far = (np.concatenate(state[k]) for k in ("parts", "nodes", "distance"))
            if state["links"] is None:
                state["links"] = np.zeros(len(nodes), np.int64)
            x, node, distance, copies = x[~first], node[~first], distance[~first], copies[~first]
            # The triangle inequality once more: only vectors about as far from the pivot can be close.
            near = (distance >= far.min() - angle - 1e-6) & (distance <= far.max() + angle + 1e-6)
            x, node, copies = x[near], node[near], copies[near]
            hit = (inner @ x.T >= least) & (nodes[:, None] != node[None, :])
            state["links"] += hit @ copies
            column = np.flatnonzero(hit.any(0))
            if len(column):
                lead = hit[:, column].argmax(0)
                at, c = np.nonzero(hit[:, column])
                state["same"].append(np.unique(lead[c] * len(nodes) + at))
                state["edges"].append(np.column_stack([node[column], lead]))
        if state:
            yield close()

    return run


def join(vectors: DataFrame, least: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per vector, linked with the others of its label whose cosine is at least
    ``least``; exact, in double precision.

    Equal vectors of a label become one with a number of copies. Each label gets a pivot per ``CELL`` vectors; a vector
    belongs to the cell of its nearest pivot and visits those it may have a neighbour in. Cells are joined on their own, the inner vectors in chunks against the stream of all
    in the cell, so a cell of any size, as a large group of near copies makes one, is spread over tasks. A
    chunk hands on one number and one edge per vector, not its pairs.
    Cases: vectors that are null, empty or zero, or hold a null or non-finite number, and those without a label, link with nothing; nor do
    vectors of different length; copies link with each other; rows that repeat an id are one vector each; a null id takes
    part but is no component's id unless alone; an empty table gives no rows; other columns are ignored.
    """
    angle = math.acos(max(-1.0, min(1.0, least)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("text_label"))
    fine = F.col("text_label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    fine = fine & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("vector", F.when(fine, F.transform("vector", lambda v: F.when(v == 0, 0.0).otherwise(v))))
    nodes = rows.where("vector is not null").groupBy("text_label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    nodes = checkpointed(nodes.withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()))
    counts = nodes.groupBy("text_label", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("one"))
    counts = checkpointed(counts.withColumn("label", F.monotonically_increasing_id()))  # a number for each label and length
    wanted = F.least(F.ceil(F.col("n") / CELL), F.lit(PIVOTS))
    sized = nodes.join(counts, ["text_label", "dim"]).drop("text_label")
    part = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    pivots = sized.where((F.col("node") == F.col("one")) | (part < (wanted - 1) / F.col("n")))
    pivots = pivots.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("role", F.lit(0))
    placed = sized.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), slices).cast("int")).withColumn("role", F.lit(1))
    placed = pivots.unionByName(placed).drop("n", "one").repartition("label", "dim", "slice").sortWithinPartitions("label", "dim", "slice", "role")
    kinds = "label long, dim int, node long, copies long, vector array<double>, cell int, guest boolean, distance double"
    cells = checkpointed(placed.mapInArrow(_assigned(angle), kinds))

    chunks = cells.where("not guest").groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    spread = cells.join(chunks, ["label", "dim", "cell"])
    inner = spread.where("not guest").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")).withColumn("part", F.lit(0))
    every = spread.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("part", F.lit(1))
    keys = ["label", "dim", "cell", "chunk"]
    tiles = inner.unionByName(every).drop("chunks", "guest").repartition(*keys).sortWithinPartitions(*keys, "part", "distance")
    found = checkpointed(tiles.mapInArrow(_joined(least, angle), "node long, links long, other long"))

    links = found.where("links >= 0").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    told = nodes.select("text_label", "vector", "node", "copies").join(links, "node", "left").join(classes, "node", "left")
    told = told.select("text_label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    out = rows.join(told, ["text_label", "vector"], "left")
    lowest = out.where("c is not null").groupBy("c").agg(F.min("id").alias("lowest"))
    component = F.coalesce("lowest", "id")
    out = out.join(lowest, "c", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
