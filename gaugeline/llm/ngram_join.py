"""Documents that share most of their word shingles: T-occurrence search with long inverted lists set aside (DivideSkip)."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import components, handing_back, mark_place, marked, marks, pieces_of, scratch, spaced_words, spread_join
from gaugeline.session import checkpointed

#: Text bytes shingled at a time, records searched at a time, and nodes of a list held
#: against others, and bytes of their outlines compared at a time: bounds on memory, not on the result.
BLOCK, RECORDS, TILE, STRIP = 4 << 20, 500, 400, 1024
#: Lists known as long, and the length from which a list counts as long. They only order the shingles, so neither bound
#: changes the result.
LONG_LISTS, LONG = 1 << 19, 4
#: Weight of the binary probes against the merge when the long lists are chosen (Li, Lu and Lu, 2008): a fixed value.
MU = 0.0085
_P = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null id, after all others: a class takes its number from a document that has one.
NO_ID = (1 << 63) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``width`` words; a shorter text is one run."""
    flat, counts = spaced_words(texts)
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = hashes[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs = runs * _P + words[k : len(words) - width + 1 + k]
    runs = _mixed(runs)
    out = []
    for first, n in zip((counts.cumsum() - counts).tolist(), counts.tolist()):
        if n >= width:
            out.append(np.unique(runs[first : first + n - width + 1]))
        else:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[first : first + n]:
                    h = h * _P + w
            out.append(_mixed(np.array([h] * min(n, 1), np.uint64)))
    return out


def _first(n: int, percent: int) -> int:
    """How many of the first of n shingles two sets must be looked up by: a link shares one of those."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _summaries(width: int, percent: int):
    """Rows (doc_id, n, key, hashes, seen): the size and a digest of each set, and on the first row of each block the shingles of all
    its sets that may come up in a list, were half of them set aside as long, with how often they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BLOCK):
            sets = shingle_sets(batch.column("text"), width)
            keys = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            found, seen = np.unique(np.concatenate([s[: 2 * _first(len(s), percent)] for s in sets]), return_counts=True)
            ends = pa.array([0] + [len(found)] * len(sets), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found.view(np.int64), seen.astype(np.int32))]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *lists], ["doc_id", "n", "key", "hashes", "seen"])

    return run


def _prefixes(width: int, percent: int, frequent):
    """Rows (key, doc_id, prefix): the |x| - ceil(p|x|) + 1 shingles with the shortest lists; two documents that link share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, weight = frequent.value
        met: set[bytes] = set()
        for batch in pieces_of(batches, "text", BLOCK):
            out: tuple[list, list, list] = ([], [], [])
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width)):
                key = xxhash.xxh3_128_digest(s) + xxhash.xxh3_64_digest(str(doc))
                if not len(s) or key in met:  # a copy within the task
                    continue
                met.add(key)
                if len(long):
                    at = np.minimum(np.searchsorted(long, s), len(long) - 1)
                    s = s[np.argsort(np.where(long[at] == s, weight[at], 0), kind="stable")]
                keep = _first(len(s), percent)
                for column, value in zip(out, (key[:16], doc, s[:keep].view(np.int64))):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["key", "doc_id", "prefix"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (s, node) in order, those of lists with several nodes, each with the list's first node as its centre."""
    last = centre = None
    for batch in batches:
        s, node = batch.column("s").to_numpy(), batch.column("node").to_numpy()
        if not len(s):
            continue
        fresh = np.concatenate([[s[0] != last], s[1:] != s[:-1]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), -1))
        centres = np.where(start < 0, 0 if centre is None else centre, node[start])
        other = node != centres
        last, centre = s[-1], centres[-1]
        s, node, centres = s[other], node[other], centres[other]
        lead = np.concatenate([s[:1] == s[:1], s[1:] != s[:-1]])  # the centre goes with the first other node of a batch
        columns = (s, s[lead]), (node, centres[lead]), (centres, centres[lead])
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], ["s", "node", "centre"])


def divide_skip(query: np.ndarray, records: list[np.ndarray], need: list[int]) -> list[int]:
    """The records that share at least ``need`` shingles with the query.

    The inverted lists of the query's shingles over the records are sorted by length; the longest ones are set aside,
    the short ones are merged by a heap, and a record that comes up often enough there is looked up in the long ones
    by binary search until it has, or can no longer reach, what it needs.
    """
    owner = np.repeat(np.arange(len(records)), [len(r) for r in records])
    every = np.concatenate(records)
    at = np.minimum(np.searchsorted(query, every), len(query) - 1)
    hit = query[at] == every
    order = np.lexsort((owner[hit], at[hit]))
    at, owner = at[hit][order], owner[hit][order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    lists = sorted((part.tolist() for part in np.split(owner, cuts)), key=len) if len(at) else []
    if not lists:
        return []
    least, longest = min(need), len(lists[-1])
    aside = min(int(least / (MU * math.log2(longest + 1) + 1)), least - 1, len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found, merged = [], heapq.merge(*short)
    last, seen = -1, 0
    for record in (*merged, -1):
        if record == last:
            seen += 1
            continue
        if last >= 0 and seen >= need[last] - aside:
            have, left = seen, aside
            for other in reversed(long):
                if have >= need[last] or have + left < need[last]:
                    break
                k = bisect_left(other, last)
                have += k < len(other) and other[k] == last
                left -= 1
            if have >= need[last]:
                found.append(last)
        last, seen = record, 1
    return found


def outline(shingles: np.ndarray) -> bytes:
    """A bitmap of hashed shingles, four to eight bits for each: what one set has there and the other has not bounds their overlap."""
    bits = 4 << max(3, (len(shingles) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(shingles >> np.uint64(20)) & np.uint64(bits - 1)] = True
    return np.packbits(out).tobytes()


def _folded(outline_: np.ndarray, size: int) -> np.ndarray:
    """The outline with ``size`` bytes, as the set would have it there."""
    bits = np.unpackbits(outline_).reshape(-1, size * 8).any(0)
    return np.packbits(bits)


def _may_link(n: int, a: np.ndarray, k: int, b: np.ndarray, percent: int) -> bool:
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = _folded(a, size), _folded(b, size)
    most = min(n - int(np.bitwise_count(a & ~b).sum()), k - int(np.bitwise_count(b & ~a).sum()))
    return (100 + percent) * most >= percent * (n + k)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """From rows (q, salt, node, n, own) in order: q, its own (n, own), and (node, n, own) of its records."""
    group, queries, records = None, [], []
    for batch in batches:
        own = batch.column("own")
        ends, values = own.offsets.to_numpy() if pa.types.is_list(own.type) else None, None
        if ends is not None:
            values = own.values.to_numpy().view(np.uint64)
        for k, (q, salt, node, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("q", "salt", "node", "n")))):
            if (q, salt) != group:
                if records:
                    yield group[0], queries, records
                group, queries, records = (q, salt), [], []
            data = values[ends[k] : ends[k + 1]].copy() if values is not None else np.frombuffer(own[k].as_py(), np.uint8)
            if node == q:
                queries.append((n, data))
            else:
                records.append((node, n, data))
    if records:
        yield group[0], queries, records


def _links(found: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    pairs = list(found)
    return pa.record_batch([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["q", "node"])


def _screened(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, queries, records in _groups(batches):
            yield _links((q, node) for node, k, b in records if any(_may_link(n, a, k, b, percent) for n, a in queries))

    return run


def _searched(percent: int):
    """One T-occurrence search per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, queries, records in _groups(batches):
            found = set()
            for n, query in queries:
                need = [-(-percent * (n + k) // (100 + percent)) for _, k, _ in records]
                found.update(records[k][0] for k in divide_skip(query, [s for *_, s in records], need))
            yield _links((q, node) for node in found).rename_columns(["a", "b"])

    return run


def _gathered(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """Rows (q, salt, node, n, own): the data of each query and of its records side by side. A query with many records has
    several groups, so none holds more than about ``RECORDS`` of them."""
    many = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / RECORDS).cast("int").alias("salts"))
    salted = pairs.join(many, "q")
    records = salted.select("q", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    queries = many.select("q", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("q").alias("node"))
    rows = records.union(queries).join(data, "node").select("q", "salt", "node", "n", "own")
    return rows.repartition("q", "salt").sortWithinPartitions("q", "salt")


def matched_components(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct rows of the lists with the component of each node."""
    return shared.distinct().join(classes, "node", "left").select("s", "node", "centre", F.coalesce("component", "node").alias("c"))


def _tiles(percent: int):
    """From rows of one list's two slices side by side, the pairs of different components that their outlines do not rule out.

    All overlaps of two slices are one product of bit matrices, so no pair leaves the task that cannot link."""

    def pairs(nodes: list, c: np.ndarray, n: np.ndarray, own: list, tile: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        out_a, out_b = [], []
        sizes = np.array([len(x) for x in own])
        for size in np.unique(sizes):
            near = np.flatnonzero((sizes == size) | (sizes == 2 * size))  # links differ in size by less than a factor of two
            packed = np.stack([own[k] if sizes[k] == size else _folded(own[k], size) for k in near])
            ones = np.bitwise_count(packed).sum(1, dtype=np.int64)
            left, right = np.flatnonzero(tile[near] == lo), np.flatnonzero(tile[near] == hi)
            if not len(left) or not len(right):
                continue
            both = np.zeros((len(left), len(right)), np.float32)
            for first in range(0, size, STRIP):
                bits = np.unpackbits(packed[:, first : first + STRIP], axis=1).astype(np.float32)
                both += bits[left] @ bits[right].T
            a, b = n[near[left]][:, None], n[near[right]][None, :]
            most = np.minimum(a - ones[left][:, None] + both, b - ones[right][None, :] + both)
            may = ((100 + percent) * most >= percent * (a + b)) & (c[near[left]][:, None] != c[near[right]][None, :])
            may &= (sizes[near[left]][:, None] == size) | (sizes[near[right]][None, :] == size)
            x, y = np.nonzero(may)
            out_a.append(near[left[x]])
            out_b.append(near[right[y]])
        if not out_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = nodes[np.concatenate(out_a)], nodes[np.concatenate(out_b)]
        found = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        return found[:, 0], found[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def close() -> pa.RecordBatch:
            tile, nodes, c, n = (np.array(x) for x in list(zip(*rows))[:4])
            a, b = pairs(nodes, c, n, [r[4] for r in rows], tile, group[1], group[2])
            return pa.record_batch([pa.array(a), pa.array(b)], ["q", "node"])

        for batch in batches:
            own = batch.column("own")
            for k, (s, lo, hi, *rest) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("s", "lo", "hi", "tile", "node", "c", "n")))):
                if (s, lo, hi) != group:
                    if rows:
                        yield close()
                    group, rows = (s, lo, hi), []
                rows.append((*rest, np.frombuffer(own[k].as_py(), np.uint8)))
        if rows:
            yield close()

    return run


def join(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per document: the size of its set of distinct ``width``-word shingles
    and the smallest id reachable over links, where two documents link when 100 * |x and y| >= percent * |x or y|.

    1. Equal sets become one node, the smallest id. 2. The lists of the shingles are measured and the long ones
    set aside, so that the lists of the first few shingles of each set stay short; sets that link share one of those. 3. Within each such list the first node is the query of a
    T-occurrence search over the others, save those whose outlines already rule the overlap out. 4. In lists that still hold several components all outlines are
    compared inside the tasks, slice against slice, and the pairs left between components are searched.
    So a group of thousands of near copies is compared with a few of its members, not pair by pair, and no link
    between different components is lost. All shuffles are by shingle, node or (query, slice of its records).
    Cases: null, empty and blank texts have no shingles and link with nothing; shorter texts are one shingle; rows with
    the same id are one document; rows without an id are one document, whose classes have the smallest id of the others; an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as kept:
        return checkpointed(_joined(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), width, percent, kept)).withColumnRenamed("doc_id", key)


def _joined(docs: DataFrame, width: int, percent: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``join``, from tables that ``kept`` writes."""
    spark = docs.sparkSession
    summaries = kept(docs.mapInArrow(_summaries(width, percent), "doc_id long, n long, key binary, hashes array<long>, seen array<int>"))
    often = summaries.select(F.explode(F.arrays_zip("hashes", "seen")).alias("s")).groupBy("s.hashes").agg(F.sum("s.seen").alias("w")).withColumnRenamed("hashes", "hash")
    often = often.where(F.col("w") >= LONG).orderBy(F.desc("w"), "hash").limit(LONG_LISTS).toPandas()
    long = often["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(long)
    frequent = spark.sparkContext.broadcast((long[order], often["w"].to_numpy(np.int64)[order]))
    members = summaries.select("doc_id", "n", "key", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    reps = members.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times"))

    prefixes = docs.mapInArrow(_prefixes(width, percent, frequent), "key binary, doc_id long, prefix array<long>")
    nodes = prefixes.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("key").agg(F.min("id").alias("node"), F.first("prefix").alias("prefix"))
    lists = nodes.select("node", F.explode("prefix").alias("s")).repartition("s").sortWithinPartitions("s", "node")
    ids = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).select("id", "text", mark_place("id").alias("b"))

    def data(wanted: DataFrame, kind: str) -> DataFrame:
        """Rows (node, n, own) of the wanted nodes, and perhaps of some others: the outline or the shingles of each set."""
        known = spark.sparkContext.broadcast(marks(wanted, "node"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces_of(batches, "text", BLOCK):
                batch = batch.filter(marked(known.value, batch.column("b")))
                sets = shingle_sets(batch.column("text"), width)
                own = pa.array([outline(s) for s in sets], pa.binary()) if kind == "binary" else pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.record_batch([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), own], ["node", "n", "own"])

        return ids.mapInArrow(run, f"node long, n long, own {kind}").where("n > 0")

    shared = kept(lists.mapInArrow(handing_back(_lists), "s long, node long, centre long"))
    outlines = kept(data(shared, "binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (q, node) that link, as (a, b)."""
        likely = checkpointed(_gathered(pairs, outlines).mapInArrow(handing_back(_screened(percent)), "q long, node long").distinct())
        either = likely.select("node").union(likely.select("q")).distinct()
        return checkpointed(_gathered(likely, data(either, "array<long>")).mapInArrow(handing_back(_searched(percent)), "a long, b long"))

    first = kept(shared.select(F.col("centre").alias("q"), "node").where("q <> node").distinct())
    links = verified(first)
    classes = components(links, kept)
    # Lists whose nodes are not all in one component yet: pairs between components that no search has seen.
    told = matched_components(shared, classes)
    mixed = told.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
    # Lists of the same nodes are searched once.
    mixed = mixed.where("lo <> hi").groupBy("n", "same", "lo", "hi").agg(F.min("s").alias("s")).select("s", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    rows = told.where("node <> centre").join(mixed, "s").withColumn("i", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("s", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").alias("tile"), "node", "c")
    rows = rows.join(outlines, "node").select("s", "lo", "hi", "tile", "node", "c", "n", "own").repartition("s", "lo", "hi").sortWithinPartitions("s", "lo", "hi")
    rest = kept(rows.mapInArrow(handing_back(_tiles(percent)), "q long, node long").distinct().join(first, ["q", "node"], "left_anti"))
    if not rest.isEmpty():
        classes = components(links.union(verified(rest)), kept)
    classed = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("class"), "times")
    found = spread_join(members, classed, ["key"], "times", members.count(), "left")
    result = F.coalesce("class", "id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(result != NO_ID, result).alias("component_id"))
