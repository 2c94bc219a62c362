"""What the operators share: reading, gapless numbers, word arrays, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.session import checkpointed, shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_in(doc_id: Column, n: int) -> Column:
    """True where the CRC32 of the id as text leaves remainder 0: the rows held out from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n == 0


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... without gaps within each combination of ``keys``.

    The rows are written once; each written partition counts its rows per key, the running sum over these counts gives
    every (key, partition) its first number. No task holds more rows of a key than one partition had, so a key
    that a third of all rows share is no heavier than any other.
    """
    fixed = checkpointed(df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = fixed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    first = first.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"), "_first")
    rows = fixed.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_row")))
    same = (F.col("_part") == F.col("_p")) & F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = rows.join(first, same).withColumn(name, F.col("_first") + F.col("_at") - 1)
    return joined.drop("_part", "_row", "_p", "_first", "_at", *(f"_k_{k}" for k in keys))


def components(edges: DataFrame, kept: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Connected components of ``edges`` (a, b) by alternating large and small stars: rows (node, component), where
    component is the smallest node reachable. Nodes without an edge are not in the result.

    Neighbourhoods are never gathered: each round is an aggregate to the smallest neighbour and a join back, both of
    which spread a node with very many edges over tasks. The rounds grow with the logarithm of the longest path. ``kept`` writes the
    edges of each round; files of ``scratch`` are read by as many tasks as their size asks for, a checkpoint by one per partition.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star, state = kept(star), None
    while True:
        both = star.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = kept(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(star.select("b", "b").distinct())
        state = now


def spaced_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased (A-Z) words between ASCII white space of all texts in one array, and how many each text has."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    flat = words.flatten()
    blank = pc.equal(flat, "")  # an empty text splits into one empty word
    if pc.any(blank).as_py():
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = ~blank.to_numpy(zero_copy_only=False)
        flat, counts = flat.filter(pa.array(keep)), np.bincount(owner[keep], minlength=len(counts))
    return flat, counts


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``most`` bytes of ``column``, or a single row: bounds what a task holds. What a task
    has freed goes back to the machine when its rows end, since its process lives on beside later stages."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        lo = 0
        while lo < batch.num_rows:
            base = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    hand_back()


def hand_back() -> None:
    """Returns freed memory of Arrow and of the C library to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def handing_back(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task code, which hands back freed memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        hand_back()

    return run


#: A key that one row in so many has, or more, is hot. At most so many keys are.
HOT = 1000


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], times: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has one row per key and in ``times`` the number of rows with it, out of ``total``.

    Rows of hot keys meet a broadcast of ``HOT`` rows of ``found`` at most, wherever they are; only the others are shuffled by key.
    """
    hot = F.col(times) * HOT >= total
    few, rest = F.broadcast(found.where(hot).drop(times)), found.where(~hot).drop(times)
    return rows.join(few, keys).unionByName(rows.join(few.select(*keys), keys, "left_anti").join(rest, keys, how))


#: A single text of a learning sample takes this part of its bytes at most.
SHARE = 64


def sample(docs: DataFrame, wanted: DataFrame, text_bytes: int) -> DataFrame:
    """Rows (h, y, text) to learn from: one text per id of ``wanted`` (doc_id, y, h: a bounded number of rows), ``text_bytes`` in all.

    A text of more than a ``SHARE``-th of ``text_bytes`` is passed over, of the others of an id the one with the smallest digest is
    taken, and then ids in the order of ``h`` as long as all their texts fit. Copies shrink to a digest and a size where they are read; texts
    are fetched last, those of a chosen digest only.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", text.alias("text")).join(F.broadcast(wanted), "doc_id").withColumn("n", F.octet_length("text"))
    sized = sized.where(F.col("n") <= text_bytes // SHARE).withColumn("d", F.md5(F.col("text").cast("binary")))
    one = sized.groupBy("doc_id").agg(F.min(F.struct("d", "n")).alias("s"))
    rows = one.join(F.broadcast(wanted), "doc_id").select("doc_id", "h", "s.d", "s.n").orderBy("h", "doc_id").collect()
    chosen, total = [], 0
    for r in rows:
        if total + r["n"] <= text_bytes:  # one that does not fit leaves room for those after it
            total += r["n"]
            chosen.append((r["doc_id"], r["d"]))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, d string")
    # Copies of a text are equal: any one of them will do, and an aggregate keeps one per task.
    return sized.join(F.broadcast(chosen), ["doc_id", "d"]).groupBy("doc_id", "h", "y").agg(F.first("text").alias("text")).select("h", "y", "text")


#: Spark's setting that drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a table to the shared folder and reads it back; the tables go when the block ends, so
    what leaves the block must not read them. What was shuffled for a table goes when it is written, and so do the tables given as
    ``used``, which nothing may read any more."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    count, places = iter(range(1 << 30)), []

    def drop(path: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def kept(df: DataFrame, *used: DataFrame) -> DataFrame:
        path = f"{folder}/{next(count)}"
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        for own, place in places:
            if any(own is table for table in used):
                drop(place)
        places.append((spark.read.schema(df.schema).parquet(path), path))
        return places[-1][0]

    try:
        yield kept
    finally:
        drop(folder)


#: Bits of a set of ids that is sent to all tasks: a bound whatever the number of ids.
MARKS = 1 << 23


def marks(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for the hash of each id, 2**23 in all. It only spares rows whose id cannot be in ``ids`` a join; the join decides."""
    bits = ids.select(F.pmod(F.xxhash64(column), F.lit(MARKS)).alias("b"))
    rows = bits.groupBy(F.floor(F.col("b") / 4096).alias("k")).agg(F.bitmap_construct_agg(F.col("b") % 4096).alias("m")).collect()
    out = np.zeros((MARKS // 4096, 4096), bool)
    for r in rows:
        out[r["k"]] = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8)[:512], bitorder="little").astype(bool)
    return np.packbits(out.ravel())


def mark_place(ids: str) -> Column:
    """The place of an id in ``marks``, to be looked up with ``marked`` in a task."""
    return F.pmod(F.xxhash64(ids), F.lit(MARKS))


def marked(found: np.ndarray, places: pa.Array) -> pa.Array:
    at = places.to_numpy()
    return pa.array((found[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))
