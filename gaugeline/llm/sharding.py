"""Rows into shards by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import numbered

#: Multiplier of the published generator (Lamping and Veach, 2014): a fixed value.
STEP = 2862933555777941757


def jump(key: Column, shards: int) -> Column:
    """The shard of a key in 0 .. shards - 1, computed without a ring table.

    ``key`` is a non-negative number below 2**64. A pseudo-random walk started at the key jumps forward through the
    shard numbers; the last one below ``shards`` is taken. With one shard more a key stays or moves to the new shard.
    Every jump moves ahead by one shard at least, so ``shards`` steps suffice.
    """
    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"), key.cast("decimal(20,0)").alias("k"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(STEP).cast("decimal(19,0)") + 1) % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(k.cast("decimal(38,0)") / F.lit(str(1 << 33)).cast("decimal(10,0)")).cast("double")
        ahead = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0))).cast("long")
        return F.when(s["next"] < shards, F.struct(s["next"].alias("shard"), ahead.alias("next"), k.alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"]).cast("int")


def stable_key(value: Column) -> Column:
    """60 bits of the MD5 of the value as text: the same on every platform and in every session. Null counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: key, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    The key and the number of shards alone decide the shard; ``grown_shard`` is the one with a shard more. ``slot``
    numbers the rows of a shard from 0 without gaps. Cases: a null text has size 1 and checksum 0; null keys share a
    shard; repeated rows each get a slot; an empty table gives no rows; other columns are left out unless named in ``extra``.
    Keys are hashed one by one, so a key with a third of all rows fills its shard, as the law asks, but no task: slots
    are counted per partition.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        stable_key(F.col(key)).alias("_key"),
        *extra,
    )
    rows = rows.select("*", jump(F.col("_key"), shards).alias("shard"), jump(F.col("_key"), shards + 1).alias("grown_shard")).drop("_key")
    return numbered(rows, ["shard"], "slot").select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard", *extra)
