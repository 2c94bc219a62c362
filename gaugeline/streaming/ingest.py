"""Streaming ingest of readings and streaming resampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.chunks import same

AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def as_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need the zoned type; in a UTC session the moment is the same."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def dedupe_stream(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop readings that were already seen with the same key and time, as repeated collection produces them.

    State is kept until the watermark passes, so it is bounded by the delay and not by the history.
    """
    return as_event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def resample_stream(df: DataFrame, key: str, ts: str, width: str, rules: dict[str, str], delay: str = "1 hour") -> DataFrame:
    """Means, maxima and the like per station and window; a window appears once the watermark has passed its end.

    First values and empty bins need later rows and stay with the batch operator.
    """
    wrong = [c for c, r in rules.items() if r not in AGGREGATES]
    if wrong:
        raise ValueError(f"not available on streams: {wrong}")
    windowed = as_event_time(df, ts).withWatermark(ts, delay).groupBy(key, F.window(ts, width))
    made = windowed.agg(*[AGGREGATES[r](c).alias(c) for c, r in rules.items()])
    start = F.col("window.start").cast(T.TimestampNTZType())
    return made.select(key, start.alias(ts), *rules)


def run_available(df: DataFrame, path: str, state: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it to files and return a frame that reads them."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode(mode)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_batches(df: DataFrame, path: str, state: str, made: Callable[[DataFrame, int], DataFrame]) -> None:
    """Process what is there; each batch writes ``made(rows, number)`` into a folder of its own number.

    A batch that is delivered again, as after a failure, replaces its own folder: every reading counts once.
    """

    def sink(rows: DataFrame, number: int) -> None:
        made(rows, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def _parts(rules: dict[str, str]) -> list[Column]:
    out = []
    for c, r in rules.items():
        if r not in AGGREGATES:
            raise ValueError(f"not available on streams: {c}")
        out += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count")] if r == "mean" else [AGGREGATES[r](c).alias(c)]
    return out


def collect_bins(df: DataFrame, key: str, ts: str, width: str, rules: dict[str, str], path: str, state: str) -> None:
    """Bins of a stream as partial aggregates per batch: nothing is held back until a watermark passes and no late reading is
    lost. ``read_bins`` merges them."""
    window = F.window(ts, width)["start"].cast(T.TimestampNTZType())
    write_batches(as_event_time(df, ts), path, state, lambda rows, _: rows.groupBy(key, window.alias(ts)).agg(*_parts(rules)))


def read_bins(spark: SparkSession, path: str, key: str, ts: str, rules: dict[str, str]) -> DataFrame:
    """The bins of all batches so far, also those that are still filling."""
    out = []
    for c, r in rules.items():
        out.append((F.sum(f"{c}_sum") / F.sum(f"{c}_count")).alias(c) if r == "mean" else AGGREGATES[r](c).alias(c))
    return spark.read.parquet(path).groupBy(key, ts).agg(*out)


def insert_absent(df: DataFrame, keys: Sequence[str], path: str, state: str) -> None:
    """Adds the readings of a stream whose keys the table does not hold yet, one of each within a batch.

    A batch is compared with the batches before it only, so delivering it again adds nothing. A missing key equals a missing key.
    """
    spark = df.sparkSession

    def fresh(rows: DataFrame, number: int) -> DataFrame:
        rows = rows.dropDuplicates(list(keys))
        if not number:
            return rows
        earlier = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path).where(F.col("batch") < number)
        return rows.alias("l").join(earlier.select(*keys).distinct().alias("r"), same(keys), "left_anti")

    write_batches(df, path, state, fresh)
