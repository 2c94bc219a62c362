"""Queries, table writes and stage outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import schema as S

# --- Fixed values: stage names and their tables ----------------------------------------------------------------------
STAGE_TABLES = {
    "cleaned": "data_stations_cleaned",
    "filled": "data_stations_filled",
    "missing": "data_stations_missing",
    "outlier": "data_stations_outlier",
    "aggregated": "data_stations_aggregated",
    "melted": "data_stations",
    "case_predictions": "models_case_predictions",
    "test_predictions": "models_test_predictions",
    "metrics": "models_metrics",
    "features": "models_features",
}
PARTITIONED_BY = {
    "cleaned": [S.KEY],
    "filled": [S.KEY],
    "outlier": [S.KEY],
    "aggregated": [S.KEY],
    "test_predictions": ["step"],
}


def run(spark: SparkSession, query: str | dict[str, str], args: Sequence | dict | None = None) -> dict[str, DataFrame]:
    """One query under ``result``, or a frame per named query; nothing is computed before an action."""
    if isinstance(query, dict):
        return {name: spark.sql(text, args=args) for name, text in query.items()}
    return {"result": spark.sql(query, args=args)}


def register(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Make ``<folder>/<name>.parquet`` available to SQL as ``name``."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def scan_stations(df: DataFrame, stations: Sequence[str], key: str = S.KEY) -> DataFrame:
    """Rows of the listed stations; the list is pushed to the scan, or prunes partitions of a table laid out by key."""
    return df.filter(F.col(key).isin(list(stations)))


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name in the order and type of ``schema``: failed casts and absent columns NULL, others dropped."""
    return df.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def replace_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def append_positional(df: DataFrame, name: str) -> None:
    """Append by column position."""
    df.write.insertInto(name)


def append_aligned(df: DataFrame, name: str) -> None:
    """Append by column name with safe casts; creates the table when it does not exist."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        align_to(df, spark.table(name).schema).write.insertInto(name)
    else:
        replace_table(df, name)


def append_absent(df: DataFrame, name: str, keys: Sequence[str]) -> None:
    """Append only rows whose key the table does not hold yet."""
    append_aligned(absent_from(df, df.sparkSession.table(name), keys), name)


def absent_from(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(existing.select(*keys), list(keys), "left_anti")


def stage_path(folder: str, stage: str) -> str:
    return f"{folder}/{STAGE_TABLES[stage]}"


def save_stage(df: DataFrame, folder: str, stage: str, by: Sequence[str] | None = None) -> DataFrame:
    """Overwrite a stage's files and return a frame that reads them.

    ``by`` replaces the usual partition columns; give none for very many stations, whose files then are found by the
    ranges they are sorted into. Rows are gathered by the partition column and time range before the write, so that a task writes few files and a
    station with many rows is spread over several tasks.
    """
    usual = [c for c in PARTITIONED_BY.get(stage, []) if c in df.columns]
    by = usual if by is None else list(by)
    ts = next((c for c in (S.TS, "date") if c in df.columns), None)
    if usual and ts:
        df = df.repartitionByRange(*usual, ts).sortWithinPartitions(*usual, ts)
    writer = df.write.mode("overwrite")
    path = stage_path(folder, stage)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def save_stages(folder: str, **frames: DataFrame | None) -> dict[str, DataFrame]:
    """Save the stages given; a stage that is None is left alone."""
    return {stage: save_stage(df, folder, stage) for stage, df in frames.items() if df is not None}


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _marker(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_whole")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def save_days(df: DataFrame, folder: str, stage: str, ts: str, key: str) -> None:
    """Replace the days that ``df`` has rows of, and no others, in a stage laid out by day.

    Rows are dealt by ranges of day, station and time, so a day's files are few and each holds a range of stations, however many there
    are. A marker goes before the write and comes back after it: ``read_days`` refuses a stage whose last write
    died half way, and writing the same days again mends it.
    """
    spark, path = df.sparkSession, stage_path(folder, stage)
    fs, marker = _marker(spark, path)
    fs.delete(marker, False)
    dealt = df.withColumn("day", F.to_date(ts)).repartitionByRange("day", key, ts).sortWithinPartitions("day", key, ts)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    fs.create(marker, True).close()


def read_days(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """A stage written by ``save_days``; filters on ``day`` prune its folders, filters on the station its files."""
    path = stage_path(folder, stage)
    fs, marker = _marker(spark, path)
    if not fs.exists(marker):
        raise RuntimeError(f"the last write to {path} did not end; write its days again")
    return spark.read.parquet(path)
