"""The given tables seen as telemetry, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.expr import half_even
from gaugeline.operators.grid import grid_join, to_slots
from gaugeline.schema import SeriesSchema

# The range of the events table; both ends are slots of the grid.
LO, HI = "2024-01-01", "2024-01-30 23:45:00"
QUARTER_HOUR, HOUR = 900, 3600
STATIONS = ["click", "error", "purchase", "signup", "view"]
SCHEMA = SeriesSchema(key="station", ts="ts", values=("level", "rain", "temp"), meta=("altitude", "river"), signed=("temp",))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded for comparison, negative zero as zero."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[(half_even(c, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw readings: level with a manual fallback, rain, a temperature that may be negative, a code.

    Roots have no short decimals, so means of them do not sit between two rounded values; both sides round alike.
    """
    e, root = F.col("event_id"), F.sqrt("value")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("station"),
        "ts",
        "event_id",
        F.when(e % 5 != 0, root).alias("level"),
        F.when(e % 7 == 0, root).alias("manual"),
        F.sqrt(F.get_json_object("props", "$.k").cast("double")).alias("rain"),
        (root - 4).alias("temp"),
        F.when(e % 3 != 0, e % 4).alias("level_Status"),
    )


def quarter(spark: SparkSession, sf: str) -> DataFrame:
    """One reading per station and occupied quarter hour."""
    rules = {
        "level": half_even(F.avg("level"), 6),
        "rain": half_even(F.avg("rain"), 6),
        "temp": half_even(F.avg("temp"), 6),
        "level_Status": F.max("level_Status"),
    }
    return to_slots(telemetry(spark, sf), ["station"], "ts", QUARTER_HOUR, rules)


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter-hour readings on the full grid, with the slot position."""
    return grid_join(quarter(spark, sf), "station", "ts", LO, HI, QUARTER_HOUR)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means on the full grid, with the slot position."""
    rules = {"level": half_even(F.avg("level"), 6), "rain": half_even(F.avg("rain"), 6), "temp": half_even(F.avg("temp"), 6)}
    readings = to_slots(telemetry(spark, sf), ["station"], "ts", HOUR, rules)
    return grid_join(readings, "station", "ts", LO, "2024-01-30 23:00:00", HOUR)


def hourly_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly level, one column per station."""
    return hourly(spark, sf).groupBy("ts").pivot("station", STATIONS).agg(F.first("level", True))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as many long series: one per supplier."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def daily_shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity per supplier and day, with the position in the supplier's series."""
    from gaugeline.operators.chunks import with_series_index

    daily = shipments(spark, sf).groupBy("station", "ts").agg(F.sum("value").alias("value"))
    return with_series_index(daily, ["station"], "ts", bucket_seconds=86_400 * 30)


TEL = """tel AS (
  SELECT event_type AS station, ts, event_id,
    CASE WHEN event_id % 5 <> 0 THEN sqrt(value) END AS level,
    CASE WHEN event_id % 7 = 0 THEN sqrt(value) END AS manual,
    sqrt(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS rain,
    sqrt(value) - 4 AS temp,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS "level_Status"
  FROM events)"""
QUARTER = TEL + """, quarter AS (
  SELECT station, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round_even(avg(level), 6) AS level, round_even(avg(rain), 6) AS rain,
    round_even(avg(temp), 6) AS temp, max("level_Status") AS "level_Status"
  FROM tel GROUP BY 1, 2)"""
DENSE = QUARTER + """, slots AS (
  SELECT station, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTE)) AS ts
  FROM (SELECT DISTINCT station FROM tel)), dense AS (
  SELECT s.station, s.ts, q.level, q.rain, q.temp, q."level_Status",
    row_number() OVER (PARTITION BY s.station ORDER BY s.ts) - 1 AS idx
  FROM slots s LEFT JOIN quarter q ON s.station = q.station AND s.ts = q.ts)"""
HOURLY = TEL + """, hours AS (
  SELECT station, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS ts
  FROM (SELECT DISTINCT station FROM tel)), hr AS (
  SELECT station, date_trunc('hour', ts) AS ts, round_even(avg(level), 6) AS level, round_even(avg(rain), 6) AS rain, round_even(avg(temp), 6) AS temp
  FROM tel GROUP BY 1, 2), hourly AS (
  SELECT h.station, h.ts, r.level, r.rain, r.temp, row_number() OVER (PARTITION BY h.station ORDER BY h.ts) - 1 AS idx
  FROM hours h LEFT JOIN hr r ON h.station = r.station AND h.ts = r.ts)"""
HOURLY_WIDE = HOURLY + """, wide AS (
  SELECT ts, max(level) FILTER (station = 'click') AS click, max(level) FILTER (station = 'error') AS error,
    max(level) FILTER (station = 'purchase') AS purchase, max(level) FILTER (station = 'signup') AS signup,
    max(level) FILTER (station = 'view') AS "view"
  FROM hourly GROUP BY ts)"""
SHIP = """ship AS (
  SELECT l_suppkey AS station, l_shipdate AS ts, l_quantity AS value, l_orderkey, l_linenumber, l_partkey FROM lineitem)"""
DAILY = SHIP + """, daily AS (
  SELECT station, ts, sum(value) AS value, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS idx
  FROM ship GROUP BY station, ts)"""
