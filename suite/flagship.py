"""Scan, parse, grid, resample, gap statistics in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import gaps
from gaugeline.operators.clean import clean
from gaugeline.operators.grid import grid_join, to_slots
from gaugeline.operators.resample import resample
from gaugeline.schema import SeriesSchema
from suite.frames import DENSE, HI, LO, QUARTER_HOUR, rounded, telemetry
from suite.registry import query

RAW = SeriesSchema(key="station", ts="ts", values=("level",), meta=(), signed=())


@query(f"""WITH {DENSE.replace('round_even(avg(level), 6)', 'avg(level)')}, m AS (SELECT station, 100.0 * count(*) FILTER (level IS NULL) / count(*) AS missing FROM dense GROUP BY station)
SELECT station, date_trunc('hour', ts) AS ts, round_even(avg(level), 6) AS level, max("level_Status") AS "level_Status", round_even(max(missing), 6) AS missing_percentage
FROM dense JOIN m USING (station) GROUP BY 1, 2""")
def hourly_level_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    raw = telemetry(spark, sf).select("station", "ts", "level", "level_Status")
    typed = clean(raw, RAW, LO, "2024-01-31", {}, derive=(), times=())
    slots = to_slots(typed, ["station"], "ts", QUARTER_HOUR, {"level": F.avg("level"), "level_Status": F.max("level_Status")})
    dense = grid_join(slots, "station", "ts", LO, HI, QUARTER_HOUR)
    hours = resample(dense, "station", "ts", "h", {"level": "mean", "level_Status": "max"}, digits=6)
    missing = gaps.missing_rate(dense, "station", "level", "before").select(F.col("station_id").alias("station"), "missing_percentage")
    return rounded(hours.join(missing, "station"))
