import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugeline.functions import expr as X


def test_half_even_matches_arrays(spark):
    values = [0.25, 0.35, 1.0025, 1.0035, -0.25, 2.675, 12.5, 1e6 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r[0] for r in df.select(X.half_even("v", digits)).collect()]
        assert got == list(np.round(np.array(values), digits))


def test_numbers_codes_and_times(spark):
    df = spark.createDataFrame([("1,234.5",), ("x",), (None,), ("nan",), (" 7 ",), ("1,2x",)], "t string")
    assert [r[0] for r in df.select(X.parse_number("t")).collect()] == [1234.5, None, None, None, 7.0, None]
    codes = spark.createDataFrame([("3",), ("",), (None,)], "t string")
    assert [r[0] for r in codes.select(X.parse_code("t")).collect()] == [3, None, None]
    times = spark.createDataFrame([("2024-01-02 03:04:05",), ("soon",)], "t string").select(X.parse_time("t").alias("t"))
    assert times.dtypes == [("t", "timestamp_ntz")]
    assert [None if r[0] is None else r[0].isoformat() for r in times.collect()] == ["2024-01-02T03:04:05", None]


def test_clip_like_arrays(spark):
    df = spark.createDataFrame([(-5.0, 0.0, 10.0), (50.0, 0.0, 10.0), (-9.0, 0.0, -1.0), (None, 0.0, 1.0)], "c double, a double, b double")
    got = [r[0] for r in df.select(X.clip(F.col("c"), F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 10.0, float(np.clip(-9.0, 0.0, -1.0)), None]


def test_slots_before_and_after_the_epoch(spark):
    df = spark.createDataFrame([("1969-12-31 23:50:00",), ("2024-01-01 00:14:59",)], "t string").select(X.parse_time("t").alias("t"))
    got = [r[0].isoformat() for r in df.select(X.floor_time("t", 900)).collect()]
    assert got == ["1969-12-31T23:45:00", "2024-01-01T00:00:00"]


def test_calendar(spark):
    moments = pd.date_range("2023-02-27 05:00", periods=40, freq="31h")
    df = spark.createDataFrame(pd.DataFrame({"t": moments})).select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = df.select("t", *X.calendar("t")).orderBy("t").toPandas()
    for name, part, period in [
        ("month", moments.month, 12), ("hour", moments.hour, 24), ("dayofyear", moments.dayofyear, 365),
        ("dayofweek", moments.dayofweek, 7), ("day", moments.day, moments.days_in_month),
    ]:
        assert np.allclose(got[f"{name}_sin"], np.sin(2 * math.pi * part / period))
        assert np.allclose(got[f"{name}_cos"], np.cos(2 * math.pi * part / period))
    assert list(got["year"]) == [float(y) for y in moments.year]


def test_through_day(spark):
    df = spark.createDataFrame([("2024-01-02 23:59:59",), ("2024-01-03 00:00:00",)], "t string").select(X.parse_time("t").alias("t"))
    assert df.filter(X.through_day("t", "2024-01-02")).count() == 1
