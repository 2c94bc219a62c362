import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.operators.grid import grid, one_per_slot, slots_between
from gaugeline.operators.resample import parse_frequency, resample

RULES = {"v": "mean", "v_Status": "max", "m": "first"}


def readings(spark):
    rng = np.random.default_rng(9)
    parts = []
    for name, start, hours in (("a", "2024-01-03 07:20", 900), ("b", "2024-02-10 13:05", 500)):
        at = pd.to_datetime(start) + pd.to_timedelta(np.sort(rng.choice(hours * 60, 700, replace=False)), unit="min")
        parts.append(pd.DataFrame({"s": name, "t": at, "v": rng.normal(10, 3, 700), "v_Status": rng.integers(0, 6, 700), "m": rng.normal(size=700)}))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[rng.choice(1400, 200, replace=False), "v"] = np.nan
    pdf.loc[rng.choice(1400, 700, replace=False), "m"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp_ntz"))
    return pdf, df.select("s", "t", "v_Status", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("v", "m")])


@pytest.mark.parametrize("freq", ["15min", "h", "5h", "7h", "D", "2D", "W", "ME", "2W", "3W-WED", "W-MON", "2ME", "MS", "2MS", "QE", "QE-JAN", "QS", "YE", "YS", "YE-JAN"])
def test_equals_pandas(spark, freq):
    pdf, df = readings(spark)
    got = resample(df, "s", "t", freq, RULES, digits=None).toPandas().sort_values(["s", "t"]).reset_index(drop=True)
    want = pd.concat(
        [g.resample(freq, on="t").agg({c: r for c, r in RULES.items()}).assign(s=s).reset_index() for s, g in pdf.groupby("s")], ignore_index=True
    )
    assert list(got["s"]) == list(want["s"])
    assert list(got["t"]) == list(want["t"])
    for c in RULES:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_rounding_and_missing_bins(spark):
    _, df = readings(spark)
    all_bins = resample(df, "s", "t", "15min", RULES)
    used = resample(df, "s", "t", "15min", RULES, emit_empty=False)
    assert all_bins.count() > used.count()
    assert all(r["v"] is None or r["v"] == round(r["v"], 3) for r in used.limit(50).collect())


def test_frequencies():
    assert parse_frequency("15min").seconds == 900 and parse_frequency("h").seconds == 3600 and parse_frequency("W").anchor == 3
    for bad in ("x", "15", "3M", "0D", "W-ABC", "QE-XXX", "MEE"):
        with pytest.raises(ValueError):
            parse_frequency(bad)


def test_missing_periods_appear(spark):
    rows = spark.createDataFrame([("a", "2024-01-31 23:59:59", 1.0), ("a", "2024-07-01 00:00:00", 2.0)], "s string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = [(str(r["t"])[:10], r["v"]) for r in resample(rows, "s", "t", "2ME", {"v": "sum"}).orderBy("t").collect()]
    assert got == [("2024-01-31", 1.0), ("2024-03-31", None), ("2024-05-31", None), ("2024-07-31", 2.0)]


def test_configured_grid(spark):
    assert slots_between("2018-08-01", "2025-10-05", 900) == 251_713
    got = grid(spark.createDataFrame([("a",), ("a",)], "s string"), "s", "t", "2018-08-01", "2025-10-05", 900)
    row = got.agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.countDistinct("t").alias("d")).first()
    assert (row["n"], row["d"]) == (251_713, 251_713)
    assert (row["lo"].isoformat(), row["hi"].isoformat()) == ("2018-08-01T00:00:00", "2025-10-05T00:00:00")


def test_one_per_slot(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 3, "y"), ("a", 1, 3, "y"), ("a", 2, None, "z")], "s string, slot int, o int, v string")
    assert sorted(map(tuple, one_per_slot(df, ["s", "slot"], ["o"]).collect())) == [("a", 1, 3, "y"), ("a", 2, None, "z")]


def test_readings_without_a_station_are_kept(spark):
    from gaugeline.operators.grid import grid_join
    from gaugeline.operators.resample import resample

    df = spark.createDataFrame([(None, "2024-01-01 00:00:00", 2.0), ("a", "2024-01-01 00:00:00", 1.0)], "k string, t string, v double")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    on_grid = grid_join(df, "k", "t", "2024-01-01 00:00:00", "2024-01-01 01:00:00", 3600)
    assert sorted((r["k"] or "", r["v"] or 0) for r in on_grid.collect()) == [("", 0), ("", 2.0), ("a", 0), ("a", 1.0)]
    assert sorted((r["k"] or "", r["v"]) for r in resample(df, "k", "t", "h", {"v": "mean"}).collect()) == [("", 2.0), ("a", 1.0)]
