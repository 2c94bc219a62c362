import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.operators import chunks as C

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.timestamp_micros(F.col("at") * 1_000_000).cast("timestamp_ntz"))


def test_numbering_equals_a_plain_window(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(t)) for s in ("a", "b", None) for t in rng.choice(10**6, 300, replace=False)]
    df = frame(spark, rows, "s string, at long")
    plain = df.withColumn("idx", F.row_number().over(Window.partitionBy("s").orderBy("at")) - 1)
    for made in (
        C.with_series_index(df, ["s"], "ts", bucket_seconds=3600),
        C.with_series_index(df, ["s"], "ts", then=["at"]),
        C.number_rows(df, ["s"], ["at"], C.chunk_of("at", 50_000)),
    ):
        assert made.select("s", "at", "idx").exceptAll(plain.select("s", "at", "idx")).count() == 0
        assert made.count() == len(rows)


def test_numbering_of_hot_times_and_copies(spark):
    rows = [("hot", 5)] * 4000 + [("hot", t) for t in range(100)] + [("cold", 1)] * 3 + [("cold", 0)]
    df = frame(spark, rows, "s string, at long")
    for made in (C.with_series_index(df, ["s"], "ts", copies=True), C.with_series_index(df, ["s"], "ts", then=["at"])):
        got = made.toPandas().sort_values(["s", "idx"])
        assert len(got) == len(rows)
        for _, part in got.groupby("s"):
            assert list(part["idx"]) == list(range(len(part)))
            assert part["at"].is_monotonic_increasing


def test_many_copies_are_unfolded_by_many_tasks(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("a", 3)], "s string, at long")
    df = df.withColumn("n", F.when(F.col("at") == 2, 60_000).otherwise(1)).select("s", "at", "ts", F.explode(F.sequence(F.lit(1), "n")).alias("_")).drop("_")
    got = C.with_series_index(df, ["s"], "ts", copies=True)
    row = got.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.max("idx").alias("hi")).first()
    assert (row["n"], row["d"], row["hi"]) == (60_002, 60_002, 60_001)
    assert got.filter("at = 3").first()["idx"] == 60_001
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_numbering_of_a_whole_frame(spark):
    df = frame(spark, [(int(t),) for t in np.random.default_rng(3).permutation(5000)], "at long")
    got = C.with_series_index(df, [], "ts", bucket_seconds=60)
    assert got.filter("idx <> at").count() == 0


@QUICK
@given(before=st.integers(0, 20), after=st.integers(0, 20), rows=st.integers(1, 40))
def test_chunked_windows_equal_plain_windows(spark, before, after, rows):
    df = spark.range(157).select(F.lit("a").alias("s"), F.col("id").alias("idx"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    span = lambda w: F.sum("v").over(w.rowsBetween(-before, after)).alias("x")
    made = C.over_chunks(df, ["s"], "idx", lambda f, w: f.select("*", span(w)), before, after, rows)
    plain = df.select("*", span(Window.partitionBy("s").orderBy("idx")))
    assert made.select("idx", "x").exceptAll(plain.select("idx", "x")).count() == 0
    assert made.count() == 157


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": rng.choice(["a", "b"], 900), "v": np.round(rng.lognormal(0, 3, 900), 1)})
    pdf.loc[rng.choice(900, 300, replace=False), "v"] = 0.0
    pdf.loc[5:20, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = C.value_ranks(df, ["s"], "v").toPandas().sort_values(["s", "v"])
    for s, part in got.groupby("s"):
        values = pdf.loc[(pdf.s == s) & pdf.v.notna(), "v"]
        assert list(part["v"]) == sorted(values.unique())
        assert list(part["cum"]) == [(values <= v).sum() for v in part["v"]]
        assert set(part["n"]) == {len(values)}
    cuts = C.percentiles(df, ["s"], "v", {"a": 0.25, "b": 0.5, "c": 0.99, "d": 1.0}).toPandas().set_index("s")
    for s in ("a", "b"):
        values = pdf.loc[(pdf.s == s) & pdf.v.notna(), "v"]
        assert np.allclose(cuts.loc[s, ["a", "b", "c", "d"]].astype(float), np.percentile(values, [25, 50, 99, 100]))


def test_expand_slots(spark, small_chunks):
    df = spark.createDataFrame([("a", -3, 30), ("b", 5, 5)], "s string, lo long, hi long")
    got = C.expand_slots(df, ["s"], F.col("lo"), F.col("hi")).toPandas()
    assert sorted(got[got.s == "a"]["slot"]) == list(range(-3, 31))
    assert list(got[got.s == "b"]["slot"]) == [5]


def test_a_large_group_is_ranked_in_many_pieces(spark):
    df = spark.range(40_000).select(F.lit("a").alias("s"), F.pmod(F.xxhash64("id"), F.lit(30_011)).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = C.value_ranks(df, ["s"], "v")
        plan = ranks._jdf.queryExecution().optimizedPlan().toString()
        assert "_part" in plan
        got = ranks.orderBy("v").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got["cum"].iloc[-1] == 40_000 == got["n"].iloc[0] and (got["cum"].diff().dropna() == got["cnt"].iloc[1:]).all()
