import json
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import schema as S
from gaugeline.sources import payloads as P
from gaugeline.sources import tables as Q


def plan(spark, start, end):
    df = spark.createDataFrame([("s", start, end)], "station string, start_date string, end_date string")
    return P.chunk_plan(df).orderBy("start_date").collect()


@pytest.mark.parametrize("days, spans", [(32, [30, 2]), (29, [21, 7, 1]), (59, [30, 21, 7, 1]), (1, [1]), (5, [2, 2, 1]), (90, [30, 30, 30])])
def test_plan_golden(spark, days, spans):
    got = plan(spark, "2024-01-01", str(date(2024, 1, 1) + timedelta(days=days - 1)))
    assert [r["actual_chunk_days"] for r in got] == spans
    assert got[-1]["range_days"] == ("DIAS_2" if spans[-1] == 1 else f"DIAS_{spans[-1]}")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 800))
def test_plan_covers_each_day_once(spark, days):
    got = plan(spark, "2020-02-20", str(date(2020, 2, 20) + timedelta(days=days - 1)))
    seen = [r["start_date"] + timedelta(days=i) for r in got for i in range((r["end_date"] - r["start_date"]).days + 1)]
    assert seen == [date(2020, 2, 20) + timedelta(days=i) for i in range(days)]


def test_plan_of_a_wrong_range(spark):
    with pytest.raises(Exception, match="start_date cannot be after end_date"):
        plan(spark, "2024-01-02", "2024-01-01")


def test_payload_files(spark, tmp_path):
    for i, items in enumerate([[{"a": 1, "b": "x"}, {"a": 2}], [], None]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": items} if items is not None else {"message": "none"}, indent=1))
    item = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert sorted(map(tuple, P.read_items(spark, str(tmp_path), item).collect())) == [(1, "x"), (2, None)]


def test_endpoints(spark):
    catalogue = P.endpoint_catalogue(spark)
    assert {r["kind"]: r["count"] for r in catalogue.groupBy("kind").count().collect()} == {"chunked": 14, "one_shot": 7}
    assert P.select_endpoints(["all"]) == list(S.CHUNKED_ENDPOINTS)
    with pytest.raises(ValueError):
        P.select_endpoints(["HidroSerieCotas", "nope"])


def test_codes_and_names(spark):
    df = spark.createDataFrame([("1, 2",), (" ,3,",), ("",)], "codes string")
    assert sorted(r[0] for r in P.split_codes(df, "codes").collect()) == ["1", "2", "3"]
    named = P.with_state_name(spark.createDataFrame([("RS",), ("XX",)], "uf string"), "uf").collect()
    assert [r["state_name"] for r in named] == ["Rio Grande do Sul", None]
    assert P.station_names(spark).count() == 9


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS readings")
    Q.append_aligned(spark.createDataFrame([(1, 2.0, "a")], "k int, v double, note string"), "readings")
    Q.append_aligned(spark.createDataFrame([("extra", "7", "x")], "other string, k string, v string"), "readings")
    Q.append_positional(spark.createDataFrame([(3, 4.0, "c")], "z int, y double, x string"), "readings")
    assert sorted(spark.table("readings").collect(), key=lambda r: r[0]) == [(1, 2.0, "a"), (3, 4.0, "c"), (7, None, None)]
    Q.append_absent(spark.createDataFrame([(1, 9.0), (8, 9.0)], "k int, v double"), "readings", ["k"])
    assert spark.table("readings").count() == 4
    Q.replace_table(spark.createDataFrame([(5,)], "k int"), "readings")
    assert spark.table("readings").collect() == [(5,)]
    assert Q.run(spark, "SELECT k + ? AS k FROM readings", [2])["result"].first()["k"] == 7
    both = Q.run(spark, {"a": "SELECT * FROM readings", "b": "SELECT count(*) AS n FROM readings"})
    assert both["a"].columns == ["k"] and both["b"].first()["n"] == 1


def test_stage_files(spark, tmp_path):
    df = spark.range(500).select(
        (F.col("id") % 3).cast("string").alias(S.KEY), F.timestamp_micros(F.col("id") * 900_000_000).cast("timestamp_ntz").alias(S.TS), F.col("id").alias("v"))
    saved = Q.save_stages(str(tmp_path), cleaned=df, missing=None)
    assert list(saved) == ["cleaned"] and saved["cleaned"].columns == df.columns
    assert saved["cleaned"].exceptAll(df).count() == 0 and saved["cleaned"].count() == 500
    assert {p.name for p in (tmp_path / "data_stations_cleaned").glob("codigoestacao=*")} == {f"codigoestacao={i}" for i in range(3)}
    plan = saved["cleaned"].filter(F.col(S.KEY) == "1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(codigoestacao" in plan
    Q.export_csv(df.limit(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_station_list_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias(S.KEY), F.col("id").alias("v"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "raw"))
    scan = Q.scan_stations(spark.read.parquet(str(tmp_path / "raw")), ["1", "2"]).select("v")
    text = scan._jdf.queryExecution().executedPlan().toString()
    assert "In(codigoestacao, [1,2])" in text and "wide" not in text
    assert scan.count() == 2


DAY = "s string, t timestamp_ntz, v double"


def test_a_day_written_again_leaves_the_others_alone(spark, tmp_path):
    import os

    from gaugeline.sources import tables

    rows = spark.sql("SELECT cast(id % 3 AS string) AS s, timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id AS int)) AS t, cast(id AS double) AS v FROM range(96)")
    tables.save_days(rows, str(tmp_path), "cleaned", "t", "s")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    before = files()
    second = rows.where("t >= '2024-01-02' and t < '2024-01-03'").withColumn("v", -rows["v"])
    tables.save_days(second, str(tmp_path), "cleaned", "t", "s")
    after = files()
    assert {f: m for f, m in before.items() if "2024-01-02" not in f} == {f: m for f, m in after.items() if "2024-01-02" not in f}
    got = tables.read_days(spark, str(tmp_path), "cleaned")
    assert got.count() == 96 and {r["v"] < 0 for r in got.where("day = '2024-01-02'").collect()} == {True} and got.where("v < 0").count() == 24
    os.remove(tmp_path / tables.STAGE_TABLES["cleaned"] / "_whole")  # what a write that died leaves behind
    with pytest.raises(RuntimeError):
        tables.read_days(spark, str(tmp_path), "cleaned")


def test_all_outputs_are_written(spark, tmp_path):
    from gaugeline.sources import tables

    frames = {stage: spark.createDataFrame([(stage, k) for k in range(3)], "codigoestacao string, step int") for stage in tables.STAGE_TABLES}
    got = tables.save_stages(str(tmp_path), **frames)
    assert len(got) == 10
    for stage, df in got.items():
        assert {(r["codigoestacao"], r["step"]) for r in df.collect()} == {(stage, k) for k in range(3)}
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(tables.STAGE_TABLES.values())
