import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline import schema as S
from gaugeline.plans import etl, training
from gaugeline.streaming import ingest

DAYS = 12


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(21)
    parts = []
    for code, shift in (("87450004", 0), ("87444000", 6), ("86510000", 0)):
        at = pd.date_range(pd.Timestamp("2024-01-01") + pd.Timedelta(days=shift), "2024-01-13", freq="15min", inclusive="left")
        if code == "87450004":
            at = at[: 6 * 96]
        keep = rng.random(len(at)) > 0.1
        n = int(keep.sum())
        level = 1500 + 200 * np.sin(np.arange(len(at)) / 96)[keep] + rng.normal(0, 5, n)
        parts.append(pd.DataFrame({
            "CodigoEstacao": code, "Data_Hora_Medicao": at[keep].astype(str), "Data_Atualizacao": at[keep].astype(str),
            "Cota_Adotada": [f"{v:,.1f}" for v in level], "Cota_Manual": None, "Cota_Adotada_Status": "0",
            "Chuva_Adotada": rng.exponential(1, n).round(1).astype(str), "Chuva_Adotada_Status": "0",
            "Temperatura_Interna": (rng.normal(20, 4, n)).round(1).astype(str), "Vazao_Adotada": None, "Vazao_Adotada_Status": "0",
        }))
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[50:52, "Cota_Adotada"] = None
    pdf.loc[51, "Cota_Manual"] = "1,499.0"
    pdf.loc[70, "Cota_Adotada"] = "99,999.0"
    return spark.createDataFrame(pdf, "CodigoEstacao string, Data_Hora_Medicao string, Data_Atualizacao string, Cota_Adotada string, Cota_Manual string, "
                                 "Cota_Adotada_Status string, Chuva_Adotada string, Chuva_Adotada_Status string, Temperatura_Interna string, Vazao_Adotada string, Vazao_Adotada_Status string")


@pytest.fixture(scope="module")
def stages(spark, raw, tmp_path_factory):
    meta = spark.createDataFrame([("87450004", 1.0, 2.0, 3.0, 4.0, "87200000"), ("86510000", 5.0, 6.0, 7.0, 8.0, "86001000")],
                                 "codigoestacao string, Altitude double, Area_Drenagem double, Latitude double, Longitude double, Rio_Codigo string")
    stations = ["87450004", "87444000", "86510000"]
    raw = raw.withColumnRenamed("CodigoEstacao", "codigoestacao")
    return etl.build(raw, meta, stations=stations, lo="2024-01-01", hi="2024-01-12 23:45:00", folder=str(tmp_path_factory.mktemp("stages")))


def test_stage_shapes(stages):
    filled = stages["filled"]
    assert filled.count() == 2 * DAYS * 96
    assert {r[0] for r in filled.select(S.KEY).distinct().collect()} == {"87450004", "86510000"}
    assert stages["aggregated"].count() == 2 * DAYS * 24
    melted = stages["melted"]
    assert melted.count() == DAYS * 24
    assert "Cota_Adotada_87450004" in melted.columns and not any(c.startswith("Vazao_Adotada_8") for c in melted.columns)
    assert "Temperatura_Interna_Status_86510000" in melted.columns


def test_outlier_is_removed_and_marked(stages):
    assert stages["filled"].filter("Cota_Adotada > 90000").count() == 1
    out = stages["outlier"]
    assert out.filter("Cota_Adotada > 90000").count() == 0
    assert out.filter("Cota_Adotada_Status = 5").count() >= 1
    rates = {(r["station_id"], r["period"]): r["missing_percentage"] for r in stages["missing"].collect()}
    assert rates["86510000", "after"] < rates["86510000", "before"]


def test_manual_level_fills_and_is_marked(stages):
    assert stages["cleaned"].filter("Cota_Adotada = 1499.0 AND Cota_Adotada_Status = 4").count() == 1


@pytest.fixture(scope="module")
def rows(stages):
    wide = stages["melted"].select(S.TS, "Cota_Adotada_87450004", "Cota_Adotada_86510000", "Chuva_Adotada_86510000", "Cota_Adotada_Status_86510000")
    ready = training.prepare(wide, S.TS, "Cota_Adotada_87450004", "2024-01-12")
    return training.add_features(ready, S.TS, [6, 24], [12], [24])


def test_features_follow_the_wide_rows(rows):
    pdf = rows.orderBy("idx").toPandas()
    assert list(pdf["idx"]) == list(range(len(pdf)))
    for c in ("Cota_Adotada_87450004", "Cota_Adotada_86510000", "Chuva_Adotada_86510000"):
        assert np.allclose(pdf[f"lag_6_{c}"], pdf[c].shift(6).fillna(0))
        assert np.allclose(pdf[f"rolling_mean_12_{c}"], pdf[c].rolling(12).mean().fillna(0))
        assert np.allclose(pdf[f"cum_sum_24_{c}"], pdf[c].rolling(24, min_periods=1).sum().fillna(0))
    assert not any("Status" in c for c in pdf.columns if c.startswith(S.ENGINEERED_PREFIXES))


def test_general_mode(rows):
    fits = {"GBT": training.gbt_fit({"n_estimators": 3, "max_depth": 3})}
    summary, preds = training.general_mode(rows, S.TS, "Cota_Adotada_87450004", [6], 2, fits)
    got = preds.toPandas()
    assert got.groupby(["model_name", "fold"]).size().to_dict() == {(m, k): 6 for m in ("DUMMY", "GBT") for k in (1, 2)}
    assert np.allclose(np.expm1(got["y_pred_log"]), got["y_pred"])
    scores = summary.toPandas().set_index("model_name")
    assert scores.loc["GBT", "rmse"] < scores.loc["DUMMY", "rmse"]


def test_case_mode(rows):
    scores, preds, wide = training.case_mode(rows, S.TS, "Cota_Adotada_87450004", [6, 24], "2024-01-10", "2024-01-11")
    assert {r["model_name"] for r in scores.collect()} == {"DUMMY_CASE_STUDY"}
    assert wide.columns == ["date", "DUMMY_6h", "y_true_6h", "DUMMY_24h", "y_true_24h"] and wide.count() == 24
    assert preds.count() == 48


def test_snapshot_labels_every_split(rows):
    from gaugeline.operators.splits import event_split

    split = event_split(training.with_horizon(rows, "Cota_Adotada_87450004", 6), S.TS, "2024-01-10", "2024-01-11", 24)
    made = training.feature_snapshot(split, S.TS, "DUMMY", "Cota_Adotada_87450004")
    counts = {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}
    assert counts["test"] == 24 and counts["val"] == 24 and "target" in made.columns and "hour_sin" in made.columns


def test_stream_drops_repeated_readings_across_batches(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "s string, at long, v double").select("s", F.timestamp_micros((F.col("at") + 28_000_000) * 60_000_000).cast("timestamp_ntz").alias("ts"), "v").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    batch("one", [("a", i, float(i)) for i in range(60)])
    schema = spark.read.parquet(str(tmp_path / "in" / "one")).schema
    source = lambda: ingest.read_stream(spark, str(tmp_path / "in" / "*"), schema, 1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.run_available(ingest.dedupe_stream(source(), ["s"], "ts", "3 hours"), out, state)
    batch("two", [("a", i, float(i)) for i in range(30, 90)])
    got = ingest.run_available(ingest.dedupe_stream(source(), ["s"], "ts", "3 hours"), out, state)
    assert got.count() == 90 and got.select("ts").distinct().count() == 90


def test_stream_windows_close_after_the_delay(spark, tmp_path):
    rows = [("a", i, float(i)) for i in range(0, 180, 10)]
    spark.createDataFrame(rows, "s string, at long, v double").select("s", F.timestamp_micros(F.col("at") * 60_000_000).cast("timestamp_ntz").alias("ts"), "v").write.parquet(str(tmp_path / "in"))
    source = ingest.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    made = ingest.resample_stream(source, "s", "ts", "1 hour", {"v": "mean"}, "30 minutes")
    got = ingest.run_available(made, str(tmp_path / "out"), str(tmp_path / "state")).orderBy("ts").collect()
    assert [r["v"] for r in got] == [25.0, 85.0]
    with pytest.raises(ValueError):
        ingest.resample_stream(source, "s", "ts", "1 hour", {"v": "first"})


def test_batches_delivered_again_change_nothing(spark, tmp_path):
    def arrive(name, rows):
        spark.createDataFrame(rows, "s string, at long, v double").select("s", F.timestamp_micros(F.col("at") * 60_000_000).cast("timestamp_ntz").alias("ts"), "v").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    arrive("one", [("a", i, float(i)) for i in range(0, 100, 10)] + [(None, 5, 1.0), (None, 5, 1.0)])
    kinds = spark.read.parquet(str(tmp_path / "in" / "one")).schema
    source = lambda: ingest.read_stream(spark, str(tmp_path / "in" / "*"), kinds, 1)
    rules = {"v": "mean"}
    bins, keyed, state = str(tmp_path / "bins"), str(tmp_path / "keyed"), str(tmp_path / "state")
    for name in ("first", "second", "third"):
        if name == "second":
            arrive("two", [("a", 1, 100.0), ("a", 10, 5.0), ("b", 130, 7.0)])  # late, repeated and new
        again = "" if name != "third" else "again"  # a lost state: every batch comes again
        ingest.collect_bins(source(), "s", "ts", "1 hour", rules, bins, state + "b" + again)
        ingest.insert_absent(source(), ["s", "ts"], keyed, state + "k" + again)
        got = {(r["s"], r["ts"].hour, r["v"]) for r in ingest.read_bins(spark, bins, "s", "ts", rules).collect()}
        want = {("a", 0, 25.0), ("a", 1, 75.0), (None, 0, 1.0)}
        if name != "first":
            want = {("a", 0, (150 + 100 + 5) / 8), ("a", 1, 75.0), (None, 0, 1.0), ("b", 2, 7.0)}
        assert got == want
        rows = spark.read.parquet(keyed)
        assert rows.count() == rows.select("s", "ts").distinct().count() == (11 if name == "first" else 13)
