"""Stored encoders, fitted pipelines, the run log and the best table."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gaugeline import SeriesSchema
from gaugeline.operators import encode as E
from gaugeline.operators import evaluate as EV
from gaugeline.operators import models as ML
from gaugeline.plans import training

ROWS = [("a", 1.0, 2, "x"), ("a", None, 0, "y"), ("a", 3.0, None, "x"), (None, 5.0, 1, None), (None, 6.0, 1, "z"), ("b", None, 4, "x")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, n double, s_Status int, r string")


@pytest.mark.parametrize("few", [64, 1])
def test_encoder_vectors(spark, rows, tmp_path, monkeypatch, few):
    monkeypatch.setattr(E, "FEW", few)
    E.fit_encoder(rows, ["n"], ["s_Status", "r"], ["g"]).save(str(tmp_path))
    encoder = E.Encoder.load(spark, str(tmp_path))
    assert encoder.sizes == {"s_Status": 4, "r": 4}
    test = rows.unionByName(spark.createDataFrame([("a", 2.0, 4, "w"), ("new", 2.0, 2, "x")], rows.schema))
    got = [r["x"] for r in encoder.apply(test).select("g", "n", "s_Status", "r", vector_to_array("features").alias("x")).collect()]
    key = lambda v: str(v)
    root = float(np.sqrt(1.5))
    want = [[-root, 0, 0, 1, 0, 0, 1, 0, 0], [0, 1, 0, 0, 0, 0, 0, 1, 0], [root, 1, 0, 0, 0, 0, 1, 0, 0], [-1, 0, 1, 0, 0, 1, 0, 0, 0], [1, 0, 1, 0, 0, 0, 0, 0, 1]]
    want += [[0, 0, 0, 0, 1, 0, 1, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 0]]
    assert sorted([[round(v, 9) + 0.0 for v in x] for x in got], key=key) == sorted([[round(v, 9) + 0.0 for v in x] for x in want], key=key)
    if few == 64:
        assert encoder.names() == ["n", "s_Status_0", "s_Status_1", "s_Status_2", "s_Status_4", "r_missing_value", "r_x", "r_y", "r_z"]


def test_entries_of_large_sparse_vectors_are_added_without_listing_places(spark):
    size = 2**31 - 1  # as an array it would take 16 GB
    rows = [(1, Vectors.sparse(size, [0, 7, size - 1], [5.0, 1.0, 2.0])), (2, Vectors.sparse(size, [0], [5.0])), (3, Vectors.dense([5.0, 1.0])), (4, Vectors.dense([]))]
    df = spark.createDataFrame(rows, ["id", "v"])
    assert {r["id"]: r["s"] for r in df.select("id", E.entries_sum("v", 1).alias("s")).collect()} == {1: 3.0, 2: 0.0, 3: 1.0, 4: 0.0}


def test_groups_without_a_name_are_scaled(spark, rows):
    fitted = E.fit_numeric(rows, ["n"], ["g"])
    got = {(r["g"], r["n"]) for r in E.apply_numeric(rows, fitted, ["n"], ["g"]).collect()}
    assert (None, -1.0) in got and (None, 1.0) in got
    two = E.fit_numeric(rows.withColumn("h", F.lit("k")), ["n"], ["h", "g"])
    assert E.apply_numeric(rows.withColumn("h", F.lit("k")), two, ["n"], ["h", "g"]).where("g is null and n is null").count() == 0


def test_routing_by_roles(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, "u", "k", 4)], "flow double, height double, flow_code int, basin string, station string, place int")
    own = SeriesSchema(key="station", ts="at", values=("flow",), meta=("height",), status_suffix="_code", categories=("basin",))
    assert E.routed(df, None, ["station"], own) == (["flow", "place"], ["flow_code", "basin"])


def test_groups_without_a_name_get_a_mean(spark):
    df = spark.createDataFrame([(None, "train", 2.0), (None, "test", 9.0), ("a", "test", 1.0), ("a", "train", 5.0)], "g string, role string, y double")
    assert {(r["g"], r["y_pred"]) for r in ML.mean_baseline(df, ["g"]).collect()} == {(None, 2.0), ("a", 5.0)}


@pytest.fixture(scope="module")
def series(spark):
    n = 400
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, n)
    y = 20 + 5 * np.sin(np.arange(n) * 2 * np.pi / 24) + np.concatenate([[0, 0], 2 * x[:-2]]) + rng.normal(0, 0.05, n)
    rows = [(int(i), float(y[i]), float(x[i]) if i % 9 else None, float(rng.normal()), int(i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "h long, y_level double, push double, noise double, y_level_Status int")
    df = df.select(F.timestamp_micros(F.lit(1704067200000000) + F.col("h") * 3600000000).cast("timestamp_ntz").alias("Data_Hora_Medicao"), "y_level", "push", "noise", "y_level_Status")
    return training.prepare(df, "Data_Hora_Medicao", "y_level")


def test_models_beat_the_baselines(spark, series):
    kept = []
    fits = {"SEASONAL": training.seasonal_model(), "ARX": training.arx_model(exog=1, log=lambda t: kept.extend(t.collect()))}
    summary, preds = training.general_mode(series, "Data_Hora_Medicao", "y_level", [2, 30], 2, fits)
    rmse = {(r["model_name"], r["step"]): r["rmse"] for r in summary.collect()}
    assert rmse["ARX", 2] < rmse["SEASONAL", 2] < rmse["DUMMY", 2]
    assert {(r["step"], r["fold"], r["terms"][-1]) for r in kept if r["step"] == 2} == {(2, 1, "push"), (2, 2, "push")}
    assert preds.where("y_pred is null").count() == 0 and preds.count() == 3 * 2 * 2 * 30


def test_trees_are_saved_and_loaded(spark, series, tmp_path):
    f = training.walk_forward_folds(series, "Data_Hora_Medicao", "y_level", [2], 2)
    made = training.gbt_fit({"n_estimators": 4, "max_depth": 3}, select=3, folder=str(tmp_path))(f).select("fold", "idx", "y_pred").collect()
    rows, encoder = f.encoded
    assert len(f.names) > 3 and encoder.by == ("step", "fold")
    for fold in (1, 2):
        again = training.Fitted.load(str(tmp_path), 2, fold)
        assert len(again.places) == 3
        got = {(r["fold"], r["idx"], r["y_pred"]) for r in again.predict(rows).collect()}
        assert got == {tuple(r) for r in made if r["fold"] == fold}
    # A fold's scale comes from its own training rows.
    fits = {r["fold"]: r for r in encoder.numbers.where("column = 'noise'").collect()}
    for fold in (1, 2):
        want = f.rows.where(F.col("train_from") <= fold).agg(F.avg("noise")).first()[0]
        assert fits[fold]["mean"] == pytest.approx(want, abs=1e-3)


def test_tuned_parameters_are_used(spark, series, tmp_path):
    f = training.walk_forward_folds(series, "Data_Hora_Medicao", "y_level", [2], 1)
    space = {"max_depth": (1, 4, "int"), "n_estimators": (2, 4, "int"), "learning_rate": (0.3, 0.5, "float")}
    tune = training.tuner(2, space, splits=2)
    chosen = tune(f, 2, 1)
    tries = ML.candidates(2, 42, space)
    preds = training.sweep_folds(training.inner_folds(f, 2, 1, 2), tries)
    scores = training.sweep_scores(preds, tries).collect()
    assert tries[scores[0]["candidate"]] == chosen and scores[0]["rmse"] <= scores[1]["rmse"]
    training.gbt_fit(folder=str(tmp_path), tune=lambda *a: chosen)(f)
    assert training.Fitted.load(str(tmp_path), 2, 1).model.stages[1].getOrDefault("maxDepth") == chosen["max_depth"]


def test_leaf_ranges():
    for one in ML.candidates(40, 3, ML.LEAF_SEARCH_SPACE):
        assert 0.5 <= one["colsample_bytree"] <= 0.8 and round(one["colsample_bytree"] * 20, 6) == round(one["colsample_bytree"] * 20)
    assert ML.gbt({"max_depth": 9, "num_leaves": 20}).getMaxDepth() == 5


SCORED = "model_name string, target_column string, step int, fold int, rmse double, mae double, nse double, r2 double, kge double"


def test_log_keeps_runs_and_replaces_retries(spark, tmp_path):
    one = spark.createDataFrame([("A", "y", 1, 1, 2.0, 1.0, 0.5, 0.5, None), ("A", "y", 1, 2, 3.0, 1.0, 0.5, 0.5, None)], SCORED)
    for run, scored in (("r1", one), ("r2", one.withColumn("rmse", F.col("rmse") + 1)), ("r2", one.withColumn("rmse", F.col("rmse") - 1))):
        EV.RunLog(str(tmp_path), run).append(scored, "general", {"A": {"run": run}})
    log = EV.RunLog(str(tmp_path), "r3").read(spark)
    assert log.count() == 4 and log.where("run_id = 'r2'").agg(F.min(F.col("metrics")["rmse"])).first()[0] == 1.0
    assert EV.best_run(log, "rmse", "min").first()["params"] == {"run": "r2"}
    assert log.where("map_contains_key(metrics, 'kge')").count() == 0


def test_best_table_takes_the_last_whole_snapshot(spark, tmp_path):
    best = EV.BestTable(str(tmp_path / "best"))
    assert best.read(spark) is None
    now = lambda e: spark.createDataFrame([("A", "y", 1, e)], "model_name string, target_column string, step int, rmse double")
    top = lambda t: t.where("model_name = 'A_BEST'").first()["rmse"]
    assert [top(best.merge(now(e))) for e in (3.0, 5.0, 2.0, 2.0)] == [3.0, 3.0, 2.0, 2.0]
    (tmp_path / "best" / "snapshot-9").mkdir()  # died before its end
    assert top(best.read(spark)) == 2.0 and best.read(spark).count() == 2
