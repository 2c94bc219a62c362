import math
import random

import numpy as np
import pytest

from gaugeline.operators import boosting
from gaugeline.operators import models as ML

FEATURES = ["a", "b", "c", "d"]


def rows_of(spark, n, parts, hole=0.0):
    draw = random.Random(n)
    out = []
    for k in range(n):
        a, b, c, d = draw.randint(1, 50), draw.choice([0.0, 0.01, 0.05, 0.07]), draw.uniform(-3, 3), draw.randint(0, 6)
        out.append((float(a) if draw.random() >= hole else None, b, c, d, a * 900 * (1 + b) + 400 * c * d + draw.gauss(0, 500)))
    return spark.createDataFrame(out, "a double, b double, c double, d long, y double").repartition(parts).localCheckpoint()


def fitted(rows, params):
    return ML.gbt(params, "y", 42).fit(ML.assemble(rows, FEATURES).select("features", "y")).featureImportances.toArray()


@pytest.mark.parametrize(
    ("n", "parts", "params"),
    [
        (12_000, 3, {"n_estimators": 4, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8}),
        (30_000, 2, {"n_estimators": 3, "max_depth": 4, "subsample": 0.5, "min_child_weight": 20}),
        (700, 1, {"n_estimators": 3, "max_depth": 3, "gamma": 1000.0}),
    ],
)
def test_trees_from_cells_are_those_from_rows(spark, n, parts, params, monkeypatch):
    rows = rows_of(spark, n, parts, hole=0.1)
    expected = fitted(rows, params)
    assert np.allclose(boosting.importances(rows, FEATURES, ML.gbt(params, "y", 42)), expected, atol=1e-9)
    monkeypatch.setattr(boosting, "SUMS", 1)  # a pass per tree
    monkeypatch.setattr(boosting, "PIECE", 100)
    assert np.allclose(boosting.importances(rows, FEATURES, ML.gbt(params, "y", 42)), expected, atol=1e-9)
    monkeypatch.setattr(boosting, "CELLS", 10)
    assert boosting.importances(rows, FEATURES, ML.gbt(params, "y", 42)) is None


def test_importance_does_not_read_the_rows_for_every_level(spark):
    rows = rows_of(spark, 2_000, 2)
    spark.sparkContext.setJobGroup("importance", "jobs of a fit")
    try:
        found = ML.importance(rows, FEATURES, "y", 2).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("importance")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["feature"] for r in found][0] == "a" and len(jobs) < 20  # 100 trees of 5 levels: over 500 when each reads them


def test_importance_where_cells_do_not_serve(spark):
    rows = rows_of(spark, 400, 1)
    few = {"n_estimators": 2, "max_depth": 3, "colsample_bytree": 0.5}
    found = {r["feature"]: r["importance"] for r in ML.importance(rows, FEATURES, "y", 4, params=few).collect()}
    assert boosting.importances(rows, FEATURES, ML.gbt(few, "y")) is None and np.allclose([found[f] for f in FEATURES], fitted(rows, few))
    assert boosting.importances(rows.selectExpr("*", "if(d = 3, null, y) z").drop("y").withColumnRenamed("z", "y"), FEATURES, ML.gbt(few | {"colsample_bytree": 1.0}, "y")) is None
    assert boosting.importances(rows.where("false"), FEATURES, ML.gbt({}, "y")) is None
    flat = boosting.importances(rows.selectExpr("a", "b", "c", "d", "0.1D y"), FEATURES, ML.gbt({"n_estimators": 3}, "y"))
    assert flat.tolist() == [0.0] * 4


def test_draws_run_on_as_one_generator():
    tables, rate = boosting._tables(), 0.8
    draws = boosting.Draws(45, rate, *tables)
    made = np.concatenate([draws.take().T.ravel() for _ in range(2)])
    chances = boosting._chances(boosting._start(45))
    assert made.tolist() == [next(chances) < rate for _ in range(len(made))] and math.isclose(made.mean(), rate, abs_tol=0.005)
