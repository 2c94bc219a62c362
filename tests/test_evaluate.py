import math

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import evaluate as EV
from gaugeline.operators import models as ML

SCORES = "model_name string, target_column string, step int, rmse double, mae double"


def test_best_so_far(spark):
    now = spark.createDataFrame([("A", "y", 1, 5.0, 1.0), ("B", "y", 1, 5.0, 2.0), ("C", "y", 1, float("nan"), 3.0), ("D", "y", 1, 4.0, 4.0), ("N", "y", 1, 9.0, 9.0)], SCORES)
    old = spark.createDataFrame(
        [("A_BEST", "y", 1, 6.0, 10.0), ("B_BEST", "y", 1, 5.0, 20.0), ("C_BEST", "y", 1, 7.0, 30.0), ("D_BEST", "y", 2, 1.0, 40.0), ("Z_BEST", "y", 1, 2.0, 50.0), ("A", "y", 1, 0.0, 0.0)],
        SCORES,
    )
    got = {(r["model_name"], r["step"]): r["mae"] for r in EV.best_so_far(now, old).collect() if r["model_name"].endswith("_BEST")}
    assert got == {("A_BEST", 1): 1.0, ("B_BEST", 1): 20.0, ("C_BEST", 1): 30.0, ("D_BEST", 1): 4.0, ("D_BEST", 2): 40.0, ("Z_BEST", 1): 50.0, ("N_BEST", 1): 9.0}
    assert EV.best_so_far(now, None).count() == 10
    loose = EV.best_so_far(now, old, ["model_name"]).filter("model_name = 'D_BEST'").collect()
    assert [r["rmse"] for r in loose] == [1.0]


def test_best_run(spark):
    runs = EV.run_row(spark, "m", {"depth": 3, "note": None, "x": "nan"}, {"rmse": 2.0}).unionByName(
        EV.run_row(spark, "m", {"depth": 5}, {"rmse": 3.0})).unionByName(EV.run_row(spark, "m", {"depth": 9}, {"other": 0.0})).unionByName(
        EV.run_row(spark, "n", {"depth": 7}, {"rmse": math.nan}))
    low = EV.best_run(runs, "rmse", "min").collect()
    assert [(r["model"], r["params"], r["rmse"]) for r in low] == [("m", {"depth": "3"}, 2.0)]
    assert EV.best_run(runs, "rmse", "max").first()["params"] == {"depth": "5"}


def test_fold_summary(spark):
    rows = [("A", "y", 1, k, float(k), 1.0, 1.0, 1.0, None) for k in (1, 2, 3)]
    got = EV.summarise(spark.createDataFrame(rows, "model_name string, target_column string, step int, fold int, rmse double, mae double, nse double, r2 double, kge double")).first()
    assert (got["rmse"], got["rmse_std"], got["mae_std"], got["kge"]) == (2.0, 1.0, 0.0, None)


def test_case_names(spark):
    preds = spark.createDataFrame([("A", "y", 1, 1.0, 1.0), ("A", "y", 1, 2.0, 2.0)], "model_name string, target_column string, step int, y_true double, y_pred double")
    row = EV.case_scores(preds).first()
    assert (row["model_name"], row["rmse"], row["nse"], row["r2"]) == ("A_CASE_STUDY", 0.0, 1.0, 1.0)


def test_least_squares_recovers_coefficients(spark):
    df = spark.range(400).select(F.lit("s").alias("s"), F.col("id").alias("idx"), (F.sin(F.col("id") / 5) * 10 + F.col("id") * 0.1).alias("y"))
    rows = ML.arx_frame(df, ["s"], "idx", "y", step=1, order=2)
    model = ML.fit_arx(rows, ["ar_1", "ar_2"])
    truth = 2 * math.cos(1 / 5)
    terms = {r["term"]: r["value"] for r in ML.coefficients(model, ["ar_1", "ar_2"], rows).collect()}
    assert terms["ar_1"] == pytest.approx(truth, abs=1e-3) and terms["ar_2"] == pytest.approx(-1, abs=1e-3)
    with pytest.raises(ValueError):
        ML.arx_frame(df, ["s"], "idx", "y", step=30)


def test_f_scores(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("y"), (F.col("id") + F.randn(1) * 5).alias("close"), F.randn(2).alias("noise"), F.lit(1.0).alias("flat"))
    top = [r["feature"] for r in ML.top_features(df, ["noise", "close", "flat"], "y", 3).collect()]
    assert top[0] == "close" and top[-1] == "flat"


def test_candidates_stay_in_range():
    for one in ML.candidates(50, seed=1):
        for name, (low, high, _) in ML.SEARCH_SPACE.items():
            assert low <= one[name] <= high * (1 + 1e-12)
        assert one["n_estimators"] % 100 == 0
    assert ML.candidates(3, 5) == ML.candidates(3, 5)


def test_sweep_orders_by_error(spark):
    rows = spark.range(60).select(F.col("id").cast("double").alias("y"), (F.col("id") % 2 + 1).cast("int").alias("fold"), F.when(F.col("id") < 40, "train").otherwise("test").alias("role"))
    got = ML.sweep(rows, [{"c": 100.0}, {"c": 50.0}], [1, 2], lambda train, p: lambda test: test.withColumn("y_pred", F.lit(p["c"]))).collect()
    assert [r["params"]["c"] for r in got] == ["50.0", "100.0"] and got[0]["rmse"] < got[1]["rmse"]


def test_a_missing_best_score_stays(spark):
    from gaugeline.operators.evaluate import best_so_far

    now = spark.createDataFrame([("m", "y", 1, 3.0)], "model_name string, target_column string, step int, rmse double")
    old = spark.createDataFrame([("m_BEST", "y", 1, float("nan"))], now.schema)
    kept = best_so_far(now, old).filter("model_name = 'm_BEST'").first()
    assert kept["rmse"] != kept["rmse"]
