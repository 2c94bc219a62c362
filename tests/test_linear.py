import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import linear as L
from gaugeline.operators import splits


def frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(1e6, 3, n), rng.normal(0, 1, n), rng.normal(5, 2, n)
    y = 2 * (a - 1e6) - b + 0.5 * c + rng.normal(0, 0.1, n)
    rows = []
    for i in range(n):
        hole = None if i % 6 == 0 else float(c[i])
        rows.append((1 + i % 2, None if i > n - 20 else 1 + i // 150, float(y[i]), None if i % 17 == 0 else float(a[i]), float(b[i]), hole, 4.0))
    return spark.createDataFrame(rows, "step int, train_from int, y double, a double, b double, c double, flat double").repartition(7), rows


def dense(rows, part):
    """Least squares with missing optional terms at their mean."""
    names = {"a": 3, "b": 4, "c": 5, "flat": 6}
    mine = [r for r in rows if r[0] == part.step and r[1] is not None and r[1] <= part.fold and all(r[names[c]] is not None for c in part.required)]
    cols = []
    for c in (*part.required, *part.optional):
        v = np.array([np.nan if r[names[c]] is None else r[names[c]] for r in mine])
        cols.append(np.where(np.isnan(v), np.nanmean(v), v))
    y = np.array([r[2] for r in mine])
    x = np.column_stack(cols)
    w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    return len(mine), w, x.mean(0), y.mean()


def test_fit_equals_a_dense_solution(spark):
    df, rows = frame(spark)
    parts = [L.Part(s, k, ("a", "b"), ("c",)) for s in (1, 2) for k in (1, 2, 3)]
    got = {(r["step"], r["fold"]): r for r in L.fit(df, parts, "y").collect()}
    for p in parts:
        n, w, means, y = dense(rows, p)
        r = got[p.step, p.fold]
        assert (r["n"], r["rank"], r["terms"]) == (n, 0, ["a", "b", "c"])
        assert np.allclose(r["weights"], w, atol=1e-8) and np.allclose(r["means"], means) and r["y_mean"] == pytest.approx(y)


def test_singular_fits_fall_back(spark):
    df, rows = frame(spark)
    df = df.withColumn("twice", F.col("b") * 2 + 1)
    got = L.fit(df, [L.Part(1, 3, ("b", "twice"), ("flat",))], "y", [["b", "twice"], ["b"]]).first()
    assert (got["rank"], got["terms"]) == (2, ["b"])
    few = L.fit(df.where("a is not null").orderBy("b").limit(3), [L.Part(1, 3, ("a", "b"), ("c",)), L.Part(9, 1, ("a",))], "y", [["a"]]).collect()
    assert all(r["terms"] == [] and r["weights"] == [] for r in few) and len(few) <= 1


def test_f_scores_of_every_part(spark):
    df, rows = frame(spark)
    got = {(r["step"], r["fold"], r["feature"]): r["f"] for r in L.scores(df, [L.Part(2, 2, ("a",), ("b", "c", "flat"))], "y").collect()}
    mine = [r for r in rows if r[0] == 2 and r[1] is not None and r[1] <= 2 and r[3] is not None]
    for name, k in (("b", 4), ("c", 5)):
        pairs = np.array([(r[k], r[2]) for r in mine if r[k] is not None])
        square = np.corrcoef(pairs.T)[0, 1] ** 2
        assert got[2, 2, name] == pytest.approx(square / (1 - square) * (len(pairs) - 2), rel=1e-9)
    assert got[2, 2, "flat"] is None


def test_a_missing_term_is_neutral(spark):
    models = spark.createDataFrame([(1, 1, 9, ["a", "b"], [2.0, 3.0], [10.0, 1.0], 100.0, 0), (2, 1, 9, [], [], [], 7.0, 2)], "step int, fold int, " + L.MODEL)
    rows = spark.createDataFrame([(1, 1, 11.0, 2.0), (1, 1, None, 2.0), (2, 1, 5.0, 5.0), (3, 1, 1.0, 1.0)], "step int, fold int, a double, b double")
    got = [r["y_pred"] for r in L.predict(rows, models, ["a", "b"]).orderBy("step", F.col("a").desc()).collect()]
    assert got == [105.0, 103.0, 7.0, None]


@pytest.mark.parametrize("folds,block,embargo", [(3, 20, 0), (4, 7, 5)])
def test_fold_columns_equal_the_repeated_rows(spark, folds, block, embargo):
    rows = spark.range(120).select(F.col("id").alias("idx"), F.explode(F.array(F.lit(1), F.lit(9))).alias("step")).where("idx < 120 - step")
    told = {(r["step"], r["idx"]): r for r in splits.walk_forward_columns(rows, folds, block, embargo).collect()}
    count = 0
    for step in (1, 9):
        for r in splits.walk_forward(rows.where(f"step = {step}"), "idx", folds, block, embargo).collect():
            t = told[step, r["idx"]]
            assert {"train": (t["train_from"] or 99) <= r["fold"], "val": t["val_fold"] == r["fold"], "test": t["test_fold"] == r["fold"]}[r["role"]]
            count += 1
    assert count == sum((folds + 1 - t["train_from"] if t["train_from"] else 0) + (t["val_fold"] is not None) + (t["test_fold"] is not None) for t in told.values())


def test_expanding_columns_equal_the_repeated_rows(spark):
    rows = spark.range(100).withColumnRenamed("id", "idx")
    told = {r["idx"]: r for r in splits.expanding_columns(rows, 3, 10, 0.0).collect()}
    for r in splits.time_series_split(rows, "idx", 3, 10).collect():
        t = told[r["idx"]]
        assert (t["train_from"] or 99) <= r["fold"] if r["role"] == "train" else t["test_fold"] == r["fold"]
    late = splits.expanding_columns(rows, 3, 10, 0.2).where("val_fold is not null").collect()
    assert sorted((r["val_fold"], r["idx"]) for r in late) == [(k, 25 * k - 10 - i) for k in (1, 2, 3) for i in (5, 4, 3, 2, 1)]
    assert all(r["train_from"] == r["val_fold"] + 1 or r["val_fold"] == 3 for r in late)
