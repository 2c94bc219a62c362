"""Baselines, regression and boosted trees as distributed fits, feature selection and parameter search."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from gaugeline.functions import metrics as M
from gaugeline.functions.expr import ratio
from gaugeline.operators import boosting
from gaugeline.operators.chunks import matched, over_chunks

SEASON = 24

# --- Fixed values: search ranges of the boosted trees (low, high, kind) ----------------------------------------------
SEARCH_SPACE = {
    "n_estimators": (100, 3000, "step100"),
    "learning_rate": (0.001, 0.1, "log"),
    "max_depth": (3, 10, "int"),
    "min_child_weight": (1, 10, "int"),
    "subsample": (0.5, 1.0, "float"),
    "colsample_bytree": (0.5, 1.0, "float"),
    "gamma": (0.0, 10.0, "float"),
}
# Of trees that grow by leaves: depth follows from the leaves; a penalty on weights has no counterpart here.
LEAF_SEARCH_SPACE = {
    "n_estimators": (100, 3000, "step100"),
    "learning_rate": (0.001, 0.1, "log"),
    "max_depth": (3, 10, "int"),
    "num_leaves": (20, 300, "int"),
    "min_child_samples": (5, 100, "int"),
    "colsample_bytree": (0.5, 0.8, "step0.05"),
    "subsample": (0.5, 1.0, "float"),
}
SELECTOR = {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8}


def mean_baseline(rows: DataFrame, by: Sequence[str], y: str = "y", role: str = "role") -> DataFrame:
    """Test rows with ``y_pred`` the mean of the training rows of their group."""
    fitted = rows.groupBy(*by).agg(F.avg(F.when(F.col(role) == "train", F.col(y))).alias("y_pred"))
    return matched(rows.filter(F.col(role) == "test"), fitted, list(by))


def fold_means(rows: DataFrame, folds: int, y: str = "y") -> DataFrame:
    """(step, fold, y_mean) of the training rows of every fold: rows are summed up once per first fold, folds add the sums."""
    sums = rows.where(F.col("train_from").isNotNull()).groupBy("step", "train_from").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    each = sums.withColumn("fold", F.explode(F.sequence("train_from", F.lit(folds))))
    return each.groupBy("step", "fold").agg((F.sum("_s") / F.sum("_n")).alias("y_mean"))


def seasonal_naive(df: DataFrame, keys: Sequence[str], idx: str, y: str, season: int = SEASON) -> DataFrame:
    """``y_pred`` is the value one season earlier."""

    def build(spread: DataFrame, order: WindowSpec) -> DataFrame:
        return spread.withColumn("y_pred", F.lag(y, season).over(order))

    return over_chunks(df, keys, idx, build, before=season)


def f_scores(df: DataFrame, features: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """(feature, f): F statistic of the simple regression of ``y`` on each feature, all features in one aggregation."""
    both = [F.count_if(F.col(f).isNotNull() & F.col(y).isNotNull()) for f in features]
    wide = df.groupBy(*by).agg(
        *[F.struct(M.pearson(f, y).alias("r"), n.alias("n")).alias(f) for f, n in zip(features, both, strict=True)]
    )
    long = wide.unpivot(list(by), list(features), "feature", "_s")
    square = F.col("_s.r") * F.col("_s.r")
    return long.select(*by, "feature", (ratio(square, 1 - square) * (F.col("_s.n") - 2)).alias("f"))


def top_features(df: DataFrame, features: Sequence[str], y: str, k: int) -> DataFrame:
    """The ``k`` features with the highest F."""
    return f_scores(df, features, y).orderBy(F.desc_nulls_last("f"), "feature").limit(k)


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Feature vector; missing values count as 0."""
    full = df.na.fill(0, subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(full)


def gbt(params: dict | None = None, y: str = "y", seed: int = 42, validation: str | None = None) -> GBTRegressor:
    """Boosted trees from parameters under their usual names; ``validation`` marks rows that stop training early."""
    params = params or {}
    depth = int(params.get("max_depth", 5))
    if "num_leaves" in params:
        depth = min(depth, max(1, math.ceil(math.log2(int(params["num_leaves"])))))
    model = GBTRegressor(
        labelCol=y,
        maxIter=int(params.get("n_estimators", 100)),
        maxDepth=depth,
        stepSize=float(params.get("learning_rate", 0.1)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(params.get("colsample_bytree", "all")),
        minInstancesPerNode=int(params.get("min_child_weight", params.get("min_child_samples", 1))),
        minInfoGain=float(params.get("gamma", 0.0)),
        seed=seed,
    )
    return model.setValidationIndicatorCol(validation) if validation else model


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Training rows held for the passes of a fit; lost blocks are computed again."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def fit_gbt(rows: DataFrame, features: Sequence[str], params: dict | None = None, y: str = "y", role: str = "role", seed: int = 42) -> GBTRegressionModel:
    """Fit on ``train`` rows with early stopping on ``val`` rows."""
    used = rows.filter(F.col(role).isin("train", "val")).withColumn("_val", F.col(role) == "val")
    with kept(assemble(used, features).select("features", y, "_val")) as ready:
        return gbt(params, y, seed, "_val").fit(ready)


def predict(model, rows: DataFrame, features: Sequence[str], name: str = "y_pred") -> DataFrame:
    scored = model.transform(assemble(rows, features))
    return scored.select(*rows.columns, F.col("prediction").alias(name))


def importance(
    rows: DataFrame, features: Sequence[str], y: str, k: int = 50, seed: int = 42, params: dict | None = None
) -> DataFrame:
    """(feature, importance) of the ``k`` features boosted trees use most.

    Trees over few features grow from sums per cell of their bins, in one pass over the rows; others from a pass for every level.
    """
    trees = gbt(params or SELECTOR, y, seed)
    weights = boosting.importances(rows, features, trees)
    if weights is None:
        with kept(assemble(rows, features).select("features", y)) as ready:
            weights = trees.fit(ready).featureImportances.toArray()
    ranked = [(f, float(w)) for f, w in zip(features, weights, strict=True)]
    table = rows.sparkSession.createDataFrame(ranked, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def arx_frame(df: DataFrame, keys: Sequence[str], idx: str, y: str, step: int, order: int = 3, season: int = SEASON) -> DataFrame:
    """Differences for a seasonal autoregression: ``ar_1..ar_<order>``, ``sar_1`` and the response ``dy``.

    ``dy`` is the change of ``y`` over the horizon, ``ar_i`` the i-th last change and ``sar_1`` the change over the
    same horizon one season earlier. Moving-average terms are not part of the model.
    """

    def build(spread: DataFrame, o: WindowSpec) -> DataFrame:
        back = [F.lag(y, i).over(o).alias(f"_b{i}") for i in range(order + 1)]
        other = [F.lead(y, step).over(o).alias("_next"), F.lag(y, season).over(o).alias("_s0"), F.lag(y, season - step).over(o).alias("_s1")]
        wide = spread.select("*", *back, *other)
        ar = [(F.col(f"_b{i}") - F.col(f"_b{i + 1}")).alias(f"ar_{i + 1}") for i in range(order)]
        sar = (F.col("_s1") - F.col("_s0")).alias("sar_1")
        return wide.select(*spread.columns, *ar, sar, (F.col("_next") - F.col(y)).alias("dy"))

    if step > season:
        raise ValueError("the horizon must not exceed the season")
    return over_chunks(df, keys, idx, build, before=max(season, order + 1), after=step)


def arx_terms(order: int = 3) -> list[str]:
    return [*(f"ar_{i + 1}" for i in range(order)), "sar_1"]


def arx_rows(df: DataFrame, keys: Sequence[str], idx: str, y: str, steps: Sequence[int], order: int = 3, season: int = SEASON) -> DataFrame:
    """Each row once per horizon with ``step``, the target ``y`` that many rows ahead, its change ``dy``, ``seasonal`` (the target
    a season before it, of as many seasons as reach back to the row) and the terms of ``arx_terms``.

    ``ar_i`` is the i-th last change, ``sar_1`` the change over the same horizon those seasons earlier. All horizons come
    from one pass over the ordered rows; rows without a target ahead go.
    """
    back = [-(-s // season) * season for s in steps]

    def build(spread: DataFrame, o: WindowSpec) -> DataFrame:
        at = lambda n: F.lag(y, n).over(o) if n >= 0 else F.lead(y, -n).over(o)
        ar = [(at(i) - at(i + 1)).alias(f"ar_{i + 1}") for i in range(order)]
        ahead = [
            F.struct(
                F.lit(s).alias("step"), at(-s).alias("y"), (at(-s) - F.col(y)).alias("dy"), at(b - s).alias("seasonal"), (at(b - s) - at(b)).alias("sar_1")
            )
            for s, b in zip(steps, back, strict=True)
        ]
        return spread.select("*", *ar, F.array(*ahead).alias("_ahead"))

    made = over_chunks(df, keys, idx, build, before=max(order + 1, *back), after=max(steps))
    names = [c for c in made.columns if c != "_ahead"]
    return made.select(*names, F.inline("_ahead")).where(F.col("y").isNotNull())


def fit_arx(rows: DataFrame, features: Sequence[str], response: str = "dy") -> LinearRegressionModel:
    """Least squares on complete rows."""
    complete = rows.na.drop(subset=[*features, response])
    with kept(assemble(complete, features).select("features", response)) as ready:
        return LinearRegression(labelCol=response, solver="normal", standardization=False, regParam=0.0).fit(ready)


def coefficients(model: LinearRegressionModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    rows = [("intercept", float(model.intercept)), *zip(features, (float(c) for c in model.coefficients), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, value double")


def candidates(n: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """``n`` random parameter sets from the search ranges."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        one = {}
        for name, (low, high, kind) in (space or SEARCH_SPACE).items():
            if kind == "log":
                one[name] = math.exp(draw.uniform(math.log(low), math.log(high)))
            elif kind == "int":
                one[name] = draw.randint(low, high)
            elif kind.startswith("step"):
                size = float(kind.removeprefix("step"))
                value = low + size * draw.randint(0, round((high - low) / size))
                one[name] = int(value) if isinstance(low, int) else round(value, 10)
            else:
                one[name] = draw.uniform(low, high)
        out.append(one)
    return out


def sweep(
    rows: DataFrame,
    tries: Sequence[dict],
    folds: Sequence[int],
    fit: Callable[[DataFrame, dict], Callable[[DataFrame], DataFrame]],
    y: str = "y",
    parallelism: int = 4,
) -> DataFrame:
    """(candidate, params, rmse): mean validation RMSE of each parameter set over the inner folds, best first.

    ``rows`` carries ``fold`` and ``role``. ``fit(train, params)`` fits everything, preprocessing included, on the
    training rows of a fold and returns a function that adds ``y_pred``. Fits run as Spark jobs side by side; the driver
    keeps one number per fit.
    """
    spark = rows.sparkSession
    jobs = [(i, k) for i in range(len(tries)) for k in folds]

    def one(job: tuple[int, int]) -> tuple[int, float | None]:
        i, k = job
        part = rows.filter(F.col("fold") == k)
        apply = fit(part.filter("role = 'train'"), tries[i])
        scored = apply(part.filter("role = 'test'")).agg(M.rmse(y, "y_pred").alias("rmse"))
        return i, scored.first()["rmse"]

    with ThreadPool(parallelism) as pool:
        found = pool.map(one, jobs)
    scores = spark.createDataFrame([(i, r) for i, r in found], "candidate int, rmse double")
    texts = [(i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(tries)]
    table = spark.createDataFrame(texts, "candidate int, params map<string,string>")
    return scores.groupBy("candidate").agg(F.avg("rmse").alias("rmse")).join(table, "candidate").orderBy("rmse")
