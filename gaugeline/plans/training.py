"""Feature building, fitted pipelines, walk-forward evaluation and the event-window case on a wide frame."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import schema as S
from gaugeline.functions import metrics as M
from gaugeline.operators import encode as E
from gaugeline.operators import linear as LS
from gaugeline.operators import models as ML
from gaugeline.operators.chunks import matched, with_series_index
from gaugeline.operators.clean import end_cut
from gaugeline.operators.encode import calendar_features, encode
from gaugeline.operators.evaluate import RunLog, case_scores, score, summarise
from gaugeline.operators.impute import impute_wide
from gaugeline.operators.reshape import predictions_wide
from gaugeline.operators.splits import expanding_columns, walk_forward_columns
from gaugeline.operators.windows import engineer, horizon_targets
from gaugeline.session import checkpointed, shared_folder


def prepare(wide: DataFrame, ts: str, target: str, end_day: str | None = None) -> DataFrame:
    """Rows with a target, up to the last day, the target as log(1 + y), and the row position ``idx``."""
    kept = end_cut(wide.na.drop(subset=[target]), ts, end_day)
    logged = kept.withColumn(target, F.log1p(target))
    return with_series_index(logged, [], ts)


def add_features(
    rows: DataFrame,
    ts: str,
    lags: Sequence[int] = S.LAGS,
    windows: Sequence[int] = S.ROLLING_WINDOWS,
    sums: Sequence[int] = S.SUM_WINDOWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Lag, rolling and sum columns ``<kind>_<size>_<column>`` for every eligible column.

    Features are made in long form, so the work is split by column and by chunk of rows; the wide frame appears once,
    at the end, and joins back on the row position.
    """
    columns = [c for c in (columns or S.feature_columns(rows.schema)) if c != "idx"]
    # Read for the long form and again for the join.
    rows = checkpointed(rows)
    long = rows.select("idx", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["idx"], columns, "name", "value")
    made = engineer(long, ["name"], "idx", ["value"], lags, windows, sums)
    kinds = [c for c in made.columns if c.startswith(S.ENGINEERED_PREFIXES)]
    wide = made.groupBy("idx").pivot("name", columns).agg(*[F.first(k).alias(k) for k in kinds])
    renamed = [F.col(f"`{c}_{k}`").alias(f"{k.removesuffix('value')}{c}") for c in columns for k in kinds]
    return rows.join(wide.select("idx", *renamed), "idx")


def with_horizon(rows: DataFrame, target: str, step: int) -> DataFrame:
    """``y`` the target ``step`` rows ahead; rows without it go, and positions stay dense because they are the last ones."""
    return horizon_targets(rows, [], "idx", target, [step])


def as_predictions(rows: DataFrame, ts: str, model: str, target: str) -> DataFrame:
    """Test rows with ``y`` and ``y_pred`` on the log scale to the prediction layout."""
    return rows.select(
        F.lit(model).alias("model_name"),
        *[c for c in ("fold", "step") if c in rows.columns],
        F.expm1("y").alias("y_true"),
        F.expm1("y_pred").alias("y_pred"),
        F.col("y_pred").alias("y_pred_log"),
        F.lit(target).alias("target_column"),
        F.col(ts).alias("date"),
    )


def preprocess(rows: DataFrame, ts: str, target: str, known: dict[str, Sequence] | None = None) -> DataFrame:
    """One fold's rows imputed per role, encoded with what the training rows show, with calendar columns."""
    carried = [ts, "idx", "step", "fold", "role", "y"]
    body = checkpointed(impute_wide(rows, ts, [c for c in S.imputable_columns(rows.columns) if c not in carried], "role"))
    keep = body.select("idx", "role", F.col(ts).alias("_at"), *[c for c in ("step", "fold", "y") if c in body.columns])
    plain = body.drop(*[c for c in ("step", "fold", "y") if c in body.columns])
    sides = plain.drop("role")
    coded = encode(plain.filter("role = 'train'").drop("role"), sides.withColumn("_idx", F.col("idx")), "_idx", known=known)
    coded = calendar_features(coded.drop("idx").withColumnRenamed("_idx", "idx"), ts)
    return keep.join(coded, "idx").withColumnRenamed("_at", ts)


@dataclass
class Folds:
    """The rows of an evaluation: each once per horizon, with ``y``, what it trains, validates and tests, and the autoregressive terms.

    ``train_from`` is the first fold that trains on a row, ``val_fold`` and ``test_fold`` the one it validates or tests, so no row is
    repeated for the folds that share it. Every model reads these rows, so they are written once.
    """

    rows: DataFrame
    ts: str
    target: str
    steps: list[int]
    folds: int
    features: list[str]
    schema: S.SeriesSchema = S.SeriesSchema()

    def test(self) -> DataFrame:
        return self.rows.where(F.col("test_fold").isNotNull()).withColumn("fold", F.col("test_fold"))

    def parts(self) -> list[tuple[int, int]]:
        return [(s, k) for s in self.steps for k in range(1, self.folds + 1)]

    def spread(self) -> DataFrame:
        """A row per (row, fold, role), for fits that need the rows of a fold together."""
        folds = F.transform(F.sequence(F.col("train_from"), F.lit(self.folds)), lambda k: F.struct(k.alias("fold"), F.lit("train").alias("role")))
        other = [F.struct(F.col(f"{r}_fold").alias("fold"), F.lit(r).alias("role")) for r in ("val", "test")]
        trained = F.when(F.col("train_from").isNotNull(), folds).otherwise(F.array().cast("array<struct<fold:int,role:string>>"))
        every = F.concat(trained, F.array(*other))
        kept = [self.ts, "idx", "step", "y", *self.features]
        return self.rows.select(*kept, F.inline(every)).where(F.col("fold").isNotNull())

    @cached_property
    def encoded(self) -> tuple[DataFrame, E.Encoder]:
        """The rows of every (step, fold) imputed per role and encoded by what its training rows show, with their vector.

        One plan for all of them, written partitioned by (step, fold): each fit reads its own files.
        """
        spark = self.rows.sparkSession
        folder = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}"
        spread = self.spread().withColumn("_part", F.concat_ws("|", "step", "fold", "role"))
        carried = [self.ts, "idx", "step", "fold", "role", "y", "_part"]
        columns = [c for c in S.imputable_columns(spread.columns) if c not in carried]
        body = checkpointed(impute_wide(spread, self.ts, columns, "_part").drop("_part"))
        numeric, coded = E.routed(body.drop(*carried), None, (), self.schema)
        by = ["step", "fold"]
        encoder = E.fit_encoder(body.where("role = 'train'"), numeric, coded, by, self.schema)
        encoder.save(f"{folder}/encoder")
        encoder = E.Encoder.load(spark, f"{folder}/encoder")
        dated = encoder.apply(body, "_coded").select(*carried[:-1], "_coded", F.col(self.ts).alias("_at"))
        dated = calendar_features(dated, "_at")
        cycles = [c for c in dated.columns if c not in (*carried, "_coded")]
        ready = VectorAssembler(inputCols=["_coded", *cycles], outputCol="features").transform(dated)
        ready.select(*carried[:-1], "features").write.partitionBy("step", "fold").parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        self.names = [*encoder.names(), *cycles]
        return rows, encoder

    names: list[str] = field(default_factory=list)


Model = Callable[[Folds], DataFrame]


def walk_forward_folds(
    rows: DataFrame, ts: str, target: str, steps: Sequence[int], folds: int, embargo: int = 0, order: int = 3, season: int = ML.SEASON, schema: S.SeriesSchema = S.SeriesSchema()
) -> Folds:
    """All horizons from one pass over the rows; every horizon uses blocks of the longest one."""
    features = [c for c in rows.columns if c not in (ts, "idx")]
    made = ML.arx_rows(rows, [], "idx", target, steps, order, season)
    return Folds(checkpointed(walk_forward_columns(made, folds, max(steps), embargo)), ts, target, list(steps), folds, features, schema)


def event_folds(
    rows: DataFrame, ts: str, target: str, steps: Sequence[int], start: str, end: str, order: int = 3, season: int = ML.SEASON, schema: S.SeriesSchema = S.SeriesSchema()
) -> Folds:
    """One fold per horizon: tests the event, validates on the last rows before it, trains on the rest before it."""
    features = [c for c in rows.columns if c not in (ts, "idx")]
    made = ML.arx_rows(rows, [], "idx", target, steps, order, season)
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    made = made.where(F.col(ts) < hi)
    known = made.where(F.col(ts) < lo).groupBy("step").agg((F.max("idx") + 1).alias("_known"))
    tested = F.col(ts) >= lo
    made = matched(made, known, ["step"])
    late = F.col("idx") >= F.col("_known") - max(steps)
    made = made.withColumns({
        "train_from": F.when(~tested & ~late, 1), "val_fold": F.when(~tested & late, 1), "test_fold": F.when(tested, 1),
    })
    return Folds(checkpointed(made.drop("_known")), ts, target, list(steps), 1, features, schema)


def mean_model() -> Model:
    """The mean of the training rows of each (step, fold)."""

    def run(f: Folds) -> DataFrame:
        means = ML.fold_means(f.rows, f.folds).withColumnRenamed("y_mean", "y_pred")
        return matched(f.test(), means, ["step", "fold"])

    return run


def seasonal_model() -> Model:
    """The target as many whole seasons back as reach the row."""
    return lambda f: f.test().withColumn("y_pred", F.col("seasonal"))


def arx_model(order: int = 3, exog: int = 10, log: Callable[[DataFrame], None] | None = None) -> Model:
    """Seasonal autoregression of the change over the horizon, with the ``exog`` features of the highest F on the training rows.

    Fitted for all (step, fold) in two reads of the rows: one for the F statistics, one for the normal equations. Where
    they are singular the features go, then all terms but the last change. ``log`` is given the table of fits.
    """
    terms = ML.arx_terms(order)

    def run(f: Folds) -> DataFrame:
        numeric = [c for c, k in f.rows.select(*f.features).dtypes if k in ("double", "float", "int", "bigint") and c != f.target]
        chosen: dict[tuple[int, int], list[str]] = {p: [] for p in f.parts()}
        if exog and numeric:
            found = LS.scores(f.rows, [LS.Part(s, k, tuple(terms), tuple(numeric)) for s, k in f.parts()], "dy")
            rank = Window.partitionBy("step", "fold").orderBy(F.desc("f"), "feature")
            best = found.where(F.col("f").isNotNull()).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= exog)
            for r in best.orderBy("step", "fold", "place").collect():  # at most ``exog`` names per model
                chosen[r["step"], r["fold"]].append(r["feature"])
        parts = [LS.Part(s, k, tuple(terms), tuple(c)) for (s, k), c in chosen.items()]
        models = checkpointed(LS.fit(f.rows, parts, "dy", [terms, terms[:1]]))
        if log:
            log(models)
        used = sorted({c for names in chosen.values() for c in names})
        made = LS.predict(f.test(), models, [*terms, *used], "_change")
        return made.withColumn("y_pred", F.col(f.target) + F.col("_change"))

    return run


@dataclass
class Fitted:
    """A fitted pipeline of one (step, fold): which places of the vector the model reads, and the model."""

    step: int
    fold: int
    model: PipelineModel
    best: int | None = None

    @property
    def places(self) -> list[int]:
        return [int(i) for i in self.model.stages[0].getIndices()]

    def save(self, folder: str) -> None:
        self.model.write().overwrite().save(f"{folder}/step={self.step}/fold={self.fold}")

    @staticmethod
    def load(folder: str, step: int, fold: int) -> Fitted:
        return Fitted(step, fold, PipelineModel.load(f"{folder}/step={step}/fold={fold}"))

    def predict(self, encoded: DataFrame, name: str = "y_pred") -> DataFrame:
        """Test rows of its own (step, fold) with the prediction."""
        mine = encoded.where((F.col("step") == self.step) & (F.col("fold") == self.fold) & (F.col("role") == "test"))
        return self.model.transform(mine).drop("features", "_chosen").withColumnRenamed("prediction", name)


def fit_trees(encoded: DataFrame, names: Sequence[str], step: int, fold: int, params: dict | None = None, select: int | None = 50, seed: int = 42) -> Fitted:
    """Boosted trees of one (step, fold) on its ``select`` most important features, stopped early on its validation rows.

    The importance comes from a fit of its own on the training rows; with no more features than ``select`` there is nothing to choose.
    """
    mine = encoded.where((F.col("step") == step) & (F.col("fold") == fold))
    places = list(range(len(names)))
    if select is not None and len(names) > select:
        with ML.kept(mine.where("role = 'train'").select("features", "y")) as rows:
            weights = ML.gbt(ML.SELECTOR, "y", seed).fit(rows).featureImportances.toArray()
        places = sorted(sorted(places, key=lambda i: (-weights[i], i))[:select])
    slicer = VectorSlicer(inputCol="features", outputCol="_chosen", indices=places)
    trees = ML.gbt(params, "y", seed, "_val").setFeaturesCol("_chosen")
    with ML.kept(mine.where("role <> 'test'").select("features", "y", (F.col("role") == "val").alias("_val"))) as rows:
        return Fitted(step, fold, Pipeline(stages=[slicer, trees]).fit(rows))


def gbt_fit(params: dict | None = None, select: int | None = 50, folder: str | None = None, parallelism: int = 8, tune: Callable[[Folds, int, int], dict] | None = None) -> Model:
    """Boosted trees, a fitted pipeline per (step, fold): saved under ``folder``, loaded from there and applied to the test rows.

    The fits are Spark jobs side by side. ``tune`` chooses the parameters of a (step, fold) before its fit.
    """

    def run(f: Folds) -> DataFrame:
        rows, _ = f.encoded
        place = folder or f"{shared_folder(rows.sparkSession)}/models-{uuid.uuid4().hex}"

        def one(part: tuple[int, int]) -> None:
            chosen = {**(params or {}), **tune(f, *part)} if tune else params
            fit_trees(rows, f.names, *part, chosen, select).save(place)

        with ThreadPool(parallelism) as pool:
            pool.map(one, f.parts())
        made = [Fitted.load(place, *part).predict(rows) for part in f.parts()]
        return functools.reduce(DataFrame.unionByName, made)

    return run


def inner_folds(f: Folds, step: int, fold: int, splits: int = 3, gap: int = 24) -> Folds:
    """Expanding folds of the training rows of one (step, fold), with their own preprocessing."""
    rows = f.rows.where((F.col("step") == step) & (F.col("train_from") <= fold)).drop("train_from", "val_fold", "test_fold")
    return Folds(checkpointed(expanding_columns(rows, splits, gap)), f.ts, f.target, [step], splits, f.features, f.schema)


def sweep_folds(inner: Folds, tries: Sequence[dict], select: int | None = None, parallelism: int = 8) -> DataFrame:
    """Test predictions (candidate, fold, idx, y, y_pred) of every parameter set on every fold, written.

    The rows of a fold are imputed and encoded once, from its training rows alone, and all candidates read that copy. The
    fits are Spark jobs side by side; nothing of them stays on the driver but the trees.
    """
    rows, _ = inner.encoded
    step = inner.steps[0]
    folder = f"{shared_folder(rows.sparkSession)}/sweep-{uuid.uuid4().hex}"

    def one(job: tuple[int, int]) -> None:
        i, fold = job
        made = fit_trees(rows, inner.names, step, fold, tries[i], select).predict(rows)
        made.select("idx", "y", "y_pred").write.mode("overwrite").parquet(f"{folder}/candidate={i}/fold={fold}")

    with ThreadPool(parallelism) as pool:
        pool.map(one, [(i, k) for i in range(len(tries)) for k in range(1, inner.folds + 1)])
    return rows.sparkSession.read.schema("idx long, y double, y_pred double, candidate int, fold int").parquet(folder)


def sweep_scores(preds: DataFrame, tries: Sequence[dict]) -> DataFrame:
    """(candidate, params, rmse): the mean over the folds of the error on their test rows, best first."""
    errors = preds.groupBy("candidate", "fold").agg(M.rmse("y", "y_pred").alias("rmse"))
    texts = preds.sparkSession.createDataFrame([(i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(tries)], "candidate int, params map<string,string>")
    return errors.groupBy("candidate").agg(F.avg("rmse").alias("rmse")).join(texts, "candidate").orderBy("rmse", "candidate")


def tuner(trials: int = 10, space: dict | None = None, splits: int = 3, gap: int = 24, seed: int = 42) -> Callable[[Folds, int, int], dict]:
    """For ``gbt_fit``: the parameters with the lowest error over expanding folds of the training rows."""

    def tune(f: Folds, step: int, fold: int) -> dict:
        tries = ML.candidates(trials, seed, space)
        found = sweep_scores(sweep_folds(inner_folds(f, step, fold, splits, gap), tries), tries)
        best = found.agg(F.min_by("candidate", F.struct("rmse", "candidate")).alias("i")).first()["i"]
        return tries[best]

    return tune


def predictions(f: Folds, models: dict[str, Model]) -> DataFrame:
    made = [as_predictions(run(f), f.ts, name, f.target) for name, run in models.items()]
    return functools.reduce(DataFrame.unionByName, made)


def general_mode(
    rows: DataFrame, ts: str, target: str, steps: Sequence[int], folds: int, fits: dict[str, Model] | None = None, embargo: int = 0,
    schema: S.SeriesSchema = S.SeriesSchema(), log: RunLog | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fold summary and test predictions over all horizons and folds of the mean baseline (``DUMMY``) and of ``fits``.

    With ``log`` the scores of every (model, step, fold) are appended to it.
    """
    f = walk_forward_folds(rows, ts, target, steps, folds, embargo, schema=schema)
    preds = predictions(f, {"DUMMY": mean_model(), **(fits or {})})
    scored = score(preds)
    if log:
        scored = checkpointed(scored)
        log.append(scored, "general")
    return summarise(scored), preds


def case_mode(
    rows: DataFrame, ts: str, target: str, steps: Sequence[int], start: str, end: str, fits: dict[str, Model] | None = None,
    schema: S.SeriesSchema = S.SeriesSchema(), log: RunLog | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of an event window (named ``_CASE_STUDY``), long predictions, and predictions wide by model and horizon."""
    f = event_folds(checkpointed(rows), ts, target, steps, start, end, schema=schema)
    preds = predictions(f, {"DUMMY": mean_model(), **(fits or {})}).drop("fold")
    scored = case_scores(preds)
    if log:
        scored = checkpointed(scored)
        log.append(scored.withColumn("fold", F.lit(None).cast("int")), "case_study")
    return scored, preds, predictions_wide(preds, ["DUMMY", *(fits or {})], steps)


def feature_snapshot(rows: DataFrame, ts: str, model: str, target: str) -> DataFrame:
    """The processed columns of each split with target, model and split labels."""
    made = preprocess(rows, ts, target)
    return made.withColumnRenamed("y", "target").withColumn("model_name", F.lit(model)).withColumnRenamed("role", "split")
