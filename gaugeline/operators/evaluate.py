"""Scoring of predictions, fold summaries, best-so-far metrics and the run log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions import metrics as M

SCORES = ("rmse", "mae", "nse", "r2", "kge")
RUNS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def score(preds: DataFrame, by: Sequence[str] = ("model_name", "target_column", "step", "fold"), compat: bool = True) -> DataFrame:
    """All scores of every (model, target, step, fold) in one aggregation."""
    return preds.groupBy(*by).agg(*M.bundle(compat=compat))


def summarise(fold_scores: DataFrame, by: Sequence[str] = ("model_name", "target_column", "step")) -> DataFrame:
    """Mean and sample deviation of each score over the folds."""
    aggs = []
    for s in SCORES:
        aggs += [F.avg(s).alias(s), F.stddev_samp(s).alias(f"{s}_std")]
    return fold_scores.groupBy(*by).agg(*aggs)


def case_scores(preds: DataFrame) -> DataFrame:
    """Scores of an event window, under names ending in ``_CASE_STUDY``."""
    scored = score(preds, ("model_name", "target_column", "step"))
    return scored.withColumn("model_name", F.concat("model_name", F.lit("_CASE_STUDY")))


def best_so_far(current: DataFrame, best: DataFrame | None, keys: Sequence[str] = ("model_name", "target_column", "step")) -> DataFrame:
    """The current rows, and per key the row with the lower RMSE under the name ``<model>_BEST``.

    ``best`` holds earlier ``_BEST`` rows; those of keys not in this run stay. A tie or a missing RMSE keeps the old
    row. ``keys=("model_name",)`` ignores target and step; a run with several rows per key then offers its lowest.
    """
    named = current.withColumn("model_name", F.concat("model_name", F.lit("_BEST")))
    if best is None:
        return current.unionByName(named)
    rest = [c for c in current.columns if c not in keys]
    old = best.filter(F.col("model_name").endswith("_BEST")).select(*keys, F.struct(*rest).alias("_old"))
    order = F.when(~F.isnan("rmse"), F.col("rmse"))
    lowest = F.coalesce(F.min_by(F.struct(*rest), order), F.min(F.struct(*rest)))
    new = named.groupBy(*keys).agg(lowest.alias("_new"))
    better = (F.col("_new.rmse") < F.col("_old.rmse")) & ~F.isnan("_old.rmse")
    take = F.when(F.col("_old").isNull() | better, F.col("_new")).otherwise(F.col("_old"))
    kept = old.join(new, list(keys), "full").withColumn("_row", F.when(F.col("_new").isNull(), F.col("_old")).otherwise(take))
    return current.unionByName(kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]))


def best_run(runs: DataFrame, metric: str, mode: str = "max", by: Sequence[str] = ("model",)) -> DataFrame:
    """Parameters of the best run per model, without missing ones; ``runs`` has map columns ``params`` and ``metrics``."""
    value = F.col("metrics")[metric]
    pick = {"max": F.max_by, "min": F.min_by}[mode]
    present = runs.filter(value.isNotNull() & ~F.isnan(value))
    # Maps do not compare, so the struct of entries makes equal scores resolve the same way each time.
    rank = F.struct(value if mode == "min" else -value, F.to_json("params"))
    best = present.groupBy(*by).agg(F.min_by("params", rank).alias("params"), pick(value, value).alias(metric))
    return best.withColumn("params", F.map_filter("params", lambda k, v: v.isNotNull() & (v != "nan")))


def run_row(spark: SparkSession, model: str, params: dict, metrics: dict) -> DataFrame:
    """One row for the run log, to be appended to its table."""
    text = {k: None if v is None else str(v) for k, v in params.items()}
    return spark.createDataFrame([(model, text, {k: float(v) for k, v in metrics.items()})], RUNS)


@dataclass(frozen=True)
class RunLog:
    """An append-only log of evaluation runs: rows (run_id, mode, model, target_column, step, fold, params, metrics) under ``folder``.

    A run writes its own partitions (run_id, mode) in one go; writing them again, as a retry does, replaces them, so
    nothing is logged twice and no other run is touched.
    """

    folder: str
    run_id: str

    def append(self, scored: DataFrame, mode: str, params: dict[str, dict] | None = None) -> None:
        """Logs the scores of every (model, step, fold), with the parameters of each model."""
        known = [(m, {k: str(v) for k, v in p.items()}) for m, p in (params or {}).items()]
        known = scored.sparkSession.createDataFrame(known, "model string, params map<string,string>")
        metrics = F.map_filter(F.create_map(*[x for s in SCORES for x in (F.lit(s), F.col(s))]), lambda k, v: v.isNotNull())
        rows = scored.withColumnRenamed("model_name", "model").withColumn("metrics", metrics).join(known, "model", "left")
        empty = F.create_map().cast("map<string,string>")
        rows = rows.select(
            F.lit(self.run_id).alias("run_id"), F.lit(mode).alias("mode"), "model", "target_column", "step", "fold", F.coalesce("params", empty).alias("params"), "metrics"
        )
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "mode").parquet(self.folder)

    def read(self, spark: SparkSession) -> DataFrame:
        """Every run logged so far."""
        kinds = "model string, target_column string, step int, fold int, params map<string,string>, metrics map<string,double>, run_id string, mode string"
        return spark.read.schema(kinds).parquet(self.folder)


@dataclass(frozen=True)
class BestTable:
    """The best rows so far, as numbered snapshots under ``folder``: a merge writes the next one whole, readers take the last
    complete one. A merge that dies leaves the last one as it was; one that is repeated changes nothing, since ties keep the old row."""

    folder: str
    keys: tuple[str, ...] = ("model_name", "target_column", "step")

    def latest(self, spark: SparkSession) -> int | None:
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.folder)):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        done = [int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        return max(done, default=None)

    def read(self, spark: SparkSession) -> DataFrame | None:
        last = self.latest(spark)
        return None if last is None else spark.read.parquet(f"{self.folder}/snapshot-{last}")

    def merge(self, current: DataFrame) -> DataFrame:
        spark = current.sparkSession
        last = self.latest(spark)
        merged = best_so_far(current, self.read(spark), self.keys)
        merged.write.mode("overwrite").parquet(f"{self.folder}/snapshot-{(last or 0) + 1}")
        return self.read(spark)
