"""Tables behind the study's charts and data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import schema as S
from gaugeline.functions import metrics as M
from gaugeline.functions.expr import ratio
from gaugeline.operators.chunks import matched, percentiles


def null_percent(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percentage of missing values of the columns that have any, all columns in one aggregation."""
    columns = list(columns or df.columns)
    counted = df.agg(*[(100.0 * F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "percent").filter("percent > 0").orderBy("percent", "column")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs over rows where both are present; one aggregation, r is NULL for constants."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[M.pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"_{i}").alias("r")))
    return wide.select(F.inline(F.array(*rows)))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, remaining) of conditions applied one after the other."""
    met, counts = F.lit(True), []
    for name, condition in stages.items():
        met = met & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(met).alias(name))
    return df.agg(*counts).unpivot([], list(stages), "stage", "remaining")


def station_funnel(inventory: DataFrame) -> DataFrame:
    """Stations on the study's rivers, then operating, then telemetric."""
    return funnel(
        inventory,
        {
            "river": F.col("Rio_Codigo").isin(list(S.RIVER_CODES)),
            "operating": F.col("Operando") == "1",
            "telemetric": F.col("Tipo_Estacao_Telemetrica") == "1",
        },
    )


def imputation_distribution(flags: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of original and imputed values and the distance of the means."""
    original = F.when(~F.col("was_missing"), F.col("original"))
    imputed = F.when(F.col("was_missing"), F.col("filled"))
    return flags.groupBy(*keys).agg(
        F.avg(original).alias("original_mean"),
        F.stddev_samp(original).alias("original_std"),
        F.avg(imputed).alias("imputed_mean"),
        F.stddev_samp(imputed).alias("imputed_std"),
        F.abs(F.avg(original) - F.avg(imputed)).alias("mean_difference"),
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Counts per equal-width bin of each group's range; the highest value falls into the last bin."""
    span = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    if not keys:
        low, high = df.agg(F.min(value).alias("low")).scalar(), df.agg(F.max(value).alias("high")).scalar()
    share = ratio((F.col(value) - F.col("low")) * bins, F.col("high") - F.col("low"))
    number = F.least(F.floor(F.coalesce(share, F.lit(0.0))) + 1, F.lit(bins)).cast("bigint")
    present = df.filter(F.col(value).isNotNull())
    joined = matched(present, span, list(keys)) if keys else present.withColumn("low", low).withColumn("high", high)
    return joined.groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges, and the number of points beyond them."""
    cuts = percentiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    joined = matched(df, cuts, list(keys), "inner")
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def imputation_summary(before: DataFrame, after: DataFrame, key: str, ts: str, features: Sequence[str]) -> DataFrame:
    """Per station: metrics with filled cells, metrics without any value, number of filled cells."""
    old = before.select(key, ts, *[F.col(f).alias(f"_b_{f}") for f in features])
    both = after.select(key, ts, *features).join(old, [key, ts])
    filled = [F.count_if(F.col(f"_b_{f}").isNull() & F.col(f).isNotNull()).alias(f"_n_{f}") for f in features]
    known = [F.count(f"_b_{f}").alias(f"_k_{f}") for f in features]
    counted = both.groupBy(key).agg(*filled, *known)
    total = lambda exprs: sum(exprs[1:], exprs[0])
    return counted.select(
        key,
        total([(F.col(f"_n_{f}") > 0).cast("bigint") for f in features]).alias("features_imputed"),
        total([(F.col(f"_k_{f}") == 0).cast("bigint") for f in features]).alias("features_skipped"),
        total([F.col(f"_n_{f}") for f in features]).alias("cells_filled"),
    )


def initial_means(df: DataFrame, key: str, features: Sequence[str], stations: Sequence[str]) -> DataFrame:
    """Mean of the present values, features down and stations across."""
    means = df.groupBy(key).agg(*[F.avg(f).alias(f) for f in features]).unpivot([key], list(features), "feature", "mean")
    return means.groupBy("feature").pivot(key, list(stations)).agg(F.first("mean"))
