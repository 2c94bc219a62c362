"""Outlier scores per station and their consensus.

Both scores look at complete rows: rows that have a value for every metric the station ever reports.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import schema as S
from gaugeline.functions.expr import ratio
from gaugeline.operators.chunks import matched, percentiles, ranked_rows
from gaugeline.schema import SeriesSchema
from gaugeline.session import checkpointed

TINY = 1e-12


def mark_complete(df: DataFrame, keys: Sequence[str], features: Sequence[str], flag: str = "_complete") -> DataFrame:
    """Add ``_has_<feature>`` (the station reports it at all) and whether the row is complete."""
    seen = df.groupBy(*keys).agg(*[(F.count(f) > 0).alias(f"_has_{f}") for f in features])
    full, some = F.lit(True), F.lit(False)
    for f in features:
        full = full & (~F.col(f"_has_{f}") | F.col(f).isNotNull())
        some = some | F.col(f"_has_{f}")
    return matched(df, seen, list(keys)).withColumn(flag, full & some)


def ecod_score(df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "ecod") -> DataFrame:
    """Sum over the metrics of the largest of the left, right and skew-chosen tail, each -ln of a tail share.

    Needs the columns of ``mark_complete``; incomplete rows get NULL. All metrics are ranked at once in long form, the tail shares
    follow from the ranks on the rows, and one aggregate brings the metrics of a row together: the frame is sorted
    and joined once, whatever the number of metrics.
    """
    keys = list(keys)
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    complete = rows.filter("_complete")
    long = complete.select(*keys, "_row", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [*keys, "_row"], list(features), "_metric", "_value"
    )
    ranks = ranked_rows(long, [*keys, "_metric"], "_value", F.xxhash64("_row"))
    left = -F.ln((F.col("below") + F.col("cnt")) / F.col("n"))
    right = -F.ln((F.col("n") - F.col("below")) / F.col("n"))
    lean = complete.groupBy(*keys).agg(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.coalesce(F.skewness(f), F.lit(0.0)) for f in features])).alias("_lean"))
    told = matched(ranks.withColumns({"_left": left, "_right": right}), lean, keys)
    skew = F.col("_lean")[F.col("_metric")]
    chosen = F.when(skew < 0, F.col("_left")).when(skew > 0, F.col("_right")).otherwise(F.col("_left") + F.col("_right"))
    tails = told.select("_row", "_metric", F.greatest("_left", "_right", chosen).alias("_tail"))
    # Each metric in its own column, so that they are added up in the same order every time.
    wide = tails.groupBy("_row").agg(*[F.max(F.when(F.col("_metric") == f, F.col("_tail"))).alias(f"_tail{i}") for i, f in enumerate(features)])
    total = F.lit(0.0)
    for i in range(len(features)):
        total = total + F.coalesce(F.col(f"_tail{i}"), F.lit(0.0))
    scored = rows.join(wide, "_row", "left")
    return scored.select(*[F.col(c) for c in df.columns], F.when(F.col("_complete"), total).alias(name))


def principal_axes(df: DataFrame, keys: Sequence[str], features: Sequence[str], scale: bool) -> DataFrame:
    """Mean, scale, axes and variance shares per group, from one pass of covariances over complete rows.

    The eigen-solve runs on one row of statistics per group. Axes are ordered by variance, and signed so that the
    largest loading (the first of equal ones) is positive. Metrics that are absent or constant get zero loadings.
    """
    keys, features = list(keys), list(features)
    d = len(features)
    aggs = []
    for i, a in enumerate(features):
        x = F.col(a).cast("double")
        aggs += [F.avg(x).alias(f"_m{i}"), F.stddev_pop(x).alias(f"_s{i}")]
        aggs += [F.covar_pop(x, F.col(features[j]).cast("double")).alias(f"_c{i}_{j}") for j in range(i + 1)]
    stats = df.filter("_complete").groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    schema = stats.select(*keys, "_rows").schema
    for i in range(d):
        for name in [f"_m{i}", f"_s{i}", f"_w{i}", *[f"_v{i}_{j}" for j in range(d)]]:
            schema = schema.add(name, "double")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(row) for row in batch.to_dict("records")], columns=schema.names)

    def one(row: dict) -> dict:
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                c = row[f"_c{i}_{j}"]
                cov[i, j] = cov[j, i] = 0.0 if c is None or np.isnan(c) else c
        dev = np.sqrt(np.diag(cov))
        live = np.flatnonzero(dev > TINY)
        out = {k: row[k] for k in [*keys, "_rows"]}
        for i in range(d):
            m = row[f"_m{i}"]
            used = i in live
            out[f"_m{i}"] = float(m) if used else 0.0
            out[f"_s{i}"] = float(dev[i]) if used and scale else 1.0
            out[f"_w{i}"] = None
            out.update({f"_v{i}_{j}": 0.0 for j in range(d)})
        if len(live):
            part = cov[np.ix_(live, live)]
            if scale:
                part = part / np.outer(dev[live], dev[live])
            weight, axes = np.linalg.eigh(part)
            order = np.argsort(-weight, kind="stable")
            share = np.clip(weight[order], 0.0, None) / weight.sum()
            for i, column in enumerate(order):
                axis = axes[:, column]
                size = np.abs(axis)
                axis = axis * (1.0 if axis[np.flatnonzero(size > size.max() - 1e-9)[0]] >= 0 else -1.0)
                out[f"_w{i}"] = float(share[i]) if share[i] > TINY else None
                for j, place in enumerate(live):
                    out[f"_v{i}_{place}"] = float(axis[j])
        return out

    return stats.mapInPandas(solve, schema)


def _centred(features: Sequence[str]) -> list[Column]:
    return [F.coalesce((F.col(f).cast("double") - F.col(f"_m{i}")) / F.col(f"_s{i}"), F.lit(0.0)) for i, f in enumerate(features)]


def pca_score(df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "pca") -> DataFrame:
    """Sum over all axes of the distance from the standardised row to the axis, divided by the axis's variance share."""
    axes = principal_axes(df, keys, features, scale=True)
    d = len(features)
    z = _centred(features)
    total = F.lit(0.0)
    for i in range(d):
        square = F.lit(0.0)
        for j in range(d):
            # A dead metric has z = 0 and loading 0; its raw value must not count.
            term = F.when(F.col(f"_live{j}"), z[j]).otherwise(0.0) - F.col(f"_v{i}_{j}")
            square = square + term * term
        total = total + F.coalesce(F.sqrt(square) / F.col(f"_w{i}"), F.lit(0.0))
    live = []
    for j in range(d):
        loading = F.lit(0.0)
        for i in range(d):
            loading = loading + F.abs(F.col(f"_v{i}_{j}"))
        live.append((loading > 0).alias(f"_live{j}"))
    axes = axes.select("*", *live)
    joined = matched(df, axes, list(keys))
    return joined.select(*[F.col(c) for c in df.columns], F.when(F.col("_complete"), total).alias(name))


def project(df: DataFrame, keys: Sequence[str], features: Sequence[str], k: int = 2) -> DataFrame:
    """Complete rows on the first ``k`` axes of the centred metrics, ``pc1`` to ``pc<k>``, with the explained shares."""
    d = len(features)
    axes = principal_axes(df, keys, features, scale=False)
    joined = matched(df.filter("_complete"), axes, list(keys))
    z = _centred(features)
    out = []
    for i in range(min(k, d)):
        place = F.lit(0.0)
        for j in range(d):
            place = place + z[j] * F.col(f"_v{i}_{j}")
        out += [place.alias(f"pc{i + 1}"), F.coalesce(F.col(f"_w{i}"), F.lit(0.0)).alias(f"explained{i + 1}")]
    return joined.select(*[F.col(c) for c in df.columns], *out)


def thresholds(df: DataFrame, keys: Sequence[str], scores: Sequence[str], method: str = "iqr", share: float = 0.99) -> DataFrame:
    """``<score>_threshold`` per station: third quartile plus 1.5 interquartile ranges, or a high percentile."""
    keys = list(keys)
    if method == "iqr":
        probs = {"_q1": 0.25, "_q3": 0.75}
        limit = F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))
    elif method == "percentile":
        probs = {"_p": share}
        limit = F.col("_p")
    else:
        raise ValueError(f"unknown threshold method: {method}; use 'iqr' or 'percentile'")
    long = df.select(*keys, *scores).unpivot(keys, list(scores), "_detector", "_score")
    cuts = percentiles(long, [*keys, "_detector"], "_score", probs).select(*keys, "_detector", limit.alias("_limit"))
    wide = cuts.groupBy(*keys).pivot("_detector", list(scores)).agg(F.first("_limit"))
    return wide.select(*keys, *[F.col(s).alias(f"{s}_threshold") for s in scores])


def flag_outliers(
    df: DataFrame,
    schema: SeriesSchema = SeriesSchema(),
    method: str = "iqr",
    share: float = 0.99,
    detectors: Sequence[str] = ("ecod", "pca"),
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Scores, thresholds, one flag per detector and ``is_outlier`` where all detectors agree."""
    features = [f for f in (features or schema.values) if f in df.columns]
    keys = [schema.key]
    scored = mark_complete(df, keys, features)
    if "ecod" in detectors:
        scored = ecod_score(scored, keys, features)
    if "pca" in detectors:
        scored = pca_score(scored, keys, features)
    # Limits and flags must see the same scores to the last bit, and scoring again would cost as much as the copy.
    scored = checkpointed(scored)
    scored = matched(scored, thresholds(scored, keys, detectors, method, share), keys)
    flags, agree = [], F.lit(True)
    for d in detectors:
        hit = F.coalesce(F.col(d) > F.col(f"{d}_threshold"), F.lit(False))
        flags.append(hit.alias(f"{d}_outlier"))
        agree = agree & hit
    return scored.select("*", *flags, agree.alias("is_outlier"))


def remove_outliers(
    df: DataFrame,
    schema: SeriesSchema = SeriesSchema(),
    method: str = "iqr",
    share: float = 0.99,
    detectors: Sequence[str] = ("ecod", "pca"),
) -> DataFrame:
    """NULL for the values of flagged rows and code 5; stations without complete rows pass through."""
    flagged = flag_outliers(df, schema, method, share, detectors)
    out = []
    for c in df.columns:
        main = c.removesuffix(schema.status_suffix)
        if c in schema.values:
            out.append(F.when(~F.col("is_outlier"), F.col(c)).alias(c))
        elif c != main and main in schema.values:
            hit = F.col("is_outlier") & F.col(f"_has_{main}")
            out.append(F.when(hit, F.lit(S.OUTLIER).cast("bigint")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return flagged.select(*out)


def compare_detectors(
    df: DataFrame,
    schema: SeriesSchema = SeriesSchema(),
    station: str | None = None,
    method: str = "iqr",
    share: float = 0.95,
    features: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Flagged rows and detector report of one station, or of all rows taken together as one group."""
    rows = df.withColumn("_all", F.lit("all")) if station is None else df.filter(F.col(schema.key) == station).withColumn("_all", F.lit(station))
    features = [f for f in (features or [*schema.values, *schema.meta]) if f in df.columns]
    flagged = flag_outliers(rows, replace(schema, key="_all"), method, share, features=features)
    report = detector_report(flagged, ["_all"]).withColumnRenamed("_all", schema.key)
    return flagged.drop("_all"), report


def detector_report(flagged: DataFrame, keys: Sequence[str], detectors: Sequence[str] = ("ecod", "pca")) -> DataFrame:
    """Threshold, number and percentage of outliers per station and detector."""
    rows = flagged.filter("_complete").select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("detector"),
                        F.col(f"{d}_threshold").alias("threshold"),
                        F.col(f"{d}_outlier").alias("hit"),
                    )
                    for d in detectors
                ]
            )
        ),
    )
    return rows.groupBy(*keys, "detector").agg(
        F.max("threshold").alias("threshold"),
        F.count_if("hit").alias("outliers"),
        F.count(F.lit(1)).alias("rows"),
        (100.0 * ratio(F.count_if("hit").cast("double"), F.count(F.lit(1)).cast("double"))).alias("outlier_rate"),
    )


def capped_sample(df: DataFrame, flag: str, order: Sequence[str], caps: dict[bool, int], seed: int | None = None) -> DataFrame:
    """At most ``caps[flag]`` rows of each flag value, the first by ``order``; with a seed, by a hash of ``order``.

    A sorted limit keeps the best rows of each partition before anything is shuffled.
    """
    ranked = [*([] if seed is None else [F.xxhash64(*order, F.lit(seed))]), *order]
    hits = df.filter(F.col(flag)).orderBy(*ranked).limit(caps[True])
    others = df.filter(~F.coalesce(F.col(flag), F.lit(False))).orderBy(*ranked).limit(caps[False])
    return hits.unionAll(others)


def display_sample(
    flagged: DataFrame, flag: str, order: Sequence[str], seed: int | None = 42, points: int = 5000, outliers: int = 2000, normals: int = 1000
) -> DataFrame:
    """A sample to draw: up to ``outliers`` flagged rows, and normal rows up to the points left (``normals`` at least)."""
    sample = capped_sample(flagged, flag, order, {True: outliers, False: points}, seed)
    hits = flagged.agg(F.least(F.count_if(F.col(flag)), F.lit(outliers)).alias("n")).scalar()
    room = F.greatest(F.lit(normals), F.lit(points) - hits)
    ranked = [*([] if seed is None else [F.xxhash64(*order, F.lit(seed))]), *order]
    place = F.row_number().over(Window.partitionBy(flag).orderBy(*ranked))
    return sample.withColumn("_rank", place).filter(F.col(flag) | (F.col("_rank") <= room)).drop("_rank")


def label_errors(df: DataFrame, keys: Sequence[str], pred: str, truth: str) -> DataFrame:
    """Number and share of rows whose flag differs from the label."""
    wrong = F.count_if(F.col(pred) != F.col(truth))
    return df.groupBy(*keys).agg(wrong.alias("errors"), (wrong / F.count(F.lit(1))).alias("error_rate"))
