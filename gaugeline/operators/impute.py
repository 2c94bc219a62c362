"""Bounded gap filling with a natural cubic spline.

The spline is global in principle, but a knot's influence at least halves with every knot in between. So each gap is
solved from its nearest ``HALO`` knots on either side: the difference from the global solution is below 2**-HALO of the
largest curvature term, which no double shows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import schema as S
from gaugeline.functions.expr import clip, half_even, micros_of, slot, slot_time
from gaugeline.operators.chunks import matched, chunk_of, number_rows, number_sorted, with_series_index
from gaugeline.operators.clean import drop_negatives
from gaugeline.operators.gaps import missing_rate
from gaugeline.operators.grid import grid, one_per_slot
from gaugeline.schema import SeriesSchema
from gaugeline.session import checkpointed

HALO = 60
KNOTS = 4096
MIN_POINTS = 4


def solve_gaps(pos: np.ndarray, val: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spline values strictly between knots ``left`` and ``left + 1``, for all given gaps at once.

    The tridiagonal systems of all gaps have the same width and are eliminated together, one column at a time.
    """
    n, width = len(pos), 2 * HALO + 2
    at = left[:, None] + np.arange(-HALO, HALO + 2)[None, :]
    inner = (at > 0) & (at < n - 1)
    inner[:, [0, -1]] = False
    k = np.clip(at, 1, n - 2)
    h = np.diff(pos)
    slope = np.diff(val) / h
    lower = np.where(inner, h[k - 1], 0.0)
    upper = np.where(inner, h[k], 0.0)
    diag = np.where(inner, 2.0 * (h[k - 1] + h[k]), 1.0)
    rhs = np.where(inner, 6.0 * (slope[k] - slope[k - 1]), 0.0)
    for j in range(1, width):
        factor = lower[:, j] / diag[:, j - 1]
        diag[:, j] -= factor * upper[:, j - 1]
        rhs[:, j] -= factor * rhs[:, j - 1]
    curve = np.zeros_like(rhs)
    for j in range(width - 2, 0, -1):
        curve[:, j] = (rhs[:, j] - upper[:, j] * curve[:, j + 1]) / diag[:, j]
    m0, m1 = curve[:, HALO], curve[:, HALO + 1]
    gap = (h[left] - 1).astype(np.int64)
    which = np.repeat(np.arange(len(left)), gap)
    step = np.arange(len(which)) - np.repeat(np.cumsum(gap) - gap, gap) + 1.0
    a, width_of = left[which], h[left][which]
    rest = width_of - step
    out = (
        (m0[which] * rest**3 + m1[which] * step**3) / (6.0 * width_of)
        + (val[a] / width_of - m0[which] * width_of / 6.0) * rest
        + (val[a + 1] / width_of - m1[which] * width_of / 6.0) * step
    )
    return (pos[a] + step).astype(np.int64), out


def spline_points(df: DataFrame, keys: Sequence[str], idx: str, value: str, max_gap: int, knots: int = KNOTS) -> DataFrame:
    """(keys, idx, value) for every position inside an interior gap of at most ``max_gap`` positions, for series of
    at least four points.

    ``df`` holds at most one row per (keys, idx). Knots are numbered per series and sent in pieces of ``knots`` with a
    halo; pieces without a gap to fill are dropped before Python sees them.
    """
    keys = list(keys)
    seen = df.filter(F.col(value).isNotNull()).select(*keys, idx, F.col(value).cast("double").alias(value))
    ranked = number_rows(seen, keys, [idx], chunk_of(idx, KNOTS), "_knot")
    reach = HALO + 2
    first = F.greatest(chunk_of(F.col("_knot") - reach, knots), F.lit(0).cast("bigint"))
    pieces = ranked.withColumn("_piece", F.explode(F.sequence(first, chunk_of(F.col("_knot") + reach, knots))))
    piece = Window.partitionBy(*keys, "_piece")
    hole = F.lead(idx).over(piece.orderBy("_knot")) - F.col(idx) - 1
    own = chunk_of("_knot", knots) == F.col("_piece")
    pieces = pieces.withColumn("_fill", F.coalesce(own & hole.between(1, max_gap), F.lit(False)))
    pieces = pieces.withColumn("_any", F.max("_fill").over(piece)).filter("_any").drop("_any")
    schema = T.StructType(
        [pieces.schema[k] for k in keys] + [T.StructField(idx, T.LongType()), T.StructField(value, T.DoubleType())]
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_knot")
        pos, out = np.empty(0, dtype=np.int64), np.empty(0)
        if len(pdf) >= MIN_POINTS:
            left = np.flatnonzero(pdf["_fill"].to_numpy())
            pos, out = solve_gaps(pdf[idx].to_numpy(dtype=float), pdf[value].to_numpy(dtype=float), left)
        made = {k: pdf[k].iloc[np.zeros(len(pos), dtype=int)].array for k in keys}
        return pd.DataFrame({**made, idx: pos, value: out})

    return pieces.groupBy(*keys, "_piece").applyInPandas(fill, schema)


def value_bounds(df: DataFrame, keys: Sequence[str], value: str, signed: Column) -> DataFrame:
    """Observed range of each series widened by half of it on both sides, not below 0 unless ``signed``."""
    low, high = F.min(value), F.max(value)
    margin = (high - low) * 0.5
    stats = df.groupBy(*keys).agg(F.count(value).alias("points"), (low - margin).alias("_low"), (high + margin).alias("upper_bound"))
    lower = F.when(signed, F.col("_low")).otherwise(F.greatest(F.col("_low"), F.lit(0.0)))
    return stats.select(*keys, "points", lower.alias("lower_bound"), "upper_bound")


def bounded_fill(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, signed: Column, max_gap: int = S.MAX_FILL_STEPS
) -> DataFrame:
    """Spline values of all gaps to fill, clipped to the bounds, for series with at least four points."""
    bounds = value_bounds(df, keys, value, signed).filter(F.col("points") >= MIN_POINTS)
    filled = matched(spline_points(df, keys, idx, value, max_gap), bounds, list(keys), "inner")
    return filled.select(*keys, idx, clip(F.col(value), F.col("lower_bound"), F.col("upper_bound")).alias(value))


def _long(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Present values only, one row per (ids, metric)."""
    wide = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(list(ids), list(values), "metric", "value").filter(F.col("value").isNotNull())


def fill_gaps(
    df: DataFrame,
    schema: SeriesSchema = SeriesSchema(),
    lo: str = S.START_DATE,
    hi: str = S.END_DATE,
    step: int = S.GRID_STEP,
    max_fill_steps: int = S.MAX_FILL_STEPS,
    digits: int = 1,
    meta: DataFrame | None = None,
    keep_code: bool = False,
    dedupe: bool = True,
    stations: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Readings on the full grid with short gaps filled, codes updated and metadata joined; and missing rates.

    Only readings on the grid take part. Equal timestamps of a station are reduced to one row; with ``dedupe=False``
    they stay, and the spline runs over row positions, which they shift. Filled rows get code 4;
    values of a metric with at least four points are rounded to ``digits``. ``stations`` lists the stations to put on
    the grid; without it, they are the ones in ``df``.
    """
    key, ts = schema.key, schema.ts
    values = [v for v in schema.values if v in df.columns]
    origin = micros_of(lo)
    at = slot(ts, step, origin)
    last = (micros_of(hi) - origin) // (step * 1_000_000)
    exact = (slot_time(at, step, origin) == F.col(ts)) & at.between(0, last)
    readings = df.filter(exact).withColumn("_idx", at)
    if dedupe:
        # Read by the knots, the bounds, the filled rows and the missing rates; the shuffle is paid once.
        readings = checkpointed(one_per_slot(readings, [key, "_idx"], [ts]))
    readings = readings.drop(ts)
    dense = matched(grid(df if stations is None else stations, key, ts, lo, hi, step, "_idx"), readings, [key, "_idx"])
    place, source = "_idx", readings
    if not dedupe:
        place = "_row"
        source = dense = number_sorted(dense, [key], ["_idx", *values], place)

    known = _long(source, [key, place], values)
    signed = F.col("metric").isin(list(schema.signed))
    points = bounded_fill(known, [key, "metric"], place, "value", signed, max_fill_steps)
    fills = points.groupBy(key, place).pivot("metric", values).agg(F.first("value"))
    fills = fills.select(key, place, *[F.col(v).alias(f"_fill_{v}") for v in values])
    enough = readings.groupBy(key).agg(*[(F.count(v) >= MIN_POINTS).alias(f"_enough_{v}") for v in values])

    before = missing_rate(dense, key, values[0], "before")
    joined = matched(matched(dense, fills, [key, place]), enough, [key])
    out = []
    for c in dense.columns:
        main = c.removesuffix(schema.status_suffix)
        if c in values:
            full = F.coalesce(F.col(c), F.col(f"_fill_{c}"))
            out.append(F.when(F.col(f"_enough_{c}"), half_even(full, digits)).otherwise(full).alias(c))
        elif c != main and main in values:
            out.append(F.when(F.col(f"_fill_{main}").isNotNull(), F.lit(S.FILLED).cast("bigint")).otherwise(F.col(c)).alias(c))
        elif c not in ("_idx", place):
            out.append(F.col(c))
    filled = joined.select(*out)
    after = missing_rate(filled, key, values[0], "after")
    filled = drop_negatives(filled, schema, keep_code)
    if meta is not None:
        filled = filled.join(meta.select(key, *[m for m in schema.meta if m in meta.columns]), key, "left")
    return filled.select(*schema.kept(filled.columns)), before.unionByName(after)


def impute_long(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    signed: Column,
    max_gap: int = S.MAX_FILL_STEPS,
    digits: int = 3,
    status: str | None = None,
) -> DataFrame:
    """Fill the short gaps of long series (a row per position, NULL where missing) and mark them 4."""
    fills = bounded_fill(df, keys, idx, value, signed, max_gap).withColumnRenamed(value, "_fill")
    joined = matched(df, fills, [*keys, idx])
    out = []
    for c in df.columns:
        if c == value:
            out.append(half_even(F.coalesce(F.col(c), F.col("_fill")), digits).alias(c))
        elif c == status:
            out.append(F.when(F.col("_fill").isNotNull(), F.lit(S.FILLED).cast("bigint")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def impute_wide(
    df: DataFrame, ts: str, columns: Sequence[str] | None = None, split: str | None = None, max_gap: int = S.MAX_FILL_STEPS, digits: int = 3
) -> DataFrame:
    """Fill the short gaps of wide columns over row positions, separately per ``split``.

    Works on the present values in long form, keyed by (split, column), and joins only the filled cells back.
    """
    columns = list(columns) if columns is not None else [c for c in S.imputable_columns(df.columns) if c not in (ts, split)]
    keys = [split] if split else []
    # Read by the knots, the bounds and the filled rows.
    indexed = checkpointed(with_series_index(df, keys, ts, "_idx"))
    known = _long(indexed, [*keys, "_idx"], columns)
    signed = F.col("metric").contains("Temperatura")
    points = bounded_fill(known, [*keys, "metric"], "_idx", "value", signed, max_gap)
    fills = points.groupBy(*keys, "_idx").pivot("metric", columns).agg(F.first("value"))
    fills = fills.select(*keys, "_idx", *[F.col(c).alias(f"_fill_{c}") for c in columns])
    joined = matched(indexed, fills, [*keys, "_idx"])
    marks = {}
    for c in columns:
        metric, _, station = c.rpartition("_")
        marks[f"{metric}{S.STATUS_SUFFIX}_{station}"] = c
    out = []
    for c in df.columns:
        if c in columns:
            out.append(half_even(F.coalesce(F.col(c), F.col(f"_fill_{c}")), digits).alias(c))
        elif c in marks:
            code = F.when(F.col(f"_fill_{marks[c]}").isNotNull(), F.lit(S.FILLED)).otherwise(F.col(c))
            out.append(code.cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
