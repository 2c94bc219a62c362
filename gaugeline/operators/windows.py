"""Lags, rolling statistics, horizon targets, sequences and rolling modes over long series."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeline import schema as S
from gaugeline.functions.expr import half_even
from gaugeline.operators.chunks import chunk_of, halo_rows, matched, over_chunks


#: So many stretches of a length are merged into one of the next length.
RADIX = 4


def _added(a: str, b: str) -> Column:
    """The sum of two stretches of rows; NULL is one without values."""
    return F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))


def _merged(a: str, b: str) -> Column:
    """Count ``n``, mean ``m``, squared deviations ``q``, maximum ``x`` and minimum ``y`` of two stretches of rows; NULL is one without values."""
    a, b = F.col(a), F.col(b)
    n, apart = a["n"] + b["n"], b["m"] - a["m"]
    # The mean lies between the stretches' means.
    both = {"n": n, "m": a["m"] + apart * (b["n"] / n), "q": a["q"] + b["q"] + apart * apart * (a["n"] * b["n"] / n), "x": F.greatest(a["x"], b["x"]), "y": F.least(a["y"], b["y"])}
    return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.struct(*[c.alias(f) for f, c in both.items()]))


def row_features(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    values: Sequence[str],
    lags: Sequence[int] = (),
    windows: Sequence[int] = (),
    sums: Sequence[int] = (),
    names: str = "{kind}_{size}_{value}",
) -> DataFrame:
    """Lag, rolling mean, rolling sample deviation and rolling sum columns for every value column.

    Mean and deviation need a full window of values; a sum needs one value; NaN counts as missing. Counts, sums, means and
    squared deviations of the last 4, 16, 64, ... rows are merged from those of the stretches a quarter as long, and a window
    is merged from the few stretches that make it up. Nothing is subtracted from a longer total, so earlier levels, spikes or NaN
    leave no trace, and the cost grows with the logarithm of the window. All of it looks back along one order: the rows of a
    task are sorted once, however many windows there are.
    """
    reach = max([*lags, *windows, *sums, 0])
    kinds = [(k, merge, wanted) for k, merge, wanted in (("s", _added, sums), ("m", _merged, windows)) if wanted]

    def build(spread: DataFrame, order: WindowSpec) -> DataFrame:
        kept, made = [F.col(c) for c in spread.columns], []
        for v in values:
            made += [F.lag(v, k).over(order).alias(names.format(kind="lag", size=k, value=v)) for k in lags]
        frame = spread.select("*", *made)
        frame = frame.withColumns({f"_v_{v}": F.nanvl(F.col(v).cast("double"), F.lit(None)) for v in values})
        for kind, merge, sizes in kinds:
            # _t<level>: the last RADIX ** level rows, _b: a stretch that ends so many rows back.
            for v in values:
                c = F.col(f"_v_{v}")
                one = c if kind == "s" else F.when(c.isNotNull(), F.struct(F.lit(1).cast("bigint").alias("n"), c.alias("m"), F.lit(0.0).alias("q"), c.alias("x"), c.alias("y")))
                frame = frame.withColumn(f"_t0_{v}", one)
            top = 0
            while RADIX ** (top + 1) <= max(sizes):
                back = {f"_b{k}_{v}": F.lag(f"_t{top}_{v}", k * RADIX**top).over(order) for v in values for k in range(1, RADIX)}
                frame, top = frame.withColumns({**back, **{f"_t{top + 1}_{v}": F.col(f"_t{top}_{v}") for v in values}}), top + 1
                for k in range(1, RADIX):
                    frame = frame.withColumns({f"_t{top}_{v}": merge(f"_t{top}_{v}", f"_b{k}_{v}") for v in values})
                frame = frame.drop(*back)
            parts, back = {w: [] for w in dict.fromkeys(sizes)}, {}
            for w, found in parts.items():
                gone = 0
                for level in range(top, -1, -1):
                    for _ in range((w - gone) // RADIX**level):
                        found.append(f"_w{w}_{gone}")
                        back |= {f"_w{w}_{gone}_{v}": F.lag(f"_t{level}_{v}", gone).over(order) for v in values}
                        gone += RADIX**level
            frame = frame.withColumns(back).drop(*(f"_t{level}_{v}" for level in range(top + 1) for v in values))
            for k in range(1, max(map(len, parts.values()))):
                frame = frame.withColumns({f"{p[0]}_{v}": merge(f"{p[0]}_{v}", f"{p[k]}_{v}") for p in parts.values() if k < len(p) for v in values})
            done = {}
            for w in parts:
                for v in values:
                    all_of = F.col(f"_w{w}_0_{v}")
                    if kind == "s":
                        done[names.format(kind="cum_sum", size=w, value=v)] = all_of
                        continue
                    flat, full = all_of["x"] == all_of["y"], all_of["n"] == w  # equal values: their mean and 0, exactly
                    mean, squares = F.when(flat, all_of["y"]).otherwise(all_of["m"]), F.when(flat, F.lit(0.0)).otherwise(all_of["q"])
                    done[names.format(kind="rolling_mean", size=w, value=v)] = F.when(full, mean)
                    done[names.format(kind="rolling_std", size=w, value=v)] = F.when(full & (F.lit(w) > 1), F.sqrt(squares / max(w - 1, 1)))
            frame = frame.withColumns(done).drop(*back)
        columns = [names.format(kind=kind, size=k, value=v) for v in values for kind, sizes in
                   (("lag", lags), ("rolling_mean", windows), ("rolling_std", windows), ("cum_sum", sums)) for k in sizes]
        return frame.select(*kept, *dict.fromkeys(columns))

    return over_chunks(df, keys, idx, build, before=reach)


def _back(total: str, rows: int, order: WindowSpec, name: str) -> Column:
    """Growth of a running total over the last ``rows`` rows."""
    now = F.coalesce(F.col(total), F.lit(0))
    then = F.coalesce(F.lag(total, rows).over(order), F.lit(0))
    return (now - then).alias(name)


def engineer(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    values: Sequence[str],
    lags: Sequence[int] = S.LAGS,
    windows: Sequence[int] = S.ROLLING_WINDOWS,
    sums: Sequence[int] = S.SUM_WINDOWS,
    compat: bool = False,
) -> DataFrame:
    """All feature columns in one pass, their missing values set to 0.

    ``compat`` also zeroes the original columns before rolling, as filling the whole frame after the lag step does.
    """
    if compat:
        df = df.na.fill(0, subset=list(values))
    made = row_features(df, keys, idx, values, lags, windows, sums)
    return made.na.fill(0, subset=[c for c in made.columns if c.startswith(S.ENGINEERED_PREFIXES)])


def horizon_targets(df: DataFrame, keys: Sequence[str], idx: str, target: str, steps: Sequence[int]) -> DataFrame:
    """One row per input row and horizon with ``y`` the target ``step`` rows later; rows without such a row are dropped."""

    def build(spread: DataFrame, order: WindowSpec) -> DataFrame:
        ahead = [F.struct(F.lit(s).alias("step"), F.lead(target, s).over(order).alias("y")) for s in steps]
        return spread.withColumn("_ahead", F.array(*ahead))

    wide = over_chunks(df, keys, idx, build, after=max(steps))
    return wide.select(*df.columns, F.inline("_ahead")).filter(F.col("y").isNotNull())


def sequences(df: DataFrame, keys: Sequence[str], idx: str, features: Sequence[str], length: int, target: str) -> DataFrame:
    """The ``length`` rows before each row as an array of feature arrays, with the row's target.

    The output repeats each row ``length`` times by nature; write it out partitioned rather than collecting it.
    """
    step = F.array(*[F.col(c).cast("double") for c in features])

    def build(spread: DataFrame, order: WindowSpec) -> DataFrame:
        return spread.withColumn("x", F.collect_list(step).over(order.rowsBetween(-length, -1)))

    made = over_chunks(df, keys, idx, build, before=length)
    return made.filter(F.size("x") == length).select(*keys, idx, "x", F.col(target).alias("y"))


def pad_predictions(df: DataFrame, keys: Sequence[str], idx: str, pred: str) -> DataFrame:
    """Give the rows before the first prediction of a series that prediction."""
    first = df.filter(F.col(pred).isNotNull()).groupBy(*keys).agg(F.min_by(pred, idx).alias("_first"), F.min(idx).alias("_at"))
    head = F.when(F.col(idx) < F.col("_at"), F.col("_first"))
    return matched(df, first, list(keys)).withColumn(pred, F.coalesce(F.col(pred), head)).drop("_first", "_at")


#: So many codes are counted in a column each; of more, every task counts those of its rows.
FEW_CODES = 16


def _recent_modes(codes: np.ndarray, window: int) -> list[int | None]:
    """The most frequent code of the last ``window`` rows, the lowest on ties; NaN is no code."""
    counts: dict[int, int] = {}
    best: list[tuple[int, int]] = []  # (-count, code): those that no longer hold are dropped when they come up
    out: list[int | None] = []
    for i, code in enumerate(codes.tolist()):
        for c, change in ((code, 1), (codes[i - window] if i >= window else math.nan, -1)):
            if not math.isnan(c):
                counts[int(c)] = n = counts.get(int(c), 0) + change
                heapq.heappush(best, (-n, int(c)))
        while best and counts[best[0][1]] != -best[0][0]:
            heapq.heappop(best)
        out.append(best[0][1] if best and best[0][0] else None)
    return out


def _mode_of_many(df: DataFrame, keys: Sequence[str], idx: str, status: str, windows: Sequence[int]) -> DataFrame:
    """``rolling_mode`` for any number of codes: each chunk is swept once per window, with the rows it must see before it."""
    before = max(windows)
    rows = halo_rows(before, 0)
    first, last = chunk_of(idx, rows), chunk_of(F.col(idx) + before, rows)
    lean = df.select(*keys, idx, F.col(status).cast("bigint").cast("double").alias("_code"))
    spread = lean.withColumn("_chunk", F.explode(F.sequence(first, last)))
    names = [f"mode_{w}" for w in windows]

    def sweep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(idx, kind="stable")
        codes, mine = group["_code"].to_numpy(), (group[idx] // rows == group["_chunk"]).to_numpy()
        made = group.loc[mine, [*keys, idx]].copy()
        for w, name in zip(windows, names):
            made[name] = pd.array(_recent_modes(codes, w), dtype="Int64")[mine]
        return made

    kinds = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in (*keys, idx)), *(f"{n} bigint" for n in names)])
    return matched(df, spread.groupBy(*keys, "_chunk").applyInPandas(sweep, kinds), [*keys, idx])


def rolling_mode(
    df: DataFrame, keys: Sequence[str], idx: str, status: str, windows: Sequence[int], codes: Sequence[int] | None = None
) -> DataFrame:
    """Most frequent code of the last ``w`` rows, the lowest on ties, NULL without any code: ``mode_<w>``.

    Without ``codes`` those that occur in the data are counted: up to ``FEW_CODES`` in a running column each, more of
    them chunk by chunk, so that their list is never gathered.
    """
    if codes is None:
        seen = df.select(F.col(status).cast("bigint").alias("c")).distinct().filter("c is not null").limit(FEW_CODES + 1)
        codes = sorted(r["c"] for r in seen.collect())
        if len(codes) > FEW_CODES:
            return _mode_of_many(df, keys, idx, status, windows)
    if not codes:
        return df.select("*", *[F.lit(None).cast("bigint").alias(f"mode_{w}") for w in windows])

    def build(spread: DataFrame, order: WindowSpec) -> DataFrame:
        running = order.rowsBetween(Window.unboundedPreceding, 0)
        hits = [F.sum((F.coalesce(F.col(status) == c, F.lit(False))).cast("bigint")).over(running).alias(f"_c{c}") for c in codes]
        counted = spread.select("*", *hits)
        recent = [_back(f"_c{c}", w, order, f"_c{c}_{w}") for w in windows for c in codes]
        counted = counted.select("*", *recent)
        modes = []
        for w in windows:
            best = F.array_max(F.array(*[F.struct(F.col(f"_c{c}_{w}").alias("n"), F.lit(-c).alias("c")) for c in codes]))
            modes.append(F.when(best["n"] > 0, -best["c"]).cast("bigint").alias(f"mode_{w}"))
        return counted.select(*spread.columns, *modes)

    return over_chunks(df, keys, idx, build, before=max(windows))


def accumulate_rain(
    df: DataFrame, keys: Sequence[str], idx: str, rain: str, status: str, days: dict[int, int] | None = None
) -> DataFrame:
    """Rain over the last 1, 7 and 30 days (rounded to 2) with the usual code of the same rows."""
    days = days or {1: 96, 7: 672, 30: 2880}
    made = row_features(df, keys, idx, [rain], sums=list(days.values()))
    made = rolling_mode(made, keys, idx, status, list(days.values()))
    extra = []
    for d, w in days.items():
        extra.append(half_even(f"cum_sum_{w}_{rain}", 2).alias(f"{rain}_{d}d"))
        extra.append(F.col(f"mode_{w}").alias(f"{rain}_{d}d{S.STATUS_SUFFIX}"))
    return made.select(*df.columns, *extra)
