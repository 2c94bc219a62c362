"""Forecast scores as mergeable aggregates: one pass, partial aggregation, no ``corr`` (it fails on constant columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.functions.expr import col, ratio


def _pair(truth: str | Column, pred: str | Column) -> tuple[Column, Column]:
    """Both sides, NULL unless both are present."""
    t, p = col(truth).cast("double"), col(pred).cast("double")
    both = t.isNotNull() & p.isNotNull()
    return F.when(both, t), F.when(both, p)


def rmse(truth: str | Column, pred: str | Column) -> Column:
    t, p = _pair(truth, pred)
    return F.sqrt(F.avg((t - p) * (t - p)))


def mae(truth: str | Column, pred: str | Column) -> Column:
    t, p = _pair(truth, pred)
    return F.avg(F.abs(t - p))


def nse(truth: str | Column, pred: str | Column) -> Column:
    """1 - error sum of squares / sum of squares about the mean; also R2."""
    t, p = _pair(truth, pred)
    return 1 - ratio(F.avg((t - p) * (t - p)), F.var_pop(t))


r2 = nse


def nnse(truth: str | Column, pred: str | Column) -> Column:
    return 1 / (2 - nse(truth, pred))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation over complete pairs, NULL when either side is constant."""
    x, y = _pair(a, b)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def kge(truth: str | Column, pred: str | Column, variant: str = "cv", undefined: float | None = None) -> Column:
    """Kling-Gupta efficiency. ``cv`` compares coefficients of variation, ``sd`` standard deviations."""
    t, p = _pair(truth, pred)
    beta = ratio(F.avg(p), F.avg(t))
    if variant == "cv":
        spread = ratio(ratio(F.stddev_pop(p), F.avg(p)), ratio(F.stddev_pop(t), F.avg(t)))
    elif variant == "sd":
        spread = ratio(F.stddev_pop(p), F.stddev_pop(t))
    else:
        raise ValueError(f"unknown variant: {variant}")
    r = pearson(truth, pred)
    score = 1 - F.sqrt((r - 1) * (r - 1) + (spread - 1) * (spread - 1) + (beta - 1) * (beta - 1))
    return score if undefined is None else F.coalesce(score, F.lit(undefined))


def bundle(truth: str = "y_true", pred: str = "y_pred", compat: bool = True) -> list[Column]:
    """The five scores of a prediction set. With ``compat`` the column ``nse`` holds the normalised value."""
    scores = [rmse(truth, pred).alias("rmse"), mae(truth, pred).alias("mae")]
    if compat:
        scores.append(nnse(truth, pred).alias("nse"))
    else:
        scores += [nse(truth, pred).alias("nse"), nnse(truth, pred).alias("nnse")]
    return [*scores, r2(truth, pred).alias("r2"), kge(truth, pred).alias("kge")]
