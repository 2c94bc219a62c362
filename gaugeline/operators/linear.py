"""Least squares for many models over the same rows: one pass of mergeable moments, a small solve per model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.chunks import matched

#: A term whose variance is to all but this share that of the terms before it makes a model singular.
TOLERANCE = 1e-10
#: Partial sums of a model are merged in so many tasks, then in one.
SPREAD = 64
MODEL = "n long, terms array<string>, weights array<double>, means array<double>, y_mean double, rank int"


@dataclass(frozen=True)
class Part:
    """The rows of one model: those with ``step`` whose ``train_from`` is not above ``fold``, and its terms.

    ``required`` terms must be present; rows without an ``optional`` term take the model's mean of it.
    """

    step: int
    fold: int
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()


def _merged(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    (n, mean, cross), (m, other, more) = a, b
    apart = other - mean
    return n + m, mean + apart * (m / (n + m)), cross + more + apart.T @ apart * (n * m / (n + m))


def _rows_of(batch: pa.RecordBatch, part: Part, columns: Sequence[str]) -> np.ndarray:
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
    mine = (number("step") == part.step) & (number("train_from") <= part.fold)
    return np.column_stack([number(c)[mine] for c in columns])


def _whole(batch: pa.RecordBatch, part: Part, y: str) -> tuple:
    """Moments of the required terms, the response, each optional term (0 where missing) and whether it is there."""
    r = len(part.required) + 1
    x = _rows_of(batch, part, (*part.required, y, *part.optional))
    x = x[~np.isnan(x[:, :r]).any(1)]
    known = ~np.isnan(x[:, r:])
    x = np.column_stack([x[:, :r], np.where(known, x[:, r:], 0.0), known])
    if not len(x):
        return 0, 0.0, 0.0
    mean = x.mean(0, keepdims=True)
    return len(x), mean, (x - mean).T @ (x - mean)


def _pairs(batch: pa.RecordBatch, part: Part, y: str) -> tuple:
    """Per optional term, over the rows that have it: count and means; squares and product with the response."""
    r = len(part.required) + 1
    x = _rows_of(batch, part, (*part.required, y, *part.optional))
    x = x[~np.isnan(x[:, :r]).any(1)]
    if not len(x):
        return 0, 0.0, 0.0
    known = ~np.isnan(x[:, r:])
    n = known.sum(0)
    mean = lambda v: np.divide(np.where(known, v, 0.0).sum(0), n, out=np.zeros(len(n)), where=n > 0)
    a, b = x[:, r:], x[:, r - 1 : r]
    ma, mb = mean(a), mean(b)
    a, b = np.where(known, a - ma, 0.0), np.where(known, b - mb, 0.0)
    return len(x), np.stack([n, ma, mb]), np.stack([(a * a).sum(0), (b * b).sum(0), (a * b).sum(0)])


def _merged_pairs(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return b if not a[0] else a
    (n, x, y), (m, u, v) = a[1], b[1]
    total = n + m
    share = np.divide(m, total, out=np.zeros(len(n)), where=total > 0)
    dx, dy = u - x, v - y
    return a[0] + b[0], np.stack([total, x + dx * share, y + dy * share]), a[2] + b[2] + np.stack([dx * dx, dy * dy, dx * dy]) * n * share


def _gathered(rows: DataFrame, parts: Sequence[Part], y: str, measure: Callable, merge: Callable, depth: int) -> DataFrame:
    """(part, n, mean, cross) of every part in one read of the rows.

    A task hands on one row per part, whatever it read, and these are merged in two rounds. Products are taken around
    the mean of each batch, so large levels lose no digits. ``depth`` is the number of rows of ``mean``.
    """
    columns = sorted({c for p in parts for c in (*p.required, *p.optional)} - {y})
    wide = rows.where(F.col("train_from").isNotNull()).select("step", "train_from", *[F.col(c).cast("double").alias(c) for c in (y, *columns)])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [(0, 0.0, 0.0)] * len(parts)
        for batch in batches:
            state = [merge(s, measure(batch, part, y)) for s, part in zip(state, parts)]
        for k, (n, mean, cross) in enumerate(state):
            if n:
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.record_batch([pa.array([v], t) for v, t in zip((k, n, mean.ravel(), cross.ravel()), kinds)], ["part", "n", "mean", "cross"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        state: tuple = (0, 0.0, 0.0)
        for n, mean, cross in zip(frame["n"], frame["mean"], frame["cross"]):
            mean = np.asarray(mean).reshape(depth, -1)
            state = merge(state, (n, mean, np.asarray(cross).reshape(-1, mean.shape[1])))
        return pd.DataFrame([[frame["part"].iloc[0], state[0], state[1].ravel(), state[2].ravel()]], columns=["part", "n", "mean", "cross"])

    kinds = "part int, n long, mean array<double>, cross array<double>"
    found = wide.mapInArrow(collect, kinds).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    found = found.groupBy("part", "_salt").applyInPandas(join, kinds)
    return found.groupBy("part").applyInPandas(join, kinds)


def _filled(part: Part, n: int, mean: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and products of (required, optional, response) where missing optional terms hold their mean.

    A filled term is ``x0 - mean * there + mean`` with x0 0 where it is missing: a combination of the variables that were summed up.
    """
    r, k = len(part.required), len(part.optional)
    there = mean[r + 1 + k :]
    center = np.divide(mean[r + 1 : r + 1 + k], there, out=np.zeros(k), where=there > 0)
    turn = np.zeros((r + k + 1, len(mean)))
    turn[range(r), range(r)] = 1
    for i in range(k):
        turn[r + i, r + 1 + i], turn[r + i, r + 1 + k + i] = 1, -center[i]
    turn[r + k, r] = 1
    return np.concatenate([mean[:r], center, [mean[r]]]), turn @ cross @ turn.T, there * n


def solution(cross: np.ndarray, n: int, chosen: Sequence[int]) -> np.ndarray | None:
    """Weights of the chosen terms (the last variable is the response); None when they are too many or nearly dependent."""
    chosen = list(chosen)
    if n <= len(chosen) + 1:
        return None
    size = np.sqrt(np.diag(cross)[chosen])
    if not (size > 0).all():
        return None
    try:
        lower = np.linalg.cholesky(cross[np.ix_(chosen, chosen)] / np.outer(size, size))
    except np.linalg.LinAlgError:
        return None
    if (np.diag(lower) ** 2 < TOLERANCE).any():
        return None
    half = np.linalg.solve(lower, cross[chosen, -1] / size)
    return np.linalg.solve(lower.T, half) / size


def fit(rows: DataFrame, parts: Sequence[Part], y: str, fallbacks: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """One row per part (step, fold, ``MODEL``): the least squares of ``y`` on its terms.

    Where a part has too few rows or its terms are dependent, the first of ``fallbacks`` (lists of terms) that can be solved is taken, at
    last the mean alone; ``rank`` tells which (0: all terms). A part without rows gives no model.
    """
    parts = list(parts)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                part = parts[r["part"]]
                mean = np.array(r["mean"])
                mean, cross, _ = _filled(part, r["n"], mean, np.array(r["cross"]).reshape(len(mean), -1))
                names = [*part.required, *part.optional]
                weights = np.zeros(0)
                for rank, wanted in enumerate([names, *fallbacks, ()]):
                    chosen = [i for i, c in enumerate(names) if c in wanted]
                    found = solution(cross, r["n"], chosen) if chosen else np.zeros(0)
                    if found is not None:
                        weights = found
                        break
                out.append((part.step, part.fold, r["n"], [names[i] for i in chosen], weights.tolist(), mean[chosen].tolist(), float(mean[-1]), rank))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["step", "fold", "n", "terms", "weights", "means", "y_mean", "rank"])

    return _gathered(rows, parts, y, _whole, _merged, 1).mapInArrow(solve, "step int, fold int, " + MODEL)


def scores(rows: DataFrame, parts: Sequence[Part], y: str) -> DataFrame:
    """(step, fold, feature, f): the F statistic of the simple regression of ``y`` on each optional term over the rows of
    the part that have it."""
    parts = [p for p in parts if p.optional]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                part = parts[r["part"]]
                n, _, _ = np.reshape(r["mean"], (3, -1))
                xx, yy, xy = np.reshape(r["cross"], (3, -1))
                square = np.divide(xy * xy, xx * yy, out=np.full(len(n), np.nan), where=(xx > 0) & (yy > 0))
                f = np.divide(square * (n - 2), 1 - square, out=np.full(len(n), np.nan), where=square < 1)
                columns = [pa.array(np.full(len(n), v, np.int32)) for v in (part.step, part.fold)]
                yield pa.record_batch([*columns, pa.array(part.optional), pa.array(f, from_pandas=True)], ["step", "fold", "feature", "f"])

    return _gathered(rows, parts, y, _pairs, _merged_pairs, 3).mapInArrow(told, "step int, fold int, feature string, f double")


def predict(rows: DataFrame, models: DataFrame, terms: Sequence[str], name: str = "y_pred") -> DataFrame:
    """Rows with the prediction of the model of their (step, fold); a missing term counts as its mean in training."""
    values = F.create_map(*[x for c in terms for x in (F.lit(c), F.col(c).cast("double"))]) if terms else F.create_map()
    joined = matched(rows, models.select("step", "fold", F.struct("terms", "weights", "means", "y_mean").alias("_m")), ["step", "fold"])
    m = F.col("_m")
    apart = F.transform(m["terms"], lambda t, i: F.coalesce(F.get(m["weights"], i) * (values[t] - F.get(m["means"], i)), F.lit(0.0)))
    return joined.withColumn(name, m["y_mean"] + F.aggregate(apart, F.lit(0.0), lambda a, b: a + b)).drop("_m")
