"""Chronological splits: walk-forward folds, expanding inner folds, event windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.chunks import with_series_index


def row_count(indexed: DataFrame, idx: str = "idx") -> Column:
    """Number of rows as a scalar subquery; the data stays where it is."""
    return indexed.agg(F.coalesce(F.max(idx) + 1, F.lit(0)).alias("n")).scalar()


def _explode_roles(df: DataFrame, roles: Sequence[Column]) -> DataFrame:
    """One row per fold that uses the row, from its position and the row count ``_n``."""
    return df.select("*", F.inline(F.array(*roles))).filter(F.col("role").isNotNull()).drop("_n")


def walk_forward(df: DataFrame, ts: str, folds: int, block: int, embargo: int = 0, idx: str = "idx") -> DataFrame:
    """(row, fold, role): the last ``folds`` blocks are tested in turn, the block before validates, all before trains.

    ``fold`` counts from 1. ``embargo`` rows at the end of the training part are left out. Roles follow from the row's
    position alone: no join, and a training row is repeated once per fold because every fold trains on it.
    """
    rows = df if idx in df.columns else with_series_index(df, [], ts, idx)
    rows = rows.withColumn("_n", row_count(rows, idx))
    n = F.col("_n")
    roles = []
    for k in range(folds):
        test_start = n - (folds - k) * block
        place = F.col(idx)
        role = (
            F.when((place >= test_start) & (place < test_start + block), "test")
            .when((place >= test_start - block) & (place < test_start), "val")
            .when(place < test_start - block - embargo, "train")
        )
        roles.append(F.struct(F.lit(k + 1).alias("fold"), role.alias("role")))
    return _explode_roles(rows, roles)


def walk_forward_columns(rows: DataFrame, folds: int, block: int, embargo: int = 0, idx: str = "idx", step: str = "step") -> DataFrame:
    """The folds of ``walk_forward`` without repeating a row: ``train_from``, the first fold that trains on the row (every
    later one does), ``val_fold`` and ``test_fold``, each NULL where there is none.

    ``rows`` holds each row once per ``step``; a horizon of s steps has s rows less than the longest frame.
    """
    n = row_count(rows.select((F.col(idx) + F.col(step)).alias(idx)), idx) - F.col(step)
    left = n - F.col(idx)  # rows from this one to the end
    behind = F.floor((left - 1) / F.lit(block))
    first = F.greatest(F.lit(1), F.lit(folds + 3) - F.ceil((left - embargo) / F.lit(block)))
    trained = F.when((first <= folds) & (left > embargo), first).cast("int")
    return rows.withColumns({
        "train_from": trained,
        "val_fold": F.when(behind.between(1, folds), F.lit(folds + 1) - behind).cast("int"),
        "test_fold": F.when(behind < folds, F.lit(folds) - behind).cast("int"),
    })


def time_series_split(df: DataFrame, ts: str, splits: int, gap: int = 0, idx: str = "idx") -> DataFrame:
    """Expanding folds of equal test size ``n div (splits + 1)``; training ends ``gap`` rows before the test."""
    rows = df if idx in df.columns else with_series_index(df, [], ts, idx)
    rows = rows.withColumn("_n", row_count(rows, idx))
    n = F.col("_n")
    size = F.floor(n / F.lit(splits + 1))
    roles = []
    for k in range(splits):
        test_start = n - (splits - k) * size
        place = F.col(idx)
        role = F.when((place >= test_start) & (place < test_start + size), "test").when(place < test_start - gap, "train")
        roles.append(F.struct(F.lit(k + 1).alias("fold"), role.alias("role")))
    return _explode_roles(rows, roles)


def expanding_columns(rows: DataFrame, splits: int, gap: int = 0, tail: float = 0.1, idx: str = "idx") -> DataFrame:
    """The folds of ``time_series_split`` without repeating a row, as ``walk_forward_columns`` has them.

    The last ``tail`` of a block before each gap validates instead of training, so that fits can stop early.
    """
    n = row_count(rows, idx)
    left = n - F.col(idx)
    size = F.greatest(F.floor(n / F.lit(splits + 1)), F.lit(1))
    last = F.floor(size * tail)
    behind = F.floor((left - 1) / size)
    before = left - gap - 1
    first = F.greatest(F.lit(1), F.lit(splits + 2) - F.ceil((left - gap - last) / size))
    block = F.floor(before / size)
    late = (before >= 0) & block.between(1, splits) & (before - block * size < last)
    return rows.withColumns({
        "train_from": F.when((first <= splits) & (left > gap + last), first).cast("int"),
        "val_fold": F.when(late, F.lit(splits + 1) - block).cast("int"),
        "test_fold": F.when(behind < splits, F.lit(splits) - behind).cast("int"),
    })


def event_split(df: DataFrame, ts: str, start: str, end: str, block: int) -> DataFrame:
    """``role``: test inside [start, end), val the last ``block`` rows before it, train the rest before it.

    Empty when no row falls into the event.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    used = df.filter(F.col(ts) < hi)
    rows = with_series_index(used, [], ts, "_idx")
    known = used.agg(F.count_if(F.col(ts) < lo).alias("n")).scalar()
    tested = used.agg(F.count_if(F.col(ts) >= lo).alias("n")).scalar()
    role = F.when(F.col(ts) >= lo, "test").when(F.col("_idx") >= known - block, "val").otherwise("train")
    return rows.filter(tested > 0).withColumn("role", role).drop("_idx")


def tail(df: DataFrame, ts: str, rows: int, then: Sequence[str] = ()) -> DataFrame:
    """The last ``rows`` rows of the frame; ``then`` orders rows of one timestamp. Each partition hands on its last rows only."""
    return df.orderBy(*[F.col(c).desc() for c in (ts, *then)]).limit(rows)
