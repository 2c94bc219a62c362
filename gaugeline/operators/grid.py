"""Regular time grids and joins onto them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.expr import floor_time, micros_of, slot_time
from gaugeline.operators.chunks import expand_slots, same


def slots_between(lo: str, hi: str, step: int) -> int:
    """Number of grid slots from ``lo`` to ``hi``, both inclusive."""
    return (micros_of(hi) - micros_of(lo)) // (step * 1_000_000) + 1


def grid(stations: DataFrame, key: str, ts: str, lo: str, hi: str, step: int, idx: str = "idx") -> DataFrame:
    """Every station at every slot of [lo, hi], with the slot's position ``idx`` from 0."""
    last = slots_between(lo, hi, step) - 1
    wide = expand_slots(stations.select(key).distinct(), [key], F.lit(0), F.lit(last), idx)
    return wide.withColumn(ts, slot_time(idx, step, micros_of(lo)))


def grid_join(
    readings: DataFrame, key: str, ts: str, lo: str, hi: str, step: int, idx: str = "idx", stations: DataFrame | None = None
) -> DataFrame:
    """Readings on the grid: a row per station and slot, readings off the grid dropped, duplicates kept."""
    slots = grid(readings if stations is None else stations, key, ts, lo, hi, step, idx)
    joined = slots.alias("l").join(readings.alias("r"), same([key, ts]), "left")
    return joined.select(*[F.col(f"l.{c}") for c in slots.columns], *[F.col(f"r.{c}") for c in readings.columns if c not in (key, ts)])


def to_slots(df: DataFrame, keys: Sequence[str], ts: str, step: int, rules: dict[str, Column]) -> DataFrame:
    """Floor timestamps to the grid and reduce each slot with the given aggregates."""
    return df.groupBy(*keys, floor_time(ts, step).alias(ts)).agg(*[c.alias(name) for name, c in rules.items()])


def one_per_slot(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per key, the lowest by ``order`` and then by the remaining columns.

    A mergeable minimum over structs, so copies fold before the shuffle.
    """
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns])
