"""Boosted trees over few features, fitted from sums per cell in place of a pass over the rows for every level of every tree.

A tree only sees the bin of each value, so rows with the same bins (a cell) are alike to it. Of squared error it needs per cell how
many rows a tree's subsample holds and the sum of their targets: what the trees before have told is the same for a whole cell and
is taken off afterwards. Which rows a tree draws depends on the place of the row alone, so one pass over all rows gives
the sums of all trees (a few passes where cells are very many), and trees grow on the driver from a table of a bounded size.
The split candidates, the draws of rows and the trees are those of ``GBTRegressor`` on the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Cells at most, four features of 32 bins; sums (trees times cells) a task holds at a time; sums in one piece.
CELLS, SUMS, PIECE = 1 << 20, 1 << 22, 1 << 16
#: Rows drawn at a time: lanes of a generator that run side by side, and rows of a lane.
LANES, STEPS = 1 << 12, 1 << 5
_M32, _M64 = (1 << 32) - 1, (1 << 64) - 1
_U = np.uint64


def _hash32(data: bytes, seed: int) -> int:
    """Murmur3 of whole blocks of 4 bytes."""
    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & _M32
        k = (k << 15 | k >> 17) * 0x1B873593 & _M32
        h ^= k
        h = ((h << 13 | h >> 19) & _M32) * 5 + 0xE6546B64 & _M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M32
    return h ^ h >> 16


def _start(seed: int) -> int:
    """The state of Spark's ``XORShiftRandom`` after ``setSeed(seed)``."""
    data = (seed & _M64).to_bytes(8, "big")
    low = _hash32(data, 0x3C074A61)
    return _hash32(data, low) << 32 | low


def _next(state: int) -> int:
    state ^= state << 21 & _M64
    state ^= state >> 35
    return state ^ state << 4 & _M64


def _chances(state: int) -> Iterator[float]:
    """``nextDouble`` of Spark's generator, again and again."""
    while True:
        high = _next(state)
        state = _next(high)
        yield ((high & (1 << 26) - 1) * (1 << 27) + (state & (1 << 27) - 1)) * 2.0**-53


def _jump(rows: int) -> np.ndarray:
    """Tables (8, 256) that carry a state on by two steps for each of ``rows``: the steps are linear over the bits."""

    def applied(columns: list[int], state: int) -> int:
        out = 0
        while state:
            out ^= columns[(state & -state).bit_length() - 1]
            state &= state - 1
        return out

    power, square, left = [1 << k for k in range(64)], [_next(1 << k) for k in range(64)], 2 * rows
    while left:
        if left & 1:
            power = [applied(square, c) for c in power]
        square, left = [applied(square, c) for c in square], left >> 1
    return np.array([[applied(power, byte << 8 * k) for byte in range(256)] for k in range(8)], _U)


def _carried(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for k in range(8):
        out ^= table[k][(states >> _U(8 * k) & _U(255)).astype(np.intp)]
    return out


class Draws:
    """Which rows of a partition a tree draws, ``LANES * STEPS`` rows at a time: (step, lane), row number lane * STEPS + step."""

    def __init__(self, seed: int, rate: float, lane: np.ndarray, block: np.ndarray):
        self.block, self.least = block, _U(math.ceil(rate * 2**53))
        states = np.array([_start(seed)], _U)
        for table in lane:  # each doubles the lanes
            states = np.concatenate([states, _carried(table, states)])
        self.states = states

    def take(self) -> np.ndarray:
        s, now = self.states, np.empty_like(self.states)
        taken = np.empty((STEPS, LANES), bool)

        def step() -> None:
            for shift, by in ((np.left_shift, 21), (np.right_shift, 35), (np.left_shift, 4)):
                shift(s, _U(by), out=now)
                np.bitwise_xor(s, now, out=s)

        for k in range(STEPS):
            step()
            high = (s & _U((1 << 26) - 1)) << _U(27)
            step()
            np.less(high | (s & _U((1 << 27) - 1)), self.least, out=taken[k])
        self.states = _carried(self.block, s)
        return taken


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For ``Draws``: from a lane on to those after it, and from the end of a lane to its rows in the next block."""
    doubling = [_jump(STEPS << k) for k in range(LANES.bit_length() - 1)]
    return np.stack(doubling), _jump(STEPS * (LANES - 1))


def _long_after(seed: int, times: int) -> int:
    """The last of so many ``nextLong`` of ``java.util.Random(seed)``."""
    state, parts = (seed ^ 0x5DEECE66D) & (1 << 48) - 1, [0, 0]
    for k in range(2 * times):
        state = state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        half = state >> 16
        parts[k & 1] = half - (1 << 32) if half >> 31 else half
    return (parts[0] << 32) + parts[1] & _M64


def _places(fraction: float, seed: int) -> Iterator[int]:
    """The rows of a partition that ``RDD.sample`` takes, in order and without end."""
    chances, at = _chances(_start(seed)), 0
    if fraction <= 0.4:
        gap = lambda: int(min(math.log(max(next(chances), 5e-11)) / math.log1p(-fraction), 2**31 - 1))
        at = gap()
        while True:
            yield at
            at += 1 + gap()
    while True:
        if next(chances) <= fraction:
            yield at
        at += 1


def _candidates(fraction: float, seed: int):
    """The rows from which split candidates are told: of very many rows those Spark samples for them (about 10,000)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _start(seed)
        state = _next(first) & _M32
        signed = state - (1 << 32) if state >> 31 else state
        places = _places(fraction, _long_after(signed, TaskContext.get().partitionId() + 1))
        at, lo = next(places), 0
        for batch in batches:
            own = []
            while at < lo + batch.num_rows:
                own.append(at - lo)
                at = next(places)
            lo += batch.num_rows
            yield batch.take(pa.array(own, pa.int64()))

    return run


def _thresholds(values: np.ndarray, rows: float, most: int) -> np.ndarray:
    """Split candidates of a feature, ``most`` at most, from its sampled values: halfway between neighbours, all of them or those nearest to equal shares of ``rows``."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    counts = counts.astype(float)
    zeros = rows - counts.sum()
    if len(found) and zeros > np.finfo(float).eps * counts.sum() * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, zeros)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) <= most:
        return middle
    out, share, seen = [], rows / (most + 1), counts[0]
    target = share
    for k in range(1, len(found)):
        before, seen = seen, seen + counts[k]
        if abs(before - target) < abs(seen - target):
            out.append(middle[k - 1])
            target += share
    return np.array(out)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """The columns of all batches, ``size`` rows at a time."""
    parts, held = [], 0
    for batch in batches:
        columns, lo = [c.to_numpy(zero_copy_only=False) for c in batch.columns], 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, lo + size - held)
            parts.append([c[lo:hi] for c in columns])
            held, lo = held + hi - lo, hi
            if held == size:
                yield [np.concatenate(c) for c in zip(*parts)]
                parts, held = [], 0
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def _count(out: np.ndarray, cell: np.ndarray, values: np.ndarray | np.int64) -> None:
    """Adds values at their cells: at once where cells are few, one by one where they are more than the rows."""
    if len(out) > LANES * STEPS:
        np.add.at(out, cell, values)
    else:
        out += np.bincount(cell, None if values.ndim == 0 else values, len(out)).astype(out.dtype, copy=False)


def _sums(thresholds: list[np.ndarray], trees: Sequence[int], seed: int, rate: float, tables: tuple):
    """Of a partition, in pieces of cells: how many rows of a cell each tree draws, and the sum of their targets."""
    cells = math.prod(len(t) + 1 for t in thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, draws = LANES * STEPS, None
        n, s = np.zeros((len(trees), cells + 1), np.int64), np.zeros((len(trees), cells + 1))  # the last cell takes what fills up a block
        for *features, y in _blocks(batches, size):
            cell = np.zeros(len(y), np.int64)
            for t, x in zip(thresholds, features):
                cell = cell * (len(t) + 1) + np.searchsorted(t, x)
            if rate < 1:
                if draws is None:
                    draws = [Draws(seed + t + TaskContext.get().partitionId() + 1, rate, *tables) for t in trees]
                cell = np.append(cell, np.full(size - len(y), cells)).reshape(LANES, STEPS).T.ravel()
                y = np.append(y, np.zeros(size - len(y))).reshape(LANES, STEPS).T.ravel()
                for k, draw in enumerate(draws):
                    taken = draw.take().ravel()
                    own = cell[taken]
                    _count(n[k], own, np.int64(1))
                    _count(s[k], own, y[taken])
            else:
                _count(n[0], cell, np.int64(1))
                _count(s[0], cell, y)
        if rate >= 1:
            n[:], s[:] = n[0], s[0]
        step = max(1, PIECE // len(trees))
        for lo in range(0, cells, step):
            own = slice(lo, min(lo + step, cells))
            if n[:, own].any():
                yield _piece(lo, n[:, own], s[:, own])

    return run


_PIECE = "place long, n binary, s binary"


def _piece(place: int, n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([place]), pa.array([n.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], ["place", "n", "s"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in the order of their place the sum of those of each place."""
    own = n = s = None
    for batch in batches:
        for place, *data in zip(*(batch.column(c) for c in ("place", "n", "s"))):
            more = [np.frombuffer(d.as_buffer(), kind) for d, kind in zip(data, (np.int64, float))]
            if place.as_py() == own:
                n, s = n + more[0], s + more[1]
                continue
            if own is not None:
                yield _piece(own, n, s)
            own, (n, s) = place.as_py(), more
    if own is not None:
        yield _piece(own, n, s)


def _tree(bins: np.ndarray, sizes: Sequence[int], n: np.ndarray, s: np.ndarray, depth: int, fewest: int, least: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """What a tree tells of each cell, and how much each feature gains in it; ``bins`` (feature, cell), ``sizes`` how many bins."""
    told, gains = np.zeros(len(n)), np.zeros(len(sizes))
    node, rows, total = np.zeros(len(n), np.int64), np.array([n.sum()], float), np.array([s.sum()])
    open_cells = np.arange(len(n))
    for level in range(depth + 1):
        mean = np.divide(total, rows, out=np.zeros(len(rows)), where=rows > 0)
        told[open_cells] = mean[node]
        if level == depth or not len(open_cells):
            break
        best, which, split, halves = np.full(len(rows), -1.0), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros((4, len(rows)))
        each = np.arange(len(rows))
        for f, size in enumerate(sizes):
            if size < 2:
                continue
            slot = node * size + bins[f, open_cells]
            left = [np.bincount(slot, v[open_cells], len(rows) * size).reshape(-1, size).cumsum(1) for v in (n, s)]
            (ln, ls), (rn, rs) = ([v[:, :-1] for v in left], [v[:, -1:] - v[:, :-1] for v in left])
            valid = (ln >= fewest) & (rn >= fewest) & (ln > 0) & (rn > 0)
            apart = ls / np.where(valid, ln, 1) - rs / np.where(valid, rn, 1)
            gain = np.where(valid, ln * rn / np.square(np.maximum(rows, 1))[:, None] * np.square(apart), -1.0)
            gain[gain < least] = -1.0
            at = gain.argmax(1)
            better = gain[each, at] > best
            best[better], which[better], split[better] = gain[each, at][better], f, at[better]
            halves[:, better] = np.stack([v[each, at] for v in (ln, ls, rn, rs)])[:, better]
        grows = best > noise
        gains += np.bincount(which[grows], best[grows] * rows[grows], len(sizes))
        inside = grows[node]
        open_cells, node = open_cells[inside], node[inside]
        right = bins[which[node], open_cells] > split[node]
        node = (grows.cumsum() - 1)[node] * 2 + right
        rows, total = (halves[[k, k + 2]][:, grows].T.ravel() for k in (0, 1))
    return told, gains


def importances(rows: DataFrame, features: Sequence[str], trees: GBTRegressor) -> np.ndarray | None:
    """The importance of each feature in ``trees`` fitted on ``rows``; None where they are not fitted this way: more than ``CELLS`` cells,
    trees that see a part of the features only, values that the fit refuses, no rows."""
    y, rate, seed, kinds = trees.getLabelCol(), trees.getSubsamplingRate(), trees.getSeed(), dict(zip(rows.columns, (f.dataType for f in rows.schema)))
    if trees.getFeatureSubsetStrategy() != "all":
        try:
            share = float(trees.getFeatureSubsetStrategy())
        except ValueError:
            return None
        if "." not in trees.getFeatureSubsetStrategy() or math.ceil(share * len(features)) < len(features):
            return None
    if not all(isinstance(kinds.get(c), NumericType) for c in (*features, y)):
        return None
    filled = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)]
    plain = rows.select(*filled, F.col(y).cast("double").alias("y"))
    odd = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in plain.columns]
    known = plain.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.greatest(*odd)).alias("odd"), F.avg(F.col("y") * F.col("y")).alias("square")).first()
    if not known["n"] or known["odd"] or not math.isfinite(known["square"]):
        return None

    most = min(trees.getMaxBins(), known["n"])
    wanted = max(most * most, 10000)
    fraction = min(1.0, wanted / known["n"])
    values = plain.drop("y")
    if fraction < 1:
        values = values.mapInArrow(_candidates(fraction, seed), values.schema)
    values = values.toArrow()
    thresholds = [_thresholds(c.to_numpy(), fraction * known["n"], most - 1) for c in values.columns]
    sizes = [len(t) + 1 for t in thresholds]
    cells, count = math.prod(sizes), trees.getMaxIter()
    if cells > CELLS:
        return None

    bins = np.stack(np.unravel_index(np.arange(cells), sizes)).astype(np.int16)
    told, total, tables = np.zeros(cells), np.zeros(len(sizes)), _tables() if rate < 1 else None
    step = max(1, SUMS // cells)
    for lo in range(0, count, step):
        own = range(lo, min(lo + step, count))
        pieces = plain.mapInArrow(_sums(thresholds, own, seed, rate, tables), _PIECE).repartition("place").sortWithinPartitions("place").mapInArrow(_added, _PIECE)
        n, s = np.zeros((len(own), cells)), np.zeros((len(own), cells))
        pieces = pieces.toArrow()
        for place, *data in zip(*(pieces.column(c) for c in ("place", "n", "s"))):
            for out, part, kind in zip((n, s), data, (np.int64, float)):
                part = np.frombuffer(part.as_buffer(), kind).reshape(len(own), -1)
                out[:, place.as_py() : place.as_py() + part.shape[1]] = part
        for k, tree in enumerate(own):
            target = 2 * (s[k] - n[k] * told) if tree else s[k]
            more, gains = _tree(bins, sizes, n[k], target, trees.getMaxDepth(), trees.getMinInstancesPerNode(), trees.getMinInfoGain(), 1e-26 * known["square"])
            told += more * (trees.getStepSize() if tree else 1.0)
            total += gains
    return total / total.sum() if total.any() else total
