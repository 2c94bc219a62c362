"""Ordered work on series of any length, in bounded pieces.

A plain window over one series sends the whole series to one task. Here a series is cut into chunks of consecutive
rows; a window runs per (series, chunk), and the few rows it must see beyond the chunk's edge are copied in (halo) or
summarised into one row per chunk (carry). The results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeline.functions.expr import slot
from gaugeline.session import checkpointed

MIN_CHUNK = 8192


def chunk_of(idx: str | Column, rows: int) -> Column:
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(c / F.lit(rows)).cast("bigint")


def halo_rows(before: int, after: int) -> int:
    """Chunk length that keeps the copied rows at a quarter of the data or less."""
    return max(MIN_CHUNK, 4 * (before + after))


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    rows: int | None = None,
) -> DataFrame:
    """Run ``build(frame, window)`` on (keys, chunk) windows that see ``before`` rows back and ``after`` ahead.

    ``idx`` counts the rows of a series without holes. The window is ordered by ``idx``; rows copied from other chunks
    are dropped again.
    """
    rows = rows or halo_rows(before, after)
    first = F.greatest(chunk_of(F.col(idx) - after, rows), F.lit(0).cast("bigint"))
    last = chunk_of(F.col(idx) + before, rows)
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    return build(spread, window).filter(F.col("_chunk") == chunk_of(idx, rows)).drop("_chunk")


def same(keys: Sequence[str], left: str = "l", right: str = "r") -> list[Column]:
    """Join conditions under which a missing key meets a missing key, so that no row is lost."""
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``keys`` as ``same`` does."""
    more = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same(keys), how).select("l.*", *more)


#: A table of at most so many groups goes to every task whole.
FEW_GROUPS = 10_000


def looked_up(left: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``matched`` with a table of one row per group, written once and counted. Where groups are few, many rows of ``left`` share
    one, and a join by group would send them to one task: the groups then go to the rows, which stay where they are."""
    groups = checkpointed(groups)
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return matched(left, F.broadcast(groups) if few else groups, keys)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "idx") -> DataFrame:
    """Number the rows of each series from 0; with no keys, number the whole frame.

    ``bucket`` is a whole number that never falls along ``order``, and holds a bounded number of rows of a series. Rows
    are counted per bucket, the counts are summed up over the (small) bucket table, and rows are numbered inside their
    bucket.
    """
    columns = df.columns
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    joined = df.alias("l").join(offsets.alias("r"), same(by)).select("l.*", "_offset")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return joined.withColumn(name, (F.col("_offset") + place).cast("bigint")).select(*columns, name)


def number_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx", copies: bool = False
) -> DataFrame:
    """``number_rows`` for any distribution: a hot series or a hot timestamp is spread over tasks like any other.

    The frame is sorted by ranges over all order columns and checkpointed, which fixes the partitions. A row's number
    is its place in the partition, less the place of its series' first row there, plus the rows of the series in
    earlier partitions. ``copies=True`` folds equal rows into one before the sort and unfolds them after it, for data
    where one reading may be copied any number of times.
    """
    columns = df.columns
    if copies:
        df = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    else:
        df = df.withColumn("_copies", F.lit(1).cast("bigint"))
    sort = [*keys, *order]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = checkpointed(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    by = [*keys, "_part"]
    sizes = placed.groupBy(*by).agg(F.sum("_copies").alias("_total"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_first", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    joined = placed.alias("l").join(offsets.alias("r"), same(by)).select("l.*", "_first", "_offset")
    if not copies:
        return joined.select(*columns, (F.col("_offset") + F.col("_place") - F.col("_first")).cast("bigint").alias(name))
    # Rows before this one in its partition count with their copies.
    before = Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("_copies").over(before), F.lit(0))
    spread = joined.withColumn("_start", start)
    made = expand_slots(spread, sort, F.col("_start"), F.col("_start") + F.col("_copies") - 1, name)
    return made.select(*columns, name)


def with_series_index(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    name: str = "idx",
    bucket_seconds: int | None = None,
    then: Sequence[str] = (),
    copies: bool = False,
) -> DataFrame:
    """Position of each row in its series in time order.

    Without ``then`` the timestamps of a series are taken to be distinct, and time buckets (a day per series, a quarter
    hour for a whole frame) bound the work per task. With ``then``, which orders equal timestamps, or with ``copies``,
    any number of rows may share a timestamp.
    """
    if then or copies:
        return number_sorted(df, keys, [ts, *then], name, copies)
    return number_rows(df, keys, [ts], slot(ts, bucket_seconds or (86_400 if keys else 900)), name)


def expand_slots(df: DataFrame, keys: Sequence[str], first: Column, last: Column, name: str = "slot") -> DataFrame:
    """One row per whole number from ``first`` to ``last``, both inclusive.

    Expanded in two steps with a shuffle of the short chunk list between them, so that a long range of one series is
    produced by many tasks. The number of partitions is given, because the list is small before it is expanded and
    adaptive execution would merge it into few tasks.
    """
    rows = F.lit(MIN_CHUNK)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (
        df.withColumn("_first", first.cast("bigint"))
        .withColumn("_last", last.cast("bigint"))
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                   F.floor((F.col("_last") - F.col("_first")) / rows))))
        .repartition(tasks, *keys, "_piece")
    )
    low = F.col("_first") + F.col("_piece") * rows
    return pieces.withColumn(name, F.explode(F.sequence(low, F.least(low + rows - 1, F.col("_last"))))).drop(
        "_first", "_last", "_piece"
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with ``cnt``, ``cum`` (rows at or below the value) and ``n`` (rows of the group).

    Equal values fold into one row before the shuffle. The folded rows are sorted by ranges over group and value and
    checkpointed, which fixes the ranges; a range of a group starts from the total of the ranges below it. One plan at
    every size: a task ranks no more rows than one range holds, also where one group has most of the values.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    placed = checkpointed(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    by = [*keys, "_part"]
    totals = placed.groupBy(*by).agg(F.sum("cnt").alias("_total"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"), F.sum("_total").over(group).alias("n"))
    joined = placed.alias("l").join(offsets.alias("r"), same(by)).select("l.*", "_offset", "n")
    running = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*keys, value, "cnt", (F.col("_offset") + F.sum("cnt").over(running)).alias("cum"), "n")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``probs`` (name -> share)."""
    ranks = value_ranks(df, keys, value)

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("n") - 1)
        below = F.min(F.when(F.col("cum") > F.floor(place), F.col(value)))
        above = F.min(F.when(F.col("cum") > F.ceil(place), F.col(value)))
        weight = F.max(place - F.floor(place))
        return below + (above - below) * weight

    return ranks.groupBy(*keys).agg(*[at(share).alias(name) for name, share in probs.items()])


def ranked_rows(df: DataFrame, keys: Sequence[str], value: str, spread: Column) -> DataFrame:
    """Rows that have a value, with ``below`` (rows of the group with a smaller one), ``cnt`` (rows with the same one) and ``n``.

    Rows are sorted by ranges over group, value and ``spread`` (any column that differs between rows), so a value that a third of all
    rows share lies in several ranges like any other rows. A range counts its own rows; totals carry on from range to range, and values
    at the edges of a range, of which there are at most four per range, are counted over all ranges and broadcast. No row is joined
    by its value.
    """
    keys, columns = list(keys), df.columns
    sort = [*keys, value]
    ranged = df.filter(F.col(value).isNotNull()).withColumn("_rk_spread", spread).repartitionByRange(*sort, "_rk_spread").sortWithinPartitions(*sort)
    placed = checkpointed(ranged.select(*columns, F.spark_partition_id().alias("_rk_part")))
    by = [*keys, "_rk_part"]
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_rk_size"), F.min(value).alias("_rk_lo"), F.max(value).alias("_rk_hi"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpointed(
        sizes.select("*", F.coalesce(F.sum("_rk_size").over(earlier), F.lit(0)).alias("_rk_offset"), F.sum("_rk_size").over(group).alias("n"))
    )
    split = sizes.filter(F.col("_rk_size") < F.col("n")).drop("n")
    edge = placed.select(*by, value).alias("l").join(F.broadcast(split).alias("r"), same(by)).select("l.*", "_rk_size", "_rk_lo", "_rk_hi", "_rk_offset")
    edge = edge.filter((F.col(value) == F.col("_rk_lo")) | (F.col(value) == F.col("_rk_hi"))).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_rk_size").alias("_rk_size"), F.first("_rk_lo").alias("_rk_lo"), F.first("_rk_offset").alias("_rk_offset")
    )
    under = F.col("_rk_offset") + F.when(F.col(value) == F.col("_rk_lo"), 0).otherwise(F.col("_rk_size") - F.col("_c"))
    edge = edge.groupBy(*keys, value).agg(F.min_by(under, "_rk_part").alias("_rk_under"), F.sum("_c").alias("_rk_all"))
    inside = Window.partitionBy(*by)
    counted = placed.select(
        "*", F.count(F.lit(1)).over(inside.orderBy(value)).alias("_rk_upto"), F.count(F.lit(1)).over(Window.partitionBy(*by, value)).alias("_rk_same")
    )
    joined = counted.alias("l").join(sizes.alias("r"), same(by)).select("l.*", "_rk_offset", "n")
    joined = joined.alias("l").join(F.broadcast(edge).alias("r"), same([*keys, value]), "left").select("l.*", "_rk_under", "_rk_all")
    below = F.coalesce(F.col("_rk_under"), F.col("_rk_offset") + F.col("_rk_upto") - F.col("_rk_same"))
    return joined.select(*columns, below.alias("below"), F.coalesce("_rk_all", "_rk_same").alias("cnt"), "n")


def sketch_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Percentiles from a mergeable sketch in one aggregate, without a sort: each is a value of the data whose rank is off by
    at most a share of ``1 / accuracy`` of the group's rows. ``percentiles`` gives the exact ones."""
    both = F.percentile_approx(value, list(probs.values()), accuracy)
    return df.groupBy(*keys).agg(both.alias("_p")).select(*keys, *[F.col("_p")[i].alias(name) for i, name in enumerate(probs)])
