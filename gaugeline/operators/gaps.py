"""Runs of missing values on a grid, found from the observed positions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.chunks import MIN_CHUNK, chunk_of


def gap_blocks(df: DataFrame, keys: Sequence[str], idx: str, value: str, rows: int = MIN_CHUNK) -> DataFrame:
    """(keys, gap_start, gap_end, gap_length, kind) for every run of NULLs; ``gap_end`` is exclusive.

    Gaps inside a chunk come from neighbouring observations, gaps across chunks from one row per chunk, and the edge
    runs (``leading``, ``trailing``, ``all``) from one aggregate per series. The length of a gap does not matter.
    """
    keys = list(keys)
    valid = F.when(F.col(value).isNotNull(), F.col(idx))
    observed = df.filter(F.col(value).isNotNull()).select(*keys, idx, chunk_of(idx, rows).alias("_chunk"))

    def between(left: Column, right: Column) -> list[Column]:
        return [*[F.col(k) for k in keys], (left + 1).alias("gap_start"), right.alias("gap_end")]

    step = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    inside = observed.withColumn("_next", F.lead(idx).over(step)).filter(F.col("_next") - F.col(idx) > 1)
    inside = inside.select(*between(F.col(idx), F.col("_next")))

    chunks = observed.groupBy(*keys, "_chunk").agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    hop = Window.partitionBy(*keys).orderBy("_chunk")
    across = chunks.withColumn("_next", F.lead("_lo").over(hop)).filter(F.col("_next") - F.col("_hi") > 1)
    across = across.select(*between(F.col("_hi"), F.col("_next")))

    span = df.groupBy(*keys).agg(
        F.min(idx).alias("_first"), F.max(idx).alias("_last"), F.min(valid).alias("_lo"), F.max(valid).alias("_hi")
    )
    sides = F.array(
        F.struct(
            F.col("_first").alias("gap_start"),
            F.coalesce(F.col("_lo"), F.col("_last") + 1).alias("gap_end"),
            F.when(F.col("_lo").isNull(), "all").otherwise("leading").alias("kind"),
        ),
        F.struct(
            (F.col("_hi") + 1).alias("gap_start"), (F.col("_last") + 1).alias("gap_end"), F.lit("trailing").alias("kind")
        ),
    )
    edges = span.select(*keys, F.inline(sides)).filter(F.col("gap_end") > F.col("gap_start"))
    interior = inside.unionAll(across).withColumn("kind", F.lit("interior"))
    return interior.unionByName(edges).withColumn("gap_length", F.col("gap_end") - F.col("gap_start"))


def gap_distribution(df: DataFrame, keys: Sequence[str], idx: str, value: str) -> DataFrame:
    """How often each gap length occurs per series."""
    return gap_blocks(df, keys, idx, value).groupBy(*keys, "gap_length").agg(F.count(F.lit(1)).alias("gaps"))


def missing_rate(df: DataFrame, key: str, value: str, period: str) -> DataFrame:
    """Share of missing values per station in percent."""
    return df.groupBy(F.col(key).alias("station_id")).agg(
        F.lit(period).alias("period"),
        (F.lit(100.0) * F.count_if(F.col(value).isNull()) / F.count(F.lit(1))).alias("missing_percentage"),
    )
