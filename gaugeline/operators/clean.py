"""Row-level cleaning: types, derived status codes, time cuts, sensor fallback, negatives, aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import schema as S
from gaugeline.functions.expr import col, micros, micros_of, no_nan, parse_code, parse_number, parse_time, through_day
from gaugeline.schema import SeriesSchema


def derived_status(value: str | Column) -> Column:
    return F.when(col(value).isNotNull(), S.NORMAL).otherwise(S.FILLED).cast("bigint")


def completed_status(value: str | Column, status: str | Column) -> Column:
    """4 where the value is missing, 0 where a value has no code, else the code."""
    return F.when(col(value).isNull(), F.lit(S.FILLED)).otherwise(F.coalesce(col(status), F.lit(S.NORMAL))).cast("bigint")


def cast_status(df: DataFrame, suffix: str = S.STATUS_SUFFIX) -> DataFrame:
    return df.select(*[parse_code(c).alias(c) if c.endswith(suffix) else F.col(c) for c in df.columns])


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Text columns to double, text that is no number to NULL."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in text else F.col(c) for c in df.columns])


def rejects(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, how many texts are present but no number."""
    bad = [F.count_if(F.col(c).isNotNull() & parse_number(c).isNull()).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], list(columns), "column", "rejected")


def clean(
    df: DataFrame,
    schema: SeriesSchema = SeriesSchema(),
    lo: str | None = S.START_DATE,
    hi: str | None = S.END_DATE,
    fallback: dict[str, str] | None = None,
    derive: Sequence[str] = S.SIGNED,
    times: Sequence[str] = (S.UPDATED,),
) -> DataFrame:
    """Typed telemetry inside [lo, hi], with gaps of a main sensor taken from its fallback and marked 4.

    One projection and one filter, so the scan reads only what is asked for and the time range reaches the files when
    the timestamp is stored as one.
    """
    fallback = S.FALLBACK if fallback is None else fallback
    fallback = {a: b for a, b in fallback.items() if a in df.columns and b in df.columns}
    if lo is not None:
        df = df.filter(parse_time(schema.ts) >= F.lit(lo).cast(T.TimestampNTZType()))
    if hi is not None:
        df = df.filter(parse_time(schema.ts) <= F.lit(hi).cast(T.TimestampNTZType()))
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    number = {c: parse_number(c) if c in text else no_nan(F.col(c).cast("double")) for c in df.columns if c not in (schema.key, schema.ts, *times)}
    out: list[Column] = []
    for c in df.columns:
        if c == schema.key:
            out.append(F.col(c).cast("string").alias(c))
        elif c == schema.ts or c in times:
            out.append(parse_time(c).alias(c))
        elif c.endswith(schema.status_suffix):
            main = c.removesuffix(schema.status_suffix)
            code = parse_code(c)
            if main in fallback:
                filled = number[main].isNull() & number[fallback[main]].isNotNull()
                code = F.when(filled, F.lit(S.FILLED).cast("bigint")).otherwise(code)
            out.append(code.alias(c))
        elif c in fallback:
            out.append(F.coalesce(number[c], number[fallback[c]]).alias(c))
        else:
            out.append(number[c].alias(c))
    for c in derive:
        if c in df.columns and schema.status(c) not in df.columns:
            out.append(derived_status(number[c]).alias(schema.status(c)))
    return df.select(*out)


def drop_negatives(df: DataFrame, schema: SeriesSchema = SeriesSchema(), keep_code: bool = False) -> DataFrame:
    """NULL for negative values of unsigned metrics, then complete the status codes.

    The removed value is missing by the time codes are completed, so its code becomes 4; ``keep_code`` leaves 2.
    """
    out = []
    for c in df.columns:
        main = c.removesuffix(schema.status_suffix)
        if c in schema.values:
            out.append((F.col(c) if c in schema.signed else F.when(F.col(c) >= 0, F.col(c))).alias(c))
        elif c != main and main in schema.values:
            left = F.col(main) if main in schema.signed else F.when(F.col(main) >= 0, F.col(main))
            code = completed_status(left, c)
            if keep_code and main not in schema.signed:
                code = F.when(F.col(main) < 0, F.lit(S.BAD).cast("bigint")).otherwise(code)
            out.append(code.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def rename_key(df: DataFrame, key: str = S.KEY) -> DataFrame:
    """Give the key column its expected case."""
    found = next((c for c in df.columns if c.lower() == key.lower()), key)
    return df.withColumnRenamed(found, key)


def merge_aliases(
    df: DataFrame, aliases: dict[str, str], key: str = S.KEY, ts: str = S.TS, valid: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Relabel backup stations to their main station in one pass.

    ``aliases`` is a constant of the study, so it becomes a literal map. ``valid`` limits an alias to [from, to); rows
    of the backup outside its range are left out.
    """
    if not aliases:
        return df
    pairs = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    for backup, (lo, hi) in (valid or {}).items():
        inside = (F.col(ts) >= F.lit(lo).cast(T.TimestampNTZType())) & (F.col(ts) < F.lit(hi).cast(T.TimestampNTZType()))
        df = df.filter(~F.col(key).eqNullSafe(F.lit(backup)) | inside)
    return df.withColumn(key, F.coalesce(F.try_element_at(pairs, F.col(key)), F.col(key)))


def end_cut(df: DataFrame, ts: str, day: str | None) -> DataFrame:
    return df if day is None else df.filter(through_day(ts, day))


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=list(columns)) if columns is not None else df.na.fill(0)


def off_grid(df: DataFrame, key: str, ts: str, step: int, origin: str = "1970-01-01") -> DataFrame:
    """Readings per series that no grid slot will match, and readings that share a slot with another one."""
    off = F.pmod(micros(ts) - F.lit(micros_of(origin)), F.lit(step * 1_000_000)) != 0
    per_slot = df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"), F.max(off).alias("off"))
    return per_slot.groupBy(key).agg(
        F.sum("n").alias("readings"),
        F.sum(F.when(F.col("off"), F.col("n")).otherwise(0)).alias("off_grid"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated"),
    )
