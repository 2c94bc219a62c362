"""Column expressions shared by the operators. Time arithmetic expects a UTC session and ``timestamp_ntz`` columns."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime(1970, 1, 1)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: str | Column, digits: int) -> Column:
    """Round ties to even by scaling, as array libraries do; stays inside generated code."""
    scale = 10.0**digits
    return F.rint(col(c) * scale) / scale


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is zero (ANSI mode would fail the job)."""
    return a / F.nullif(b, F.lit(0.0))


def no_nan(c: str | Column) -> Column:
    """NaN to NULL, so that one kind of missing remains."""
    return F.when(~F.isnan(col(c)), col(c))


def parse_number(c: str | Column) -> Column:
    """Text with thousands commas to double; text that is no number becomes NULL."""
    return no_nan(F.replace(col(c).cast("string"), F.lit(","), F.lit("")).try_cast("double"))


def parse_code(c: str | Column) -> Column:
    return col(c).try_cast("bigint")


def parse_time(c: str | Column) -> Column:
    return col(c).try_cast(T.TimestampNTZType())


def clip(c: Column, low: Column, high: Column) -> Column:
    """Bound ``c``; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast(T.TimestampNTZType())


def micros_of(moment: str | datetime) -> int:
    """Microseconds since the epoch of a naive moment given as ISO text or datetime."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    delta = moment - EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def slot(ts: str | Column, step: int, origin: int = 0) -> Column:
    """Number of the ``step``-second slot that holds ``ts``, counted from ``origin`` (microseconds)."""
    return F.floor((micros(ts) - F.lit(origin)) / F.lit(step * 1_000_000)).cast("bigint")


def slot_time(number: str | Column, step: int, origin: int = 0) -> Column:
    return from_micros(col(number) * F.lit(step * 1_000_000) + F.lit(origin))


def floor_time(ts: str | Column, step: int) -> Column:
    return slot_time(slot(ts, step), step)


def through_day(ts: str | Column, day: str) -> Column:
    """True up to and including the whole calendar day."""
    return col(ts) < F.date_add(F.to_date(F.lit(day)), 1).cast(T.TimestampNTZType())


def cyclical(c: str | Column, period: Column | float, name: str) -> list[Column]:
    """``sin`` and ``cos`` of a position in a cycle; the period may differ per row."""
    angle = F.lit(2 * math.pi) * col(c) / period
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def calendar(ts: str | Column) -> list[Column]:
    """Year as a number, and month, hour, day of year, weekday (Monday 0) and day of month as cycles."""
    t = col(ts)
    return [
        F.year(t).cast("double").alias("year"),
        *cyclical(F.month(t), 12, "month"),
        *cyclical(F.hour(t), 24, "hour"),
        *cyclical(F.dayofyear(t), 365, "dayofyear"),
        *cyclical(F.weekday(t), 7, "dayofweek"),
        *cyclical(F.dayofmonth(t), F.dayofmonth(F.last_day(t)), "day"),
    ]
