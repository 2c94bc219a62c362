"""Resampling of irregular or finer series to a calendar frequency."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.expr import from_micros, half_even, micros
from gaugeline.operators.chunks import expand_slots, same

SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86_400}


@dataclass(frozen=True)
class Frequency:
    """Bins of ``count`` steps of ``seconds``, weeks or months; calendar bins are counted by ordinals.

    A week has the ordinal of the ``anchor`` weekday that ends it, ``size`` months (1, 3 or 12) one that grows by 1 from period to
    period, ``anchor`` months from the year's first. ``ends``: labelled by the last day, else by the first.
    """

    kind: str
    count: int = 1
    seconds: int = 0
    size: int = 1
    anchor: int = 0
    ends: bool = True

    def ordinal(self, t: Column) -> Column:
        """The number of the period that holds ``t``."""
        if self.kind == "week":
            return F.ceil((F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")) - self.anchor) / F.lit(7))
        return F.floor(((F.year(t) - 1970) * 12 + F.month(t) - 1 - self.anchor) / F.lit(self.size))

    def bin_of(self, ordinal: Column, first: Column) -> Column:
        """The period that names the bin: bins of several periods count from the first one of the series."""
        apart = (ordinal - first) / F.lit(self.count)
        return (first + (F.ceil(apart) if self.ends else F.floor(apart)) * self.count).cast("bigint")

    def label(self, ordinal: Column) -> Column:
        epoch = F.lit("1970-01-01").cast("date")
        if self.kind == "week":
            return F.date_add(epoch, (ordinal * 7 + self.anchor).cast("int")).cast(T.TimestampNTZType())
        month = ordinal * self.size + self.anchor + (self.size - 1 if self.ends else 0)
        day = F.add_months(epoch, month.cast("int"))
        return (F.last_day(day) if self.ends else day).cast(T.TimestampNTZType())


WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def parse_frequency(freq: str) -> Frequency:
    """A count and a unit: ``15min``, ``5h``, ``2D``; ``W`` or ``2W-WED`` (weeks ending that day); ``ME``, ``MS``, ``QE``, ``QS``, ``YE``,
    ``YS`` (ends and starts of months, quarters and years, these two with the month they end or start in, as ``QE-NOV``)."""
    found = re.fullmatch(r"(\d*)(?:(s|min|h|D)|W(?:-([A-Z]{3}))?|(M)(E|S)|([QY])(E|S)(?:-([A-Z]{3}))?)", freq)
    count = int(found.group(1) or 1) if found else 0
    if not count:
        raise ValueError(f"unknown frequency: {freq}")
    _, unit, day, month, side, longer, longer_side, anchor = found.groups()
    if unit:
        return Frequency("step", count, count * SECONDS[unit])
    if month:
        return Frequency("month", count, ends=side == "E")
    if longer:
        ends, size = longer_side == "E", 3 if longer == "Q" else 12
        anchor = anchor or ("DEC" if ends else "JAN")
        if anchor not in MONTHS:
            raise ValueError(f"unknown month: {anchor}")
        return Frequency("month", count, size=size, anchor=(MONTHS.index(anchor) + (1 if ends else 0)) % size, ends=ends)
    if (day or "SUN") not in WEEKDAYS:
        raise ValueError(f"unknown weekday: {day}")
    # 1970-01-01 was a Thursday.
    return Frequency("week", count, anchor=(WEEKDAYS.index(day or "SUN") - 3) % 7)


def _rule(name: str, rule: str, ts: str) -> Column:
    c = F.col(name)
    if rule == "first":
        return F.min_by(c, F.when(c.isNotNull(), F.struct(ts, c)))
    return {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[rule](c)


def resample(
    df: DataFrame,
    key: str,
    ts: str,
    freq: str,
    rules: dict[str, str],
    digits: int | None = 3,
    status_suffix: str = "_Status",
    emit_empty: bool = True,
) -> DataFrame:
    """Reduce each series to bins of ``freq``.

    Fixed steps are labelled by their start. Steps that do not divide a day start at midnight of the first day of each
    series and run on. Weeks are labelled by the day they end on, months, quarters and years by their last day or their first
    one; bins of several of them start with the period of the series' first reading. Bins without readings
    between the first and last reading of a series appear with NULLs. Values other than status codes are rounded half
    to even.
    """
    frequency = parse_frequency(freq)
    fixed, step = frequency.kind == "step", frequency.seconds
    rules = {c: r for c, r in rules.items() if c in df.columns}
    span = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    width = F.lit(step * 1_000_000)
    origin = F.lit(0)
    # What bins count from, where that is not the same for all series.
    start = micros(F.date_trunc("day", "_lo")) if fixed else frequency.ordinal(F.col("_lo"))
    if (fixed and 86_400 % step) or (not fixed and frequency.count > 1):
        starts = span.select(key, start.alias("_origin"))
        df = df.alias("l").join(starts.alias("r"), same([key])).select("l.*", "_origin")
        span = span.alias("l").join(starts.alias("r"), same([key])).select("l.*", "_origin")
        origin = F.col("_origin")

    def bin_of(t: Column) -> Column:
        return F.floor((micros(t) - origin) / width) if fixed else frequency.bin_of(frequency.ordinal(t), origin)

    def label(number: Column) -> Column:
        return from_micros(number * width + origin) if fixed else frequency.label(number)

    binned = (
        df.withColumn("_bin", label(bin_of(F.col(ts))))
        .groupBy(key, "_bin")
        .agg(*[_rule(c, r, ts).alias(c) for c, r in rules.items()])
        .withColumnRenamed("_bin", ts)
    )
    if digits is not None:
        rounded = {
            c for c, r in rules.items()
            if r != "first" and not c.endswith(status_suffix) or isinstance(df.schema[c].dataType, T.DoubleType)
        }
        binned = binned.select(*[half_even(c, digits).alias(c) if c in rounded else F.col(c) for c in binned.columns])
    if not emit_empty:
        return binned
    # Bins in between are numbers ``count`` apart.
    apart = 1 if fixed else frequency.count
    slots = expand_slots(span, [key], F.lit(0), ((bin_of(F.col("_hi")) - bin_of(F.col("_lo"))) / F.lit(apart)).cast("bigint"), "_slot")
    bins = slots.select(key, label(bin_of(F.col("_lo")) + F.col("_slot") * apart).alias(ts))
    made = [c for c in binned.columns if c not in (key, ts)]
    return bins.alias("l").join(binned.alias("r"), same([key, ts]), "left").select("l.*", *[F.col(f"r.{c}") for c in made])
