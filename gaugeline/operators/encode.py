"""Encoding of feature columns: calendar cycles, median fill, scaling, one-hot. Fitted values are small tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import schema as S
from gaugeline.functions.expr import calendar, col, cyclical
from gaugeline.operators.chunks import looked_up, matched, number_sorted, percentiles


def nature_encode(df: DataFrame, column: str, period: float | str) -> DataFrame:
    """Add ``<column>_sin`` and ``<column>_cos``; ``period`` is a number or a column name."""
    return df.select("*", *cyclical(column, col(period) if isinstance(period, str) else F.lit(period), column))


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Replace the timestamp by the year and the calendar cycles."""
    if ts not in df.columns:
        raise ValueError(f"no timestamp column {ts}")
    return df.select(*[F.col(c) for c in df.columns if c != ts], *calendar(ts))


def fit_numeric(train: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group (a fold, say): median of each column, then mean and population deviation of the filled column.

    Medians are exact and found for all columns in one ranked pass; the moments of the filled column follow from the
    moments of the present values and the number of missing ones.
    """
    by = list(by)
    wide = train.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    moments = wide.unpivot(by, list(columns), "column", "_x").groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_x").alias("_k"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_v")
    )
    medians = percentiles(wide.unpivot(by, list(columns), "column", "_x"), [*by, "column"], "_x", {"median": 0.5})
    fitted = matched(moments, medians, [*by, "column"])
    share = F.col("_k") / F.col("_n")
    mean = share * F.col("_m") + (1 - share) * F.col("median")
    gap = F.col("_m") - F.col("median")
    var = share * F.col("_v") + share * (1 - share) * gap * gap
    scale = F.when(F.sqrt(var) > 0, F.sqrt(var)).otherwise(1.0)
    return fitted.select(*by, "column", "median", mean.alias("mean"), scale.alias("scale"))


def apply_numeric(df: DataFrame, fitted: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Fill with the group's median, subtract its mean and divide by its scale.

    The fitted table is pivoted to one row per group and looked up by the group; without groups its single row is a
    scalar subquery. A column without any value stays NULL.
    """
    by = list(by)
    names = [f"{c}_{p}" for c in columns for p in ("median", "mean", "scale")]
    wide = fitted.groupBy(*by).pivot("column", list(columns)).agg(
        F.first("median").alias("median"), F.first("mean").alias("mean"), F.first("scale").alias("scale")
    )
    packed = F.struct(*[F.col(f"`{n}`") for n in names]).alias("_fit")
    if by:
        joined = looked_up(df, wide.select(*by, packed), by)
    else:
        joined = df.withColumn("_fit", wide.select(packed).scalar())
    fit = F.col("_fit")
    out = []
    for c in df.columns:
        if c in columns:
            full = F.coalesce(F.col(c).cast("double"), fit[f"{c}_median"])
            out.append(((full - fit[f"{c}_mean"]) / fit[f"{c}_scale"]).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def categories(train: DataFrame, column: str, missing: int | str = 0) -> list:
    """The values seen in training, in order, with ``missing`` for NULL. Each becomes a column, so the driver must know them."""
    seen = train.select(F.coalesce(F.col(column), F.lit(missing)).alias("c")).distinct().orderBy("c")
    return [row["c"] for row in seen.toLocalIterator()]


def label(value: object) -> str:
    """A category as part of a column name; codes read as 4, also when held as 4.0."""
    whole = isinstance(value, float) and value.is_integer()
    return str(int(value) if whole else value).replace(".", "_")


def one_hot(df: DataFrame, values: dict[str, Sequence], missing: int | str = 0) -> DataFrame:
    """Replace each column by one 0/1 column per known value; a value not listed gives all zeros."""
    out = []
    for c in df.columns:
        if c not in values:
            out.append(F.col(c))
            continue
        filled = F.coalesce(F.col(c), F.lit(missing))
        out += [F.when(filled == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{label(v)}") for v in values[c]]
    return df.select(*out)


def routed(df: DataFrame, target: str | None, by: Sequence[str] = (), schema: S.SeriesSchema = S.SeriesSchema()) -> tuple[list[str], list[str]]:
    """The columns to scale and those to one-hot encode, by the roles of ``schema``."""
    kinds = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    numeric = [c for c in S.numeric_columns(df.columns, target, schema) if c not in by and kinds[c]]
    return numeric, [c for c in S.categorical_columns(df.columns, target, schema) if c not in by]


def encode(
    train: DataFrame, df: DataFrame, target: str | None, by: Sequence[str] = (), known: dict[str, Sequence] | None = None, schema: S.SeriesSchema = S.SeriesSchema()
) -> DataFrame:
    """Numeric columns filled and scaled, status and category columns one-hot encoded, all others passed through.

    Everything is fitted on ``train``; ``by`` names the groups that are fitted apart. Each known category becomes a column of its
    own; ``Encoder`` keeps them as tables and vectors instead. Categories may be given.
    """
    numeric, coded = routed(df, target, by, schema)
    status = lambda c: schema.status_suffix in c
    values = known or {c: categories(train, c, 0 if status(c) else "missing_value") for c in coded}
    scaled = apply_numeric(df, fit_numeric(train, numeric, by), numeric, by)
    text = {c: v for c, v in values.items() if not status(c)}
    made = one_hot(scaled, {c: v for c, v in values.items() if status(c)})
    return one_hot(made, text, "missing_value")


#: Columns with at most so many categories are looked up in a map that goes along with the group's fit; others are joined.
FEW = 64


def spelled(column: str, missing: str) -> Column:
    """A category as text: codes read as 4, also when held as 4.0, and ``missing`` stands for NULL."""
    text = F.col(column).cast("string")
    return F.coalesce(F.regexp_replace(text, r"^(-?\d+)\.0$", "$1"), F.lit(missing))


def _slots(n: int, place: Column) -> Column:
    """``n`` numbers, 1 at ``place`` and 0 elsewhere."""
    every = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    return F.transform(every, lambda i: F.when(i.eqNullSafe(place), 1.0).otherwise(0.0))


def entries_sum(vector: str, first: int = 0) -> Column:
    """The sum of a vector's entries from place ``first`` on. Only entries that are stored are read: a sparse vector of any size
    costs as much as it has entries."""
    held = F.unwrap_udt(vector)
    places = F.coalesce(held["indices"], F.slice(F.sequence(F.lit(0), F.size(held["values"])), F.lit(1), F.size(held["values"])))
    return F.aggregate(F.zip_with(places, held["values"], lambda i, x: F.when(i >= first, x).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)


@dataclass(frozen=True)
class Encoder:
    """A fitted encoding as tables, which are saved, loaded and joined.

    ``numbers`` holds a row (by..., column, median, mean, scale) per group and numeric column, ``words`` a row (by..., column,
    value, place) per category that the training rows of a group show. A place means the same category in every group; a
    category that the group's training rows do not show gives zeros. Categories stay in Spark, however many there are.
    """

    numbers: DataFrame
    words: DataFrame
    numeric: tuple[str, ...]
    coded: tuple[str, ...]
    by: tuple[str, ...] = ()
    missing: dict[str, str] = field(default_factory=dict)

    def save(self, folder: str) -> None:
        spark = self.numbers.sparkSession
        roles = [(list(self.numeric), list(self.coded), list(self.by), self.missing)]
        spark.createDataFrame(roles, "numeric array<string>, coded array<string>, by array<string>, missing map<string,string>").write.mode("overwrite").json(f"{folder}/roles")
        self.numbers.write.mode("overwrite").parquet(f"{folder}/numbers")
        self.words.write.mode("overwrite").parquet(f"{folder}/words")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Encoder:
        roles = spark.read.schema("numeric array<string>, coded array<string>, by array<string>, missing map<string,string>").json(f"{folder}/roles").first()
        numbers, words = spark.read.parquet(f"{folder}/numbers"), spark.read.parquet(f"{folder}/words")
        return Encoder(numbers, words, tuple(roles["numeric"]), tuple(roles["coded"]), tuple(roles["by"]), dict(roles["missing"] or {}))

    @cached_property
    def sizes(self) -> dict[str, int]:
        """Categories per column: one number for each, whatever their count."""
        found = {r["column"]: int(r["n"]) for r in self.words.groupBy("column").agg((F.max("place") + 1).alias("n")).collect()}
        return {c: found.get(c, 0) for c in self.coded}

    def names(self) -> list[str]:
        """What each place of the vector holds; columns with many categories are one name each, at their first place."""
        few = [c for c in self.coded if self.sizes[c] <= FEW]
        rows = self.words.where(F.col("column").isin(few)).select("column", "value", "place").distinct().collect() if few else []
        known = {(r["column"], r["place"]): r["value"] for r in rows}
        return [*self.numeric, *(f"{c}_{label(known[c, i])}" for c in few for i in range(self.sizes[c])), *(c for c in self.coded if c not in few)]

    def places(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the place of its category in ``name``, NULL for one the group's training rows do not show."""
        mine = self.words.where(F.col("column") == column).select(*self.by, F.col("value").alias("_value"), F.col("place").alias(name))
        keyed = df.withColumn("_value", spelled(column, self.missing.get(column, "")))
        return matched(keyed, mine, [*self.by, "_value"]).drop("_value")

    def apply(self, df: DataFrame, name: str = "features") -> DataFrame:
        """``df`` with the vector of its encoded columns: scaled numbers, then 0/1 per category; sparse where categories are many."""
        few = [c for c in self.coded if self.sizes[c] <= FEW]
        by = list(self.by)
        entry = F.struct("column", F.struct("median", "mean", "scale").alias("fit"))
        fits = self.numbers.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
        order = F.array(*map(F.lit, self.numeric)) if self.numeric else F.array().cast("array<string>")
        fits = fits.select(*by, F.transform(order, lambda c: F.col("_m")[c]).alias("_numbers"))
        group = self.words.where(F.col("column").isin(few)).groupBy(*by, "column").agg(F.map_from_entries(F.collect_list(F.struct("value", "place"))).alias("_places"))
        maps = group.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "_places"))).alias("_words"))
        joined = df
        for one in (fits, maps):
            if by:
                joined = matched(joined, one, by)
            else:
                joined = joined.withColumn(one.columns[-1], one.scalar())
        values = F.array(*[F.col(c).cast("double") for c in self.numeric]) if self.numeric else F.array().cast("array<double>")
        scaled = F.zip_with(values, "_numbers", lambda v, f: F.coalesce((F.coalesce(v, f["median"]) - f["mean"]) / f["scale"], F.lit(0.0)))
        made = [F.coalesce(scaled, F.transform(values, lambda v: F.lit(0.0)))]
        for c in few:
            place = F.col("_words")[c][spelled(c, self.missing.get(c, ""))]
            made.append(_slots(self.sizes[c], place))
        dense = joined.withColumn("_dense", array_to_vector(F.concat(*made))).drop("_numbers", "_words")
        many, parts = [c for c in self.coded if c not in few], ["_dense"]
        for k, c in enumerate(many):
            dense = self.places(dense, c, f"_p{k}").withColumn(f"_p{k}", F.coalesce(F.col(f"_p{k}"), F.lit(self.sizes[c])).cast("double"))
            parts.append(f"_v{k}")
        if many:
            # The place after the last stands for all others and has no slot of its own. The sizes are known, one row per size fits.
            largest = df.sparkSession.createDataFrame([[float(self.sizes[c] - 1) for c in many]], ", ".join(f"_p{k} double" for k in range(len(many))))
            hot = OneHotEncoder(inputCols=[f"_p{k}" for k in range(len(many))], outputCols=parts[1:], handleInvalid="keep")
            dense = hot.fit(largest).transform(dense)
        return VectorAssembler(inputCols=parts, outputCol=name).transform(dense).drop(*parts, *(f"_p{k}" for k in range(len(many))))


def fit_encoder(train: DataFrame, numeric: Sequence[str], coded: Sequence[str], by: Sequence[str] = (), schema: S.SeriesSchema = S.SeriesSchema()) -> Encoder:
    """Fits every group of ``by`` at once: medians, means and scales in one ranked pass, categories as distinct rows."""
    by = list(by)
    missing = {c: "0" if schema.status_suffix in c else "missing_value" for c in coded}
    if numeric:
        numbers = fit_numeric(train, numeric, by)
    else:
        numbers = train.select(*by, F.lit("").alias("column"), *[F.lit(0.0).alias(c) for c in ("median", "mean", "scale")]).limit(0)
    if coded:
        wide = train.select(*by, *[spelled(c, missing[c]).alias(c) for c in coded])
        seen = wide.unpivot(by, list(coded), "column", "value").distinct()
        every = seen.select("column", "value").distinct().withColumn("_number", F.expr("try_cast(value AS double)"))
        placed = number_sorted(every, ["column"], ["_number", "value"], "place").select("column", "value", F.col("place").cast("int").alias("place"))
        words = seen.join(placed, ["column", "value"]).select(*by, "column", "value", "place")
    else:
        words = train.select(*by, F.lit("").alias("column"), F.lit("").alias("value"), F.lit(0).alias("place")).limit(0)
    return Encoder(numbers, words, tuple(numeric), tuple(coded), tuple(by), missing)
