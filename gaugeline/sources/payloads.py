"""Service payloads and the plan of requests that fetches them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import schema as S
from gaugeline.functions.expr import col


def read_items(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """One row per item of every payload file that has items. The schema is given, so files are read once."""
    payload = T.StructType([T.StructField("items", T.ArrayType(item))])
    return spark.read.schema(payload).option("multiLine", True).json(path).select(F.inline("items"))


def parse_items(df: DataFrame, payload: str, item: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The same for payloads held as text in a column."""
    envelope = T.StructType([T.StructField("items", T.ArrayType(item))])
    return df.select(*keep, F.from_json(F.col(payload), envelope)["items"].alias("_items")).select(*keep, F.inline("_items"))


def split_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """One row per code of comma-separated lists, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.col(column), ","), lambda x: F.trim(x))
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.explode(F.filter(parts, lambda x: x != "")).alias(name))


def chunk_plan(requests: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Cut each request's [start, end] into spans the service accepts, the largest first.

    Whole spans of 30 days, then at most one each of 21, 14 and 7, then spans of 2, and a last single day that is asked
    for as a span of 2. The plan follows from the number of days alone, so each request is planned by itself.
    """
    names = [f.name for f in requests.schema.fields if f.name not in (start, end)]
    s, e = F.to_date(col(start)), F.to_date(col(end))
    days = F.when(s > e, F.raise_error(F.lit("start_date cannot be after end_date")).cast("int")).otherwise(F.datediff(e, s) + 1)
    rows = requests.select(*names, s.alias("_s"), days.alias("_days"))
    long, *middle, pair = S.SPAN_DAYS
    rest = F.col("_days") % long
    tail: list[Column] = []
    for span in middle:
        tail.append(F.array_repeat(F.lit(span), F.floor(rest / span).cast("int")))
        rest = rest % span
    tail += [F.array_repeat(F.lit(pair), F.floor(rest / pair).cast("int")), F.array_repeat(F.lit(1), (rest % pair).cast("int"))]
    rows = rows.withColumn("_full", F.floor(F.col("_days") / long).cast("int")).withColumn("_tail", F.flatten(F.array(*tail)))
    spans = F.concat(F.array_repeat(F.lit(long), F.col("_full")), F.col("_tail"))
    rows = rows.select(*names, "_s", "_full", "_tail", F.posexplode(spans).alias("_pos", "actual_chunk_days"))
    done = F.aggregate(F.slice("_tail", F.lit(1), F.greatest(F.col("_pos") - F.col("_full"), F.lit(0))), F.lit(0), lambda a, x: a + x)
    first = F.date_add("_s", (long * F.least("_pos", "_full") + done).cast("int"))
    label = F.concat(F.lit(S.SPAN_LABEL), F.greatest(F.col("actual_chunk_days"), F.lit(pair)).cast("string"))
    return rows.select(
        *names,
        first.alias("start_date"),
        F.date_add(first, F.col("actual_chunk_days") - 1).alias("end_date"),
        label.alias("range_days"),
        "actual_chunk_days",
    )


def endpoint_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(n, "chunked") for n in S.CHUNKED_ENDPOINTS] + [(n, "one_shot") for n in S.ONE_SHOT_ENDPOINTS]
    return spark.createDataFrame(rows, "endpoint string, kind string")


def select_endpoints(requested: Sequence[str], known: Sequence[str] = S.CHUNKED_ENDPOINTS) -> list[str]:
    """The requested names, all of them for ``all``; unknown names are an error that lists the valid ones."""
    if "all" in requested:
        return list(known)
    wrong = [n for n in requested if n not in known]
    if wrong:
        raise ValueError(f"invalid endpoints: {', '.join(wrong)}; valid: {', '.join(known)}")
    return list(requested)


def invalid_endpoints(requested: DataFrame, catalogue: DataFrame, column: str = "endpoint") -> DataFrame:
    """Requested names that are not in the catalogue; ``all`` is valid."""
    return requested.filter(F.col(column) != "all").join(catalogue, column, "left_anti")


def fan_out(plan: DataFrame, endpoints: Sequence[str]) -> DataFrame:
    """Every span of the plan for every endpoint. The endpoints are a short literal list, so nothing is joined."""
    return plan.withColumn("endpoint", F.explode(F.array(*[F.lit(e) for e in endpoints])))


def region_requests(regions: DataFrame, column: str) -> DataFrame:
    """One inventory request per distinct region."""
    return regions.select(F.col(column).alias("region")).distinct().withColumn("endpoint", F.lit("HidroInventarioEstacoes"))


def station_names(spark: SparkSession, key: str = S.KEY) -> DataFrame:
    return spark.createDataFrame(list(S.STATION_NAMES.items()), f"{key} string, station_name string")


def with_state_name(df: DataFrame, code: str, name: str = "state_name") -> DataFrame:
    """Look a federative unit up in the fixed list."""
    pairs = F.create_map(*[F.lit(x) for pair in S.STATE_NAMES.items() for x in pair])
    return df.withColumn(name, F.try_element_at(pairs, F.col(code)))
