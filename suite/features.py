"""Encodings, feature tables, feature selection."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import schema as S
from gaugeline.operators import encode as E
from gaugeline.operators import models as ML
from gaugeline.plans import training
from gaugeline.session import shared_folder
from suite.frames import HOURLY_WIDE, TEL, hourly_wide, rounded, table, telemetry
from suite.registry import query

PI2 = "2 * pi()"


@query(f"""SELECT l_orderkey, l_partkey, l_linenumber, round_even(sin({PI2} * l_linenumber / 7), 6) AS l_linenumber_sin, round_even(cos({PI2} * l_linenumber / 7), 6) AS l_linenumber_cos
FROM lineitem""")
def cyclical_encode(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.nature_encode(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_linenumber", 7))


def _cycle(part: str, period: str, name: str) -> str:
    return f"round_even(sin({PI2} * {part} / {period}), 6) + 0.0 AS {name}_sin, round_even(cos({PI2} * {part} / {period}), 6) + 0.0 AS {name}_cos"


CALENDAR = f"""CAST(year(ts) AS DOUBLE) AS year, {_cycle('month(ts)', '12', 'month')}, {_cycle('hour(ts)', '24', 'hour')}, {_cycle('dayofyear(ts)', '365', 'dayofyear')},
{_cycle('(isodow(ts) - 1)', '7', 'dayofweek')}, {_cycle('day(ts)', 'day(last_day(ts))', 'day')}"""


@query(f"SELECT event_id, {CALENDAR} FROM events")
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.calendar_features(table(spark, sf, "events").select("event_id", "ts"), "ts"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    hole = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", hole.alias("quantity"), F.col("l_extendedprice").alias("price"), F.lit(5.0).alias("flat")
    )


LINES = """li AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity, l_extendedprice AS price, 5.0 AS flat FROM lineitem),
tr AS (SELECT * FROM li WHERE l_shipdate < TIMESTAMP '2000-01-01'),
med AS (SELECT l_returnflag, quantile_cont(quantity, 0.5) AS mq, quantile_cont(price, 0.5) AS mp FROM tr GROUP BY 1)"""
NUMERIC = ["quantity", "price", "flat"]


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))


@query(f"WITH {LINES} SELECT l_returnflag, 'quantity' AS \"column\", round_even(mq, 6) AS median FROM med UNION ALL SELECT l_returnflag, 'price', round_even(mp, 6) FROM med "
       "UNION ALL SELECT l_returnflag, 'flat', 5.0 FROM med")
def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    fitted = E.fit_numeric(_train(_lines(spark, sf)), NUMERIC, ["l_returnflag"])
    return rounded(fitted.select("l_returnflag", "column", "median"))


@query(f"""WITH {LINES}, fit AS (SELECT l_returnflag, avg(coalesce(quantity, mq)) AS aq, stddev_pop(coalesce(quantity, mq)) AS sq, avg(price) AS ap, stddev_pop(price) AS sp FROM tr JOIN med USING (l_returnflag) GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, round_even((coalesce(quantity, mq) - aq) / sq, 6) + 0.0 AS quantity, round_even((price - ap) / sp, 6) + 0.0 AS price, CAST(0.0 AS DOUBLE) AS flat
FROM li JOIN med USING (l_returnflag) JOIN fit USING (l_returnflag)""")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    return rounded(E.apply_numeric(rows, E.fit_numeric(_train(rows), NUMERIC, ["l_returnflag"]), NUMERIC, ["l_returnflag"]))


def _hot(name: str, expr: str, values: list) -> str:
    return ", ".join(f"CAST(CASE WHEN {expr} = {v if isinstance(v, int) else repr(v)} THEN 1 ELSE 0 END AS DOUBLE) AS \"{name}_{v}\"" for v in values)


@query(f"""WITH {TEL} SELECT event_id, {_hot('level_Status', 'coalesce("level_Status", 0)', [0, 1, 2, 3])} FROM tel""")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry(spark, sf).select("event_id", "ts", "level_Status")
    seen = E.categories(rows.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), "level_Status")
    return E.one_hot(rows.drop("ts"), {"level_Status": seen})


@query(f"""WITH {TEL} SELECT event_id, {_hot('station', 'station', ['click', 'error'])} FROM tel""")
def one_hot_unseen(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry(spark, sf).select("event_id", "station")
    return E.one_hot(rows, {"station": ["click", "error"]}, "missing_value")


@query(f"""WITH {TEL}, t AS (SELECT * FROM tel WHERE ts < TIMESTAMP '2024-01-15'), m AS (SELECT quantile_cont(level, 0.5) AS ml FROM t),
f AS (SELECT avg(coalesce(level, ml)) AS al, stddev_pop(coalesce(level, ml)) AS sl, avg(rain) AS ar, stddev_pop(rain) AS sr FROM t, m)
SELECT ts, round_even((coalesce(level, ml) - al) / sl, 6) + 0.0 AS level, round_even((rain - ar) / sr, 6) + 0.0 AS rain, round_even(temp, 6) AS "Latitude", {_hot('level_Status', 'coalesce("level_Status", 0)', [0, 1, 2, 3])}
FROM tel, m, f""")
def column_routing(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry(spark, sf).select("ts", "level", "rain", F.col("temp").alias("Latitude"), "level_Status")
    train = rows.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    coded = E.encode(train.withColumnRenamed("ts", S.TS), rows.withColumnRenamed("ts", S.TS), None)
    return rounded(coded.withColumnRenamed(S.TS, "ts"))


def _saved(spark: SparkSession, encoder: E.Encoder) -> E.Encoder:
    """Written and read again, as another run does."""
    folder = f"{shared_folder(spark)}/encoder-{uuid.uuid4().hex}"
    encoder.save(folder)
    return E.Encoder.load(spark, folder)


CODED = """tl AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS station, ts, CASE WHEN event_id % 5 <> 0 THEN sqrt(value) END AS level, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS st FROM events),
t AS (SELECT * FROM tl WHERE ts < TIMESTAMP '2024-01-15'), m AS (SELECT station, quantile_cont(level, 0.5) AS ml FROM t GROUP BY station),
f AS (SELECT t.station, any_value(ml) AS ml, avg(coalesce(level, ml)) AS al, stddev_pop(coalesce(level, ml)) AS sl FROM t JOIN m ON t.station IS NOT DISTINCT FROM m.station GROUP BY t.station),
w AS (SELECT DISTINCT station, coalesce(st, 0) AS st FROM t), p AS (SELECT st, row_number() OVER (ORDER BY st) - 1 AS place FROM (SELECT DISTINCT st FROM w))"""


@query(f"""WITH {CODED} SELECT tl.event_id, tl.station, round_even((coalesce(level, ml) - al) / sl, 6) + 0.0 AS level, CAST(p.place AS INTEGER) AS place, CAST(1 + (SELECT count(*) FROM p) AS INTEGER) AS size
FROM tl JOIN f ON tl.station IS NOT DISTINCT FROM f.station LEFT JOIN w ON w.station IS NOT DISTINCT FROM tl.station AND w.st = coalesce(tl.st, 0) LEFT JOIN p ON p.st = w.st""")
def stored_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and codes of groups, one of them without a name, by an encoder that was saved: the vector taken apart."""
    rows = telemetry(spark, sf).select("event_id", F.when(F.col("station") != "view", F.col("station")).alias("station"), "ts", "level", "level_Status")
    train = rows.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    encoder = _saved(spark, E.fit_encoder(train, ["level"], ["level_Status"], ["station"]))
    made = encoder.apply(rows).withColumn("x", vector_to_array("features"))
    place = F.array_position(F.slice("x", F.lit(2), F.size("x") - 1), F.lit(1.0))
    return rounded(made.select("event_id", "station", F.col("x")[0].alias("level"), F.when(place > 0, place - 1).cast("int").alias("place"), F.size("x").alias("size")))


@query("""WITH t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), p AS (SELECT o_custkey, CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS place FROM t)
SELECT o_orderkey, place, CAST(CASE WHEN place IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS entries, CAST((SELECT count(*) FROM t) + 1 AS INTEGER) AS size FROM orders LEFT JOIN p USING (o_custkey)""")
def one_hot_large(spark: SparkSession, sf: str) -> DataFrame:
    """A column of many categories as a sparse vector: categories are rows of a table, joined and never listed."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    train = rows.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    encoder = _saved(spark, E.fit_encoder(train, ["o_totalprice"], ["o_custkey"]))
    made = encoder.places(encoder.apply(rows), "o_custkey", "place")
    size = 1 + encoder.sizes["o_custkey"]
    checked = VectorSizeHint(inputCol="features", size=size, handleInvalid="error").transform(made)
    # The categories' part of the vector alone: the sum of its entries is 1 for a known customer and 0 for another.
    entries = E.entries_sum("features", 1)
    return checked.select("o_orderkey", "place", entries.alias("entries"), F.lit(size).alias("size"))


FEATURES = HOURLY_WIDE + """, f0 AS (SELECT ts, click, ln(1 + "view") AS "view", row_number() OVER (ORDER BY ts) - 1 AS idx FROM wide WHERE "view" IS NOT NULL AND ts < TIMESTAMP '2024-01-26')"""


def _engineered(c: str) -> str:
    return f"""coalesce(lag("{c}", 6) OVER w, 0) AS "lag_6_{c}", round_even(CASE WHEN count("{c}") OVER (w ROWS 4 PRECEDING) = 5 THEN avg("{c}") OVER (w ROWS 4 PRECEDING) ELSE 0 END, 6) AS "rolling_mean_5_{c}",
    round_even(CASE WHEN count("{c}") OVER (w ROWS 4 PRECEDING) = 5 THEN stddev_samp("{c}") OVER (w ROWS 4 PRECEDING) ELSE 0 END, 6) AS "rolling_std_5_{c}",
    round_even(coalesce(sum("{c}") OVER (w ROWS 95 PRECEDING), 0), 6) AS "cum_sum_96_{c}\""""


@query(f"""WITH {FEATURES}, g AS (SELECT idx, click, "view", {_engineered('click')}, {_engineered('view')} FROM f0 WINDOW w AS (ORDER BY idx))
SELECT idx, round_even(click, 6) AS click, round_even("view", 6) AS "view", round_even(lag_6_click, 6) AS lag_6_click, round_even(lag_6_view, 6) AS lag_6_view, rolling_mean_5_click, rolling_mean_5_view,
  rolling_std_5_view, rolling_std_5_click, cum_sum_96_click, cum_sum_96_view FROM g""")
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.prepare(hourly_wide(spark, sf).select("ts", "click", "view"), "ts", "view", "2024-01-25")
    made = training.add_features(rows, "ts", [6], [5], [96])
    return rounded(made.drop("ts"))


FS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _f_score(c: str) -> str:
    return f"SELECT '{c}' AS feature, pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2) AS f FROM lineitem"


@query("SELECT feature, round_even(f, 4) AS f FROM (" + " UNION ALL ".join(_f_score(c) for c in FS) + ") ORDER BY f DESC LIMIT 2")
def f_regression_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ML.top_features(table(spark, sf, "lineitem"), FS, "l_extendedprice", 2), 4)


@query()
def gbt_importance_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ML.importance(table(spark, sf, "lineitem").withColumnRenamed("l_extendedprice", "y"), FS, "y", 2, params=ML.SELECTOR)
