"""Resampling, gaps, windows and ranks over series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import gaps, windows
from gaugeline.operators.chunks import percentiles, sketch_percentiles, value_ranks, with_series_index
from gaugeline.operators.impute import value_bounds
from gaugeline.operators.resample import resample
from gaugeline.operators.splits import tail
from suite.frames import DAILY, DENSE, HOURLY, SHIP, TEL, daily_shipments, dense, hourly, rounded, shipments, table, telemetry
from suite.registry import query

RULES = {"level": "mean", "rain": "mean", "level_Status": "max", "manual": "first"}


def _binned(bin_sql: str, step: str, label: str = "b") -> str:
    """SQL of a resample: aggregate per bin, then every bin between a station's first and last."""
    return f"""WITH {TEL}, o AS (SELECT *, date_trunc('day', min(ts) OVER (PARTITION BY station)) AS origin FROM tel),
    x AS (SELECT *, {bin_sql} AS b FROM o),
    a AS (SELECT station, b, avg(level) AS level, avg(rain) AS rain, max("level_Status") AS "level_Status", arg_min(manual, ts) FILTER (manual IS NOT NULL) AS manual
      FROM x GROUP BY station, b),
    bins AS (SELECT station, unnest(generate_series(min(b), max(b), {step})) AS b FROM a GROUP BY station)
    SELECT bins.station, {label} AS ts, round_even(level, 6) AS level, round_even(rain, 6) AS rain, "level_Status", round_even(manual, 6) AS manual
    FROM bins LEFT JOIN a ON bins.station = a.station AND {label} = a.b"""


def _resampled(spark: SparkSession, sf: str, freq: str) -> DataFrame:
    return rounded(resample(telemetry(spark, sf), "station", "ts", freq, RULES, digits=6))


@query(_binned("date_trunc('hour', ts)", "INTERVAL 1 HOUR", "bins.b"))
def resample_hour(spark: SparkSession, sf: str) -> DataFrame:
    return _resampled(spark, sf, "h")


@query(_binned("time_bucket(INTERVAL 5 MINUTE, ts)", "INTERVAL 5 MINUTE", "bins.b"))
def resample_5min(spark: SparkSession, sf: str) -> DataFrame:
    return _resampled(spark, sf, "5min")


@query(_binned("origin + INTERVAL 5 HOUR * CAST(floor(date_diff('microsecond', origin, ts) / 18000000000) AS INTEGER)", "INTERVAL 5 HOUR", "bins.b"))
def resample_5h(spark: SparkSession, sf: str) -> DataFrame:
    return _resampled(spark, sf, "5h")


@query(_binned("date_trunc('day', ts)", "INTERVAL 1 DAY", "bins.b"))
def resample_day(spark: SparkSession, sf: str) -> DataFrame:
    return _resampled(spark, sf, "D")


@query(_binned("date_trunc('week', ts) + INTERVAL 6 DAY", "INTERVAL 7 DAY", "bins.b"))
def resample_week(spark: SparkSession, sf: str) -> DataFrame:
    return _resampled(spark, sf, "W")


MONTHS = f"""WITH {SHIP}, a AS (SELECT station, CAST(last_day(ts) AS TIMESTAMP) AS ts, sum(value) AS value FROM ship GROUP BY 1, 2),
m AS (SELECT station, CAST(last_day(unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH))) AS TIMESTAMP) AS ts
  FROM ship GROUP BY station)
SELECT station, ts, value FROM m LEFT JOIN a USING (station, ts)"""


@query(MONTHS)
def resample_month(spark: SparkSession, sf: str) -> DataFrame:
    return resample(shipments(spark, sf), "station", "ts", "ME", {"value": "sum"})


WEEK_END = "CAST(ceil((CAST(ts AS DATE) - DATE '1970-01-0{}') / 7.0) AS BIGINT)"
MONTH = "(year(ts) * 12 + month(ts) - 1)"


def _calendar_sql(ordinal: str, label: str, count: int = 1) -> str:
    """Sums per calendar period and supplier: periods as numbers, ``count`` of them a bin that ends with its last one."""
    return f"""WITH {SHIP}, o AS (SELECT station, {ordinal} AS k, value FROM ship), f AS (SELECT station, min(k) AS k0, max(k) AS k1 FROM o GROUP BY station),
b AS (SELECT station, k0 + CAST(ceil((k - k0) / {count}.0) AS BIGINT) * {count} AS k, sum(value) AS value FROM o JOIN f USING (station) GROUP BY 1, 2),
s AS (SELECT station, unnest(generate_series(k0, k0 + CAST(ceil((k1 - k0) / {count}.0) AS BIGINT) * {count}, {count})) AS k FROM f)
SELECT s.station, CAST({label} AS TIMESTAMP) AS ts, round_even(value, 3) AS value FROM s LEFT JOIN b ON b.station = s.station AND b.k = s.k"""


def _calendar(spark: SparkSession, sf: str, freq: str) -> DataFrame:
    return resample(shipments(spark, sf), "station", "ts", freq, {"value": "sum"})


@query(_calendar_sql(WEEK_END.format(4), "DATE '1970-01-04' + CAST(s.k * 7 AS INTEGER)", 2))
def resample_two_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return _calendar(spark, sf, "2W")


@query(_calendar_sql(WEEK_END.format(7), "DATE '1970-01-07' + CAST(s.k * 7 AS INTEGER)"))
def resample_week_wednesday(spark: SparkSession, sf: str) -> DataFrame:
    return _calendar(spark, sf, "W-WED")


@query(_calendar_sql(MONTH, "last_day(make_date(s.k // 12, s.k % 12 + 1, 1))", 2))
def resample_two_months(spark: SparkSession, sf: str) -> DataFrame:
    return _calendar(spark, sf, "2ME")


@query(_calendar_sql(MONTH, "make_date(s.k // 12, s.k % 12 + 1, 1)"))
def resample_month_start(spark: SparkSession, sf: str) -> DataFrame:
    return _calendar(spark, sf, "MS")


@query(_calendar_sql("(year(ts) * 4 + quarter(ts) - 1)", "last_day(make_date(s.k // 4, s.k % 4 * 3 + 3, 1))"))
def resample_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return _calendar(spark, sf, "QE")


@query(_calendar_sql("year(ts)", "make_date(s.k, 12, 31)"))
def resample_year(spark: SparkSession, sf: str) -> DataFrame:
    return _calendar(spark, sf, "YE")


@query(f"""WITH {DENSE} SELECT station AS station_id, 'before' AS period, round_even(100.0 * count(*) FILTER (level IS NULL) / count(*), 6) AS missing_percentage
FROM dense GROUP BY station""")
def missing_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gaps.missing_rate(dense(spark, sf), "station", "level", "before"))


GAPS = DENSE + """, runs AS (SELECT station, idx, level, idx - row_number() OVER (PARTITION BY station, level IS NULL ORDER BY idx) AS g FROM dense),
gaps AS (SELECT station, min(idx) AS gap_start, max(idx) + 1 AS gap_end, count(*) AS gap_length FROM runs WHERE level IS NULL GROUP BY station, g)"""


@query(f"""WITH {GAPS} SELECT station, gap_start, gap_end, gap_length,
  CASE WHEN gap_start = 0 AND gap_end = 2880 THEN 'all' WHEN gap_start = 0 THEN 'leading' WHEN gap_end = 2880 THEN 'trailing' ELSE 'interior' END AS kind
FROM gaps""")
def gap_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.gap_blocks(dense(spark, sf), ["station"], "idx", "level")


@query(f"WITH {GAPS} SELECT station, gap_length, count(*) AS gaps FROM gaps GROUP BY station, gap_length")
def gap_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.gap_distribution(dense(spark, sf), ["station"], "idx", "level")


@query(f"""WITH {DAILY} SELECT station, idx, value, lag(value, 1) OVER w AS lag_1_value, lag(value, 7) OVER w AS lag_7_value,
  lag(value, 28) OVER w AS lag_28_value FROM daily WINDOW w AS (PARTITION BY station ORDER BY idx)""")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    made = windows.row_features(daily_shipments(spark, sf), ["station"], "idx", ["value"], lags=[1, 7, 28])
    return made.drop("ts")


def _full(expr: str, size: int) -> str:
    return f"CASE WHEN count(level) OVER w{size} = {size} THEN round_even({expr}(ln(1 + level)) OVER w{size}, 6) END"


@query(f"""WITH {HOURLY} SELECT station, idx, {_full('avg', 6)} AS rolling_mean_6_level, {_full('stddev_samp', 6)} AS rolling_std_6_level,
  {_full('avg', 24)} AS rolling_mean_24_level, {_full('stddev_samp', 24)} AS rolling_std_24_level
FROM hourly WINDOW w6 AS (PARTITION BY station ORDER BY idx ROWS 5 PRECEDING), w24 AS (PARTITION BY station ORDER BY idx ROWS 23 PRECEDING)""")
def rolling_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    logged = hourly(spark, sf).select("station", "idx", F.log1p("level").alias("level"))
    return rounded(windows.row_features(logged, ["station"], "idx", ["level"], windows=[6, 24]).drop("level"))


@query(f"""WITH {DAILY} SELECT station, idx, sum(value) OVER (w ROWS 95 PRECEDING) AS cum_sum_96_value,
  sum(value) OVER (w ROWS 671 PRECEDING) AS cum_sum_672_value, sum(value) OVER (w ROWS 2879 PRECEDING) AS cum_sum_2880_value
FROM daily WINDOW w AS (PARTITION BY station ORDER BY idx)""")
def rolling_sum(spark: SparkSession, sf: str) -> DataFrame:
    made = windows.row_features(daily_shipments(spark, sf), ["station"], "idx", ["value"], sums=[96, 672, 2880])
    return made.drop("ts", "value")


@query(f"""WITH {DAILY}, t AS (SELECT station, idx, unnest([{{'step': 1, 'y': lead(value, 1) OVER w}}, {{'step': 24, 'y': lead(value, 24) OVER w}}]) AS s
  FROM daily WINDOW w AS (PARTITION BY station ORDER BY idx)) SELECT station, idx, s.step AS step, s.y AS y FROM t WHERE s.y IS NOT NULL""")
def horizon_target(spark: SparkSession, sf: str) -> DataFrame:
    made = windows.horizon_targets(daily_shipments(spark, sf), ["station"], "idx", "value", [1, 24])
    return made.select("station", "idx", "step", "y")


@query(f"""WITH {SHIP} SELECT station, ts, value, l_orderkey, l_linenumber, l_partkey,
  row_number() OVER (PARTITION BY station ORDER BY ts, l_orderkey, l_linenumber, l_partkey, value) - 1 AS idx FROM ship""")
def row_position(spark: SparkSession, sf: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "value"]
    return with_series_index(shipments(spark, sf), ["station"], "ts", then=order, copies=True)


@query("""SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders""")
def global_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return with_series_index(rows, [], "o_orderdate", then=["o_orderkey"])


@query(f"""WITH {DAILY}, s AS (SELECT station, idx, value AS y, list(value) OVER (PARTITION BY station ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x FROM daily)
SELECT station, idx, y, x[1] AS first_x, x[12] AS last_x, list_sum(x) AS total_x FROM s WHERE len(x) = 12""")
def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    made = windows.sequences(daily_shipments(spark, sf), ["station"], "idx", ["value"], 12, "value")
    total = F.aggregate("x", F.lit(0.0), lambda a, step: a + step[0])
    return made.select("station", "idx", "y", F.col("x")[0][0].alias("first_x"), F.col("x")[11][0].alias("last_x"), total.alias("total_x"))


@query(f"""WITH {DAILY}, p AS (SELECT station, idx, CASE WHEN idx >= 24 THEN lag(value, 24) OVER (PARTITION BY station ORDER BY idx) END AS pred FROM daily)
SELECT station, idx, coalesce(pred, CASE WHEN idx < 24 THEN max(CASE WHEN idx = 24 THEN pred END) OVER (PARTITION BY station) END) AS pred FROM p""")
def pad_predictions(spark: SparkSession, sf: str) -> DataFrame:
    made = windows.row_features(daily_shipments(spark, sf), ["station"], "idx", ["value"], lags=[24])
    preds = made.select("station", "idx", F.col("lag_24_value").alias("pred"))
    return windows.pad_predictions(preds, ["station"], "idx", "pred")


def _mode_sql(size: int) -> str:
    counts = ", ".join(f"count(*) FILTER (\"level_Status\" = {c}) OVER w{size} AS c{c}" for c in range(4))
    best = "greatest(c0, c1, c2, c3)"
    return f"""(SELECT station, idx, CASE WHEN {best} = 0 THEN NULL WHEN c0 = {best} THEN 0 WHEN c1 = {best} THEN 1 WHEN c2 = {best} THEN 2 ELSE 3 END AS m
    FROM (SELECT station, idx, {counts} FROM dense WINDOW w{size} AS (PARTITION BY station ORDER BY idx ROWS {size - 1} PRECEDING)))"""


@query(f"""WITH {DENSE} SELECT a.station, a.idx, CAST(a.m AS BIGINT) AS mode_8, CAST(b.m AS BIGINT) AS mode_96
FROM {_mode_sql(8)} a JOIN {_mode_sql(96)} b USING (station, idx)""")
def rolling_mode(spark: SparkSession, sf: str) -> DataFrame:
    made = windows.rolling_mode(dense(spark, sf), ["station"], "idx", "level_Status", [8, 96])
    return made.select("station", "idx", "mode_8", "mode_96")


@query(f"""WITH {DAILY}, p AS (SELECT a.station, a.idx, b.value AS c, count(*) AS n FROM daily a JOIN daily b ON a.station = b.station AND b.idx BETWEEN a.idx - 6 AND a.idx GROUP BY ALL)
SELECT station, idx, CAST(arg_min(c, [-n, c]) AS BIGINT) AS mode_7 FROM p GROUP BY station, idx""")
def rolling_mode_many(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities of a day as codes: far more than have a column each."""
    return windows.rolling_mode(daily_shipments(spark, sf), ["station"], "idx", "value", [7]).select("station", "idx", "mode_7")


@query(f"""WITH {DENSE} SELECT d.station, d.idx, round_even(sum(ln(1 + rain)) OVER (PARTITION BY d.station ORDER BY d.idx ROWS 95 PRECEDING), 2) AS rain_1d,
  round_even(sum(ln(1 + rain)) OVER (PARTITION BY d.station ORDER BY d.idx ROWS 671 PRECEDING), 2) AS rain_7d, round_even(sum(ln(1 + rain)) OVER (PARTITION BY d.station ORDER BY d.idx ROWS 2879 PRECEDING), 2) AS rain_30d,
  CAST(a.m AS BIGINT) AS "rain_1d_Status", CAST(b.m AS BIGINT) AS "rain_7d_Status", CAST(c.m AS BIGINT) AS "rain_30d_Status"
FROM dense d JOIN {_mode_sql(96)} a USING (station, idx) JOIN {_mode_sql(672)} b USING (station, idx) JOIN {_mode_sql(2880)} c USING (station, idx)""")
def rain_accumulation(spark: SparkSession, sf: str) -> DataFrame:
    rows = dense(spark, sf).select("station", "idx", F.log1p("rain").alias("rain"), "level_Status")
    return windows.accumulate_rain(rows, ["station"], "idx", "rain", "level_Status").drop("rain", "level_Status")


@query("""SELECT l_suppkey, l_extendedprice, count(*) AS cnt, CAST(sum(count(*)) OVER w AS BIGINT) AS cum,
  CAST(sum(count(*)) OVER (PARTITION BY l_suppkey) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey, l_extendedprice
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice)""")
def value_ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return value_ranks(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("""SELECT l_returnflag, round_even(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round_even(quantile_cont(l_extendedprice, 0.75), 6) AS p75,
  round_even(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round_even(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY l_returnflag""")
def score_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    probs = {"p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return rounded(percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", probs))


@query(f"""WITH {TEL}, m AS (UNPIVOT (SELECT station, level, rain, temp FROM tel) ON level, rain, temp INTO NAME metric VALUE value),
s AS (SELECT station, metric, count(value) AS points, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1, 2)
SELECT station, metric, points, round_even(CASE WHEN metric = 'temp' THEN lo - 0.5 * (hi - lo) ELSE greatest(lo - 0.5 * (hi - lo), 0) END, 6) AS lower_bound,
  round_even(hi + 0.5 * (hi - lo), 6) AS upper_bound FROM s""")
def clip_bounds(spark: SparkSession, sf: str) -> DataFrame:
    long = telemetry(spark, sf).unpivot(["station"], ["level", "rain", "temp"], "metric", "value")
    return rounded(value_bounds(long, ["station", "metric"], "value", F.col("metric") == "temp"))


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3000""")
def tail_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return tail(rows, "o_orderdate", 3000, ["o_orderkey"])


@query("SELECT l_suppkey % 3 AS part, count(*) AS n, TRUE AS low_within, TRUE AS middle_within, TRUE AS high_within FROM lineitem GROUP BY 1")
def approximate_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of a sketch: the exact rank of each lies within a hundredth of the rows of the wanted one."""
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("part"), F.col("l_extendedprice").alias("v"))
    probs, accuracy = {"low": 0.05, "middle": 0.5, "high": 0.99}, 100
    found = sketch_percentiles(rows, ["part"], "v", probs, accuracy)
    counted = rows.join(found, "part").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.count_if(F.col("v") < F.col(c)).alias("below"), F.count_if(F.col("v") <= F.col(c)).alias("upto")).alias(c) for c in probs],
    )
    off = F.col("n") / accuracy + 1
    return counted.select("part", "n", *[((F.col(c)["below"] <= F.col("n") * p + off) & (F.col(c)["upto"] >= F.col("n") * p - off)).alias(f"{c}_within") for c, p in probs.items()])
