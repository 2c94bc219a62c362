"""Duplicates, missing shares, correlations, distributions, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import outliers, reports, reshape
from suite.frames import DENSE, HOURLY, SHIP, STATIONS, TEL, dense, hourly, rounded, shipments, table, telemetry
from suite.registry import query


@query(f"""WITH {TEL}, m AS (SELECT station, 'level' AS metric, level AS value FROM tel
  UNION ALL SELECT station, 'flow', CASE WHEN station IN ('view', 'click') THEN rain END FROM tel)
SELECT station, metric FROM m GROUP BY station, metric HAVING count(value) = 0""")
def all_null_combos(spark: SparkSession, sf: str) -> DataFrame:
    flow = F.when(F.col("station").isin("view", "click"), F.col("rain"))
    long = reshape.melt(telemetry(spark, sf).withColumn("flow", flow), ["station", "ts"], ["level", "flow"])
    return reshape.all_null_series(long, ["station", "metric"], "value")


DUP = "SELECT user_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))


@query(f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_keys, CAST(coalesce(max(n), 0) AS BIGINT) AS largest FROM ({DUP})")
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.duplicate_report(_hours(spark, sf), ["user_id", "ts"])


@query(f"""SELECT e.event_id, e.user_id, date_trunc('hour', e.ts) AS ts FROM events e JOIN ({DUP}) d ON e.user_id = d.user_id AND date_trunc('hour', e.ts) = d.ts""")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.duplicate_rows(_hours(spark, sf), ["user_id", "ts"])


@query(f"""WITH {TEL}, p AS (SELECT 'level' AS "column", 100.0 * count(*) FILTER (level IS NULL) / count(*) AS percent FROM tel
UNION ALL SELECT 'manual', 100.0 * count(*) FILTER (manual IS NULL) / count(*) FROM tel
UNION ALL SELECT 'rain', 100.0 * count(*) FILTER (rain IS NULL) / count(*) FROM tel
UNION ALL SELECT 'level_Status', 100.0 * count(*) FILTER ("level_Status" IS NULL) / count(*) FROM tel)
SELECT "column", round_even(percent, 6) AS percent FROM p WHERE percent > 0""")
def null_percent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.null_percent(telemetry(spark, sf), ["level", "manual", "rain", "level_Status"]))


def _corr(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr({a}, {b}), 6) AS r FROM t"


PAIRS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH t AS (SELECT * FROM lineitem) " + " UNION ALL ".join(_corr(a, b) for a in PAIRS for b in PAIRS))
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.correlation_matrix(table(spark, sf, "lineitem"), PAIRS))


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).withColumn("level", F.coalesce("level", "manual"))


FLAGS = TEL + """, flags AS (SELECT station, ts, level AS original, coalesce(level, manual) AS filled, level IS NULL AS was_missing,
  level IS NULL AND manual IS NOT NULL AS imputed FROM tel)"""


@query(f"WITH {FLAGS} SELECT * FROM flags")
def imputed_flags(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.imputed_flags(telemetry(spark, sf), _filled(spark, sf), "station", "ts", "level")


@query(f"""WITH {FLAGS} SELECT station, round_even(avg(original) FILTER (NOT was_missing), 6) AS original_mean, round_even(stddev_samp(original) FILTER (NOT was_missing), 6) AS original_std,
  round_even(avg(filled) FILTER (was_missing), 6) AS imputed_mean, round_even(stddev_samp(filled) FILTER (was_missing), 6) AS imputed_std,
  round_even(abs(avg(original) FILTER (NOT was_missing) - avg(filled) FILTER (was_missing)), 6) AS mean_difference FROM flags GROUP BY station""")
def imputed_distribution(spark: SparkSession, sf: str) -> DataFrame:
    flags = reshape.imputed_flags(telemetry(spark, sf), _filled(spark, sf), "station", "ts", "level")
    return rounded(reports.imputation_distribution(flags, ["station"]))


@query("""WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) * 50 / (hi - lo)) + 1, 50) AS BIGINT) AS bin, count(*) AS n
FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1, 2""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.histogram(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 50)


@query(f"""WITH {SHIP}, q AS (SELECT station, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM ship GROUP BY station)
SELECT station, q1, median, q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers FROM ship JOIN q USING (station) GROUP BY ALL""")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.box_stats(shipments(spark, sf).select("station", "value"), ["station"], "value")


@query(f"""WITH {DENSE}, h AS (SELECT station, ts, level, rain, CAST(NULL AS DOUBLE) AS flow, coalesce(level, 0) AS level2, rain AS rain2 FROM dense)
SELECT station, CAST(CASE WHEN count(*) FILTER (level IS NULL AND level2 IS NOT NULL) > 0 THEN 1 ELSE 0 END AS BIGINT) AS features_imputed, CAST(1 AS BIGINT) AS features_skipped,
  count(*) FILTER (level IS NULL AND level2 IS NOT NULL) AS cells_filled FROM h GROUP BY station""")
def imputation_summary(spark: SparkSession, sf: str) -> DataFrame:
    before = dense(spark, sf).withColumn("flow", F.lit(None).cast("double"))
    after = before.withColumn("level", F.coalesce("level", F.lit(0.0)))
    return reports.imputation_summary(before, after, "station", "ts", ["level", "rain", "flow"])


@query(f"""WITH {HOURLY}, m AS (UNPIVOT (SELECT station, avg(ln(1 + level)) AS level, avg(ln(1 + rain)) AS rain, avg(ln(21 + temp)) AS temp FROM hourly GROUP BY station) ON level, rain, temp INTO NAME feature VALUE v)
SELECT feature, round_even(max(v) FILTER (station = 'click'), 6) AS click, round_even(max(v) FILTER (station = 'error'), 6) AS error, round_even(max(v) FILTER (station = 'purchase'), 6) AS purchase,
  round_even(max(v) FILTER (station = 'signup'), 6) AS signup, round_even(max(v) FILTER (station = 'view'), 6) AS "view" FROM m GROUP BY feature""")
def initial_means(spark: SparkSession, sf: str) -> DataFrame:
    logged = hourly(spark, sf).select("station", F.log1p("level").alias("level"), F.log1p("rain").alias("rain"), F.log1p(F.col("temp") + 20).alias("temp"))
    return rounded(reports.initial_means(logged, "station", ["level", "rain", "temp"], STATIONS))


@query("""SELECT lang, count(*) FILTER ((n_chars > 2000) <> (quality = 1)) AS errors,
  round_even(count(*) FILTER ((n_chars > 2000) <> (quality = 1)) / count(*), 6) AS error_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def label_errors(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    both = both.select("lang", (F.col("n_chars") > 2000).alias("pred"), (F.col("quality") == 1).alias("truth"))
    return rounded(outliers.label_errors(both, ["lang"], "pred", "truth"))
