"""Grid joins, metadata, semi and anti joins, upserts, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import evaluate, reshape
from gaugeline.operators.grid import one_per_slot
from gaugeline.sources.tables import absent_from
from suite.frames import DENSE, QUARTER, TEL, dense, quarter, rounded, table, telemetry
from suite.registry import query


@query(f'WITH {DENSE} SELECT station, ts, idx, level, rain, temp, "level_Status" FROM dense')
def grid_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dense(spark, sf))


@query("""SELECT e.event_id, e.user_id, e.value, c.c_acctbal AS altitude, n.n_name AS river
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    stations = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    meta = stations.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("altitude"), F.col("n_name").alias("river"))
    return table(spark, sf, "events").select("event_id", "user_id", "value").join(meta, "user_id", "left")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf, "events").select("event_id", "user_id").join(rich, "user_id", "left_semi")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def anti_filter(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf, "events").select("event_id", "user_id").join(rich, "user_id", "left_anti")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return absent_from(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), held, ["o_orderkey"])


def _run(spark: SparkSession, sf: str, late: bool) -> DataFrame:
    events = table(spark, sf, "events").filter((F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")) == F.lit(late))
    return events.groupBy(F.col("event_type").alias("model_name"), F.lit("level").alias("target_column"), (F.hour("ts") % 3).alias("step")).agg(
        F.avg(F.sqrt("value")).alias("rmse"), F.max("value").alias("mae")
    )


def _upsert(runs: str) -> str:
    return f"""WITH {runs}, named AS (SELECT model_name || '_BEST' AS model_name, target_column, step, rmse, mae FROM cur),
    full_ AS (SELECT coalesce(n.model_name, o.model_name) AS model_name, coalesce(n.target_column, o.target_column) AS target_column,
      coalesce(n.step, o.step) AS step, CASE WHEN o.rmse IS NULL OR n.rmse < o.rmse THEN n.rmse ELSE o.rmse END AS rmse,
      CASE WHEN o.rmse IS NULL OR n.rmse < o.rmse THEN n.mae ELSE o.mae END AS mae
      FROM named n FULL JOIN old o USING (model_name, target_column, step))
    SELECT model_name, target_column, step, round_even(rmse, 6) AS rmse, round_even(mae, 6) AS mae FROM cur
    UNION ALL SELECT model_name, target_column, step, round_even(rmse, 6), round_even(mae, 6) FROM full_"""


RUNS = """r AS (SELECT event_type AS model_name, 'level' AS target_column, CAST(hour(ts) % 3 AS INTEGER) AS step, ts >= TIMESTAMP '2024-01-16' AS late,
  avg(sqrt(value)) AS rmse, max(value) AS mae FROM events GROUP BY ALL),
cur AS (SELECT model_name, target_column, step, rmse, mae FROM r WHERE late AND model_name <> 'view'),
old AS (SELECT model_name || '_BEST' AS model_name, target_column, step, rmse, mae FROM r WHERE NOT late AND model_name <> 'click')"""


@query(_upsert(RUNS))
def best_upsert(spark: SparkSession, sf: str) -> DataFrame:
    current = _run(spark, sf, True).filter("model_name <> 'view'")
    old = _run(spark, sf, False).filter("model_name <> 'click'").withColumn("model_name", F.concat("model_name", F.lit("_BEST")))
    return rounded(evaluate.best_so_far(current, old))


@query("""SELECT event_id, event_type AS station, value AS level, CAST(NULL AS DOUBLE) AS price FROM events
UNION ALL SELECT o_orderkey, o_orderpriority, NULL, o_totalprice FROM orders""")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "events").select("event_id", F.col("event_type").alias("station"), F.col("value").alias("level"))
    b = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("station")
    )
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def distinct_on_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return reshape.first_per_key(rows, ["user_id", "event_type"], ["event_id"])


@query("""SELECT user_id, date_trunc('hour', ts) AS ts, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type
FROM events GROUP BY 1, 2""")
def one_reading_per_slot(spark: SparkSession, sf: str) -> DataFrame:
    hours = table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type")
    return one_per_slot(hours, ["user_id", "ts"], ["event_id"])


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", "user_id").distinct()


@query(f"""WITH {TEL} SELECT station, ts, event_id, level FROM tel WHERE level IS NOT NULL ORDER BY station, ts DESC LIMIT 100""")
def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry(spark, sf).na.drop(subset=["level"]).select("station", "ts", "event_id", "level")
    return rows.orderBy("station", F.desc("ts")).limit(100)


@query(f"WITH {QUARTER} SELECT station, ts, level, rain, temp FROM quarter ORDER BY ts, station")
def chronological_sort(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quarter(spark, sf).select("station", "ts", "level", "rain", "temp")).orderBy("ts", "station")
