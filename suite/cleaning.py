"""Types, codes, cuts, fallbacks, negatives, aliases, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.expr import parse_number, parse_time
from gaugeline.operators import clean as C
from gaugeline.operators import reports as R
from gaugeline.schema import SeriesSchema
from suite.frames import TEL, rounded, table, telemetry
from suite.registry import query


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(event_id % 4 AS VARCHAR) END AS BIGINT) AS "level_Status"
FROM events""")
def cast_status(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "x").otherwise((F.col("event_id") % 4).cast("string"))
    return C.cast_status(table(spark, sf, "events").select("event_id", text.alias("level_Status")))


@query(f"""WITH {TEL} SELECT event_id, level, CAST(CASE WHEN level IS NULL THEN 4 ELSE 0 END AS BIGINT) AS level_code FROM tel""")
def derive_status(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).select("event_id", "level", C.derived_status("level").alias("level_code"))


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.format_number("l_extendedprice", 2))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text.alias("price"))


PRICES = """prices AS (SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE format('{:,.2f}', l_extendedprice) END AS price FROM lineitem)"""


@query(f"WITH {PRICES} SELECT l_orderkey, l_partkey, l_linenumber, TRY_CAST(replace(price, ',', '') AS DOUBLE) AS price FROM prices")
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _prices(spark, sf).withColumn("price", parse_number("price"))


@query(f"""WITH {PRICES} SELECT 'price' AS "column", count(*) FILTER (price IS NOT NULL AND TRY_CAST(replace(price, ',', '') AS DOUBLE) IS NULL) AS rejected
FROM prices""")
def number_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return C.rejects(_prices(spark, sf), ["price"])


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN 'soon' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS ts FROM events""")
def parse_times(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_type") == "view", "soon").otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", parse_time(text).alias("ts"))


@query(f"""WITH {TEL} SELECT station, ts, event_id, manual, rain, coalesce(level, manual) AS level,
  CASE WHEN level IS NULL AND manual IS NOT NULL THEN 4 ELSE "level_Status" END AS "level_Status",
  CAST(CASE WHEN rain IS NULL THEN 4 ELSE 0 END AS BIGINT) AS "rain_Status"
FROM tel WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'""")
def clean_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    schema = SeriesSchema(key="station", ts="ts", values=("level", "rain"), meta=(), signed=())
    raw = telemetry(spark, sf).drop("temp").withColumn("level", F.col("level").cast("string"))
    out = C.clean(raw, schema, "2024-01-05", "2024-01-25", {"level": "manual"}, derive=["rain"], times=())
    return out.withColumn("event_id", F.col("event_id").cast("bigint"))


NEG = SeriesSchema(key="station", ts="ts", values=("net", "level"), meta=(), signed=())


def _signed(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).select("event_id", F.col("temp").alias("net"), F.col("level_Status").alias("net_Status"), "level", "level_Status")


@query(f"""WITH {TEL} SELECT event_id, CASE WHEN temp >= 0 THEN temp END AS net,
  CASE WHEN temp < 0 THEN 2 ELSE coalesce("level_Status", 0) END AS "net_Status", level,
  CASE WHEN level IS NULL THEN 4 ELSE coalesce("level_Status", 0) END AS "level_Status" FROM tel""")
def negative_removal(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_negatives(_signed(spark, sf), NEG, keep_code=True)


@query(f"""WITH {TEL} SELECT event_id, CASE WHEN temp >= 0 THEN temp END AS net,
  CASE WHEN temp >= 0 THEN coalesce("level_Status", 0) ELSE 4 END AS "net_Status", level,
  CASE WHEN level IS NULL THEN 4 ELSE coalesce("level_Status", 0) END AS "level_Status" FROM tel""")
def status_completion(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_negatives(_signed(spark, sf), NEG)


@query(f"""WITH {TEL} SELECT CASE WHEN station = 'signup' THEN 'click' ELSE station END AS station, event_id, ts, level FROM tel
WHERE station <> 'signup' OR (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')""")
def alias_merge(spark: SparkSession, sf: str) -> DataFrame:
    raw = telemetry(spark, sf).select("station", "event_id", "ts", "level")
    return C.merge_aliases(raw, {"signup": "click"}, "station", "ts", {"signup": ("2024-01-10", "2024-01-20")})


@query("SELECT event_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-21'")
def end_cut(spark: SparkSession, sf: str) -> DataFrame:
    return C.end_cut(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", "2024-01-20")


@query(f"""WITH {TEL} SELECT event_id, round_even(ln(1 + level), 6) AS logged, round_even(exp(ln(1 + level)) - 1, 6) AS restored
FROM tel WHERE level IS NOT NULL""")
def log_target(spark: SparkSession, sf: str) -> DataFrame:
    kept = telemetry(spark, sf).na.drop(subset=["level"]).select("event_id", F.log1p("level").alias("logged"))
    return rounded(kept.withColumn("restored", F.expm1("logged")))


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS reading,
TRY_CAST(props AS DOUBLE) AS props FROM events""")
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string"))
    return C.coerce_numeric(table(spark, sf, "events").select("event_id", text.alias("reading"), "props"))


@query(f"WITH {TEL} SELECT event_id, coalesce(level, 0) AS level, coalesce(manual, 0) AS manual, coalesce(\"level_Status\", 0) AS \"level_Status\" FROM tel")
def zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return C.zero_fill(telemetry(spark, sf).select("event_id", "level", "manual", "level_Status"))


@query(f"""WITH {TEL} SELECT ts, station, level, "level_Status", rain FROM tel""")
def declared_columns(spark: SparkSession, sf: str) -> DataFrame:
    schema = SeriesSchema(key="station", ts="ts", values=("level", "rain", "flow"), meta=("altitude",))
    raw = C.rename_key(telemetry(spark, sf).withColumnRenamed("station", "Station"), "station")
    return raw.select(*schema.kept(raw.columns))


@query("""SELECT 'segment' AS stage, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS remaining FROM customer
UNION ALL SELECT 'positive', count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0) FROM customer
UNION ALL SELECT 'nation', count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 AND c_nationkey < 10) FROM customer""")
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    stages = {
        "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
        "positive": F.col("c_acctbal") > 0,
        "nation": F.col("c_nationkey") < 10,
    }
    return R.funnel(table(spark, sf, "customer"), stages)


RIVERS = "['87200000', '86001000', '87220000', '87240000', '87230000', '85001000', '10000000', '20000000'][c_nationkey % 8 + 1]"


@query(f"""WITH inv AS (SELECT {RIVERS} AS river, c_mktsegment <> 'BUILDING' AS op, c_acctbal > 0 AS tel FROM customer),
f AS (SELECT river NOT IN ('10000000', '20000000') AS a, op AS b, tel AS c FROM inv)
SELECT 'river' AS stage, count(*) FILTER (a) AS remaining FROM f UNION ALL SELECT 'operating', count(*) FILTER (a AND b) FROM f
UNION ALL SELECT 'telemetric', count(*) FILTER (a AND b AND c) FROM f""")
def station_funnel(spark: SparkSession, sf: str) -> DataFrame:
    rivers = ["87200000", "86001000", "87220000", "87240000", "87230000", "85001000", "10000000", "20000000"]
    inventory = table(spark, sf, "customer").select(
        F.element_at(F.array(*[F.lit(r) for r in rivers]), F.col("c_nationkey") % 8 + 1).alias("Rio_Codigo"),
        F.when(F.col("c_mktsegment") == "BUILDING", "0").otherwise("1").alias("Operando"),
        F.when(F.col("c_acctbal") > 0, "1").otherwise("0").alias("Tipo_Estacao_Telemetrica"),
    )
    return R.station_funnel(inventory)


@query("""WITH r AS (SELECT event_type, CASE WHEN value < 100 THEN time_bucket(INTERVAL 15 MINUTE, ts) ELSE ts END AS ts FROM events),
s AS (SELECT event_type, ts, count(*) AS n FROM r GROUP BY 1, 2)
SELECT event_type, CAST(sum(n) AS BIGINT) AS readings,
  CAST(sum(CASE WHEN time_bucket(INTERVAL 15 MINUTE, ts) <> ts THEN n ELSE 0 END) AS BIGINT) AS off_grid,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicated FROM s GROUP BY event_type""")
def off_grid_report(spark: SparkSession, sf: str) -> DataFrame:
    from gaugeline.functions.expr import floor_time

    moved = F.when(F.col("value") < 100, floor_time("ts", 900)).otherwise(F.col("ts"))
    return C.off_grid(table(spark, sf, "events").withColumn("ts", moved), "event_type", "ts", 900)
