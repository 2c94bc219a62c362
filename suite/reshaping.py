"""Long, wide, and the comparison views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions.expr import half_even
from gaugeline.operators import reshape as R
from gaugeline.operators.windows import horizon_targets, row_features
from suite.frames import HOURLY, QUARTER, STATIONS, TEL, hourly, quarter, rounded, table, telemetry
from suite.registry import query

STEPS = [1, 24]
MODELS = [f"{s}_{m}" for s in STATIONS for m in ("P", "S")]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence (P) and same-hour-yesterday (S) forecasts of every station's hourly level, three folds."""
    lagged = row_features(hourly(spark, sf).select("station", "ts", "idx", "level"), ["station"], "idx", ["level"], lags=[24])
    ahead = horizon_targets(lagged, ["station"], "idx", "level", STEPS)
    both = F.array(F.struct(F.lit("P").alias("m"), F.col("level").alias("y_pred")), F.struct(F.lit("S").alias("m"), F.col("lag_24_level").alias("y_pred")))
    rows = ahead.select("station", "ts", "step", F.col("y").alias("y_true"), F.inline(both))
    return rows.select(
        F.concat_ws("_", "station", "m").alias("model_name"), (F.floor((F.dayofmonth("ts") - 1) / 10) + 1).cast("int").alias("fold"), "step", "y_true", "y_pred",
        F.lit("level").alias("target_column"), F.col("ts").alias("date"),
    )


PREDS = HOURLY + """, lg AS (SELECT station, ts, idx, level, lag(level, 24) OVER w AS lag24, lead(level, 1) OVER w AS n1, lead(level, 24) OVER w AS n24
  FROM hourly WINDOW w AS (PARTITION BY station ORDER BY idx)),
preds AS (SELECT station || '_' || m AS model_name, CAST((day(ts) - 1) // 10 + 1 AS INTEGER) AS fold, step, CASE WHEN step = 1 THEN n1 ELSE n24 END AS y_true,
    CASE WHEN m = 'P' THEN level ELSE lag24 END AS y_pred, 'level' AS target_column, ts AS date
  FROM lg, (SELECT unnest(['P', 'S']) AS m), (SELECT unnest([1, 24]) AS step) WHERE CASE WHEN step = 1 THEN n1 ELSE n24 END IS NOT NULL)"""


@query(f"WITH {TEL} SELECT station, event_id, m.metric, round_even(m.value, 6) AS value FROM (SELECT station, event_id, unnest([{{'metric': 'level', 'value': level}}, "
       "{'metric': 'rain', 'value': rain}, {'metric': 'temp', 'value': temp}]) AS m FROM tel)")
def melt(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.melt(telemetry(spark, sf), ["station", "event_id"], ["level", "rain", "temp"]))


@query(f"WITH {TEL} SELECT event_id, concat_ws('_', 'level', station) AS name FROM tel")
def series_names(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).select("event_id", R.series_name(F.lit("level"), "station").alias("name"))


def _cell(m: str, s: str) -> str:
    return f"max({m}) FILTER (station = '{s}') AS {m}_{s}"


@query(f"WITH {QUARTER} SELECT ts, {', '.join(_cell(m, s) for s in STATIONS for m in ('level', 'rain'))} FROM quarter WHERE level IS NOT NULL OR rain IS NOT NULL GROUP BY ts")
def pivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.wide_frame(quarter(spark, sf).select("ts", "station", "level", "rain"), "station", "ts"))


def _wide_sql(source: str) -> str:
    cells = []
    for step in STEPS:
        cells += [f"round_even(avg(y_pred) FILTER (step = {step} AND model_name = '{m}'), 6) AS \"{m}_{step}h\"" for m in MODELS]
        cells.append(f"arg_min(y_true, model_name) FILTER (step = {step} AND y_true IS NOT NULL) AS y_true_{step}h")
    return f"SELECT date, {', '.join(cells)} FROM {source} GROUP BY date"


@query(f"WITH {PREDS} {_wide_sql('preds')}")
def predictions_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.predictions_wide(predictions(spark, sf), MODELS, STEPS))


@query(f"""WITH {PREDS}, w AS ({_wide_sql('preds')}) SELECT date, y_true_24h AS y_true, {', '.join(f'"{m}_24h" AS "{m}"' for m in MODELS)} FROM w""")
def horizon_view(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.horizon_view(R.predictions_wide(predictions(spark, sf), MODELS, STEPS), 24))


def _general(where: str) -> str:
    cells = ", ".join(f"{{'model': '{m}', 'y_pred': avg(y_pred) FILTER (model_name = '{m}')}}" for m in MODELS)
    return f"""r AS (SELECT * FROM preds WHERE step = 24 {where}), g AS (SELECT date, arg_min(y_true, {{'m': model_name, 'f': fold}}) FILTER (y_true IS NOT NULL) AS y_true, unnest([{cells}]) AS c FROM r GROUP BY date)
    SELECT date, y_true, c.model AS model, round_even(c.y_pred, 6) AS y_pred, round_even(sqrt(avg(pow(c.y_pred - y_true, 2)) OVER (PARTITION BY c.model)), 6) AS rmse FROM g"""


@query(f"WITH {PREDS}, {_general('AND fold = (SELECT max(fold) FROM preds)')}")
def general_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.general_comparison(predictions(spark, sf), MODELS, 24, "last"))


@query(f"WITH {PREDS}, {_general('')}")
def general_comparison_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.general_comparison(predictions(spark, sf), MODELS, 24, "all"))


@query(f"""WITH {PREDS}, {_general('').replace('SELECT date, y_true, c.model', ', fin AS (SELECT date, y_true, c.model')})
SELECT model, model || ' (RMSE: ' || format('{{:.2f}}', max(rmse)) || ' cm)' AS model_label FROM fin GROUP BY model""")
def model_labels(spark: SparkSession, sf: str) -> DataFrame:
    compared = R.general_comparison(predictions(spark, sf), MODELS, 24, "all").groupBy("model").agg(F.max("rmse").alias("rmse"))
    return compared.select("model", R.model_label().alias("model_label"))


KGE = """1 - sqrt(pow(corr(t, p) - 1, 2) + pow((stddev_pop(p) / avg(p)) / (stddev_pop(t) / avg(t)) - 1, 2) + pow(avg(p) / avg(t) - 1, 2))"""


@query(f"""WITH {PREDS}, w AS ({_wide_sql('preds')}), v AS (SELECT * FROM w WHERE date > TIMESTAMP '2024-01-10'),
l AS (SELECT y_true_24h AS t0, unnest([{', '.join(f"{{'m': '{m}', 'p': \"{m}_24h\"}}" for m in MODELS)}]) AS c FROM v),
n AS (SELECT c.m AS model, t0 AS t, c.p AS p FROM l WHERE t0 IS NOT NULL AND c.p IS NOT NULL) SELECT model, round_even({KGE}, 6) AS kge FROM n GROUP BY model""")
def case_comparison(spark: SparkSession, sf: str) -> DataFrame:
    wide = R.predictions_wide(predictions(spark, sf), MODELS, STEPS)
    return rounded(R.case_comparison(wide, 24, "2024-01-10")[1])


@query("SELECT n_name AS station_name, o_orderdate AS ts, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def station_comparison(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = names.select(F.col("c_custkey").alias("station"), F.col("n_name").alias("station_name"))
    levels = table(spark, sf, "orders").select(F.col("o_custkey").alias("station"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return R.station_comparison(levels, names, "value", "station", "ts")


@query(f"WITH {TEL} SELECT station, event_id, round_even(temp * 10, 0) / 10 AS temp FROM tel")
def rounded_values(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).select("station", "event_id", half_even("temp", 1).alias("temp"))
