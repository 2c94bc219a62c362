"""Splits, scores, baselines, fits, run log, and the whole pipelines."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import metrics as M
from gaugeline.operators import evaluate as EV
from gaugeline.operators import models as ML
from gaugeline.operators import splits
from gaugeline.plans import training
from gaugeline.session import checkpointed, shared_folder
from suite.frames import DAILY, HOURLY_WIDE, STATIONS, daily_shipments, hourly_wide, rounded, table
from suite.features import CALENDAR
from suite.quality import spline_sql
from suite.registry import query
from suite.reshaping import KGE, PREDS, predictions

BUNDLE = f"""round_even(sqrt(avg(pow(t - p, 2))), 6) AS rmse, round_even(avg(abs(t - p)), 6) AS mae, round_even(1 / (1 + avg(pow(t - p, 2)) / var_pop(t)), 6) AS nse,
  round_even(1 - avg(pow(t - p, 2)) / var_pop(t), 6) AS r2, round_even({KGE}, 6) AS kge"""
PAIRS = PREDS + ", pr AS (SELECT *, y_true AS t, y_pred AS p FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"


@query(f"WITH {PAIRS} SELECT model_name, target_column, step, fold, {BUNDLE} FROM pr GROUP BY ALL")
def horizon_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(EV.score(predictions(spark, sf)))


@query(f"WITH {PAIRS}, s AS (SELECT model_name, target_column, step, fold, {BUNDLE.replace('round_even(', '(').replace(', 6)', ')')} FROM pr GROUP BY ALL) SELECT model_name, target_column, step, "
       + ", ".join(f"round_even(avg({m}), 6) AS {m}, round_even(stddev_samp({m}), 6) AS {m}_std" for m in EV.SCORES) + " FROM s GROUP BY ALL")
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(EV.summarise(EV.score(predictions(spark, sf))))


@query(f"WITH {PAIRS} SELECT model_name, step, round_even(1 - avg(pow(t - p, 2)) / var_pop(t), 6) AS nse, round_even(1 / (1 + avg(pow(t - p, 2)) / var_pop(t)), 6) AS nnse FROM pr GROUP BY ALL")
def nnse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predictions(spark, sf).groupBy("model_name", "step").agg(M.nse("y_true", "y_pred").alias("nse"), M.nnse("y_true", "y_pred").alias("nnse")))


@query(f"""WITH {PAIRS} SELECT model_name, step, round_even({KGE}, 6) AS kge_cv,
  round_even(1 - sqrt(pow(corr(t, p) - 1, 2) + pow(stddev_pop(p) / stddev_pop(t) - 1, 2) + pow(avg(p) / avg(t) - 1, 2)), 6) AS kge_sd FROM pr GROUP BY ALL""")
def kge_variants(spark: SparkSession, sf: str) -> DataFrame:
    by = predictions(spark, sf).groupBy("model_name", "step")
    return rounded(by.agg(M.kge("y_true", "y_pred", "cv").alias("kge_cv"), M.kge("y_true", "y_pred", "sd").alias("kge_sd")))


@query(f"WITH {PREDS} SELECT max(fold) AS fold FROM preds")
def last_fold(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).agg(F.max("fold").alias("fold"))


@query("""WITH r AS (SELECT event_type, user_id, avg(sqrt(value)) AS rmse FROM events GROUP BY ALL)
SELECT event_type AS model, CAST(arg_min(user_id, rmse) AS VARCHAR) AS best_user, round_even(min(rmse), 6) AS rmse, CAST(1 AS INTEGER) AS params_left FROM r GROUP BY event_type""")
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), "user_id").agg(F.avg(F.sqrt("value")).alias("rmse"))
    runs = log.select(
        "model", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("absent"), F.lit(None).cast("string")).alias("params"),
        F.create_map(F.lit("rmse"), F.col("rmse")).alias("metrics"),
    )
    best = EV.best_run(runs, "rmse", "min")
    return rounded(best.select("model", F.col("params")["user"].alias("best_user"), "rmse", F.size("params").alias("params_left")))


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))


DAYS = """days AS (SELECT o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate) - 1 AS idx, count(*) OVER () AS n FROM orders GROUP BY o_orderdate)"""
FOLDS = ", folds AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS fold)"


@query(f"""WITH {DAYS}{FOLDS}, x AS (SELECT ts, idx, fold, n - (3 - fold) * 168 AS test_end FROM days, folds)
SELECT ts, idx, fold, CASE WHEN idx >= test_end - 168 THEN 'test' WHEN idx >= test_end - 336 THEN 'val' ELSE 'train' END AS role FROM x WHERE idx < test_end""")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return splits.walk_forward(_days(spark, sf), "ts", 3, 168).select("ts", "idx", "fold", "role")


@query(f"""WITH {DAYS}{FOLDS}, x AS (SELECT ts, idx, fold, n - (4 - fold) * (n // 4) AS test_start, n // 4 AS size FROM days, folds)
SELECT ts, idx, fold, CASE WHEN idx >= test_start THEN 'test' ELSE 'train' END AS role FROM x WHERE idx < test_start - 24 OR (idx >= test_start AND idx < test_start + size)""")
def time_series_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.time_series_split(_days(spark, sf), "ts", 3, 24).select("ts", "idx", "fold", "role")


@query("""WITH d AS (SELECT o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate DESC) AS back FROM orders WHERE o_orderdate < TIMESTAMP '2000-05-01' GROUP BY 1)
SELECT o_orderdate AS ts, CASE WHEN o_orderdate >= TIMESTAMP '2000-05-01' THEN 'test' WHEN back <= 90 THEN 'val' ELSE 'train' END AS role
FROM (SELECT DISTINCT o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01') LEFT JOIN d ON o_orderdate = ts""")
def event_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.event_split(_days(spark, sf), "ts", "2000-05-01", "2000-06-01", 90).select("ts", "role")


@query(f"""WITH {DAILY}, p AS (SELECT station, idx, value, lag(value, 24) OVER (PARTITION BY station ORDER BY idx) AS y_pred FROM daily) SELECT * FROM p""")
def seasonal_naive(spark: SparkSession, sf: str) -> DataFrame:
    return ML.seasonal_naive(daily_shipments(spark, sf).drop("ts"), ["station"], "idx", "value")


TRAIN = HOURLY_WIDE + """, r0 AS (SELECT ts, ln(1 + click) AS click, row_number() OVER (ORDER BY ts) - 1 AS idx FROM wide WHERE click IS NOT NULL),
ys AS (SELECT ts, idx, step, CASE WHEN step = 1 THEN lead(click, 1) OVER w ELSE lead(click, 24) OVER w END AS y FROM r0, (SELECT unnest([1, 24]) AS step) WINDOW w AS (PARTITION BY step ORDER BY idx)),
yn AS (SELECT *, count(*) OVER (PARTITION BY step) AS n FROM ys WHERE y IS NOT NULL)"""
WALK = TRAIN + FOLDS + """, wf AS (SELECT *, n - (3 - fold) * 24 AS test_end FROM yn, folds),
fit AS (SELECT step, fold, avg(y) AS m FROM wf WHERE idx < test_end - 48 GROUP BY step, fold),
tp AS (SELECT 'DUMMY' AS model_name, fold, step, exp(y) - 1 AS t, exp(m) - 1 AS p, m, 'click' AS target_column, ts AS date FROM wf JOIN fit USING (step, fold) WHERE idx >= test_end - 24 AND idx < test_end)"""


def _target(spark: SparkSession, sf: str) -> DataFrame:
    return training.prepare(hourly_wide(spark, sf).select("ts", "click"), "ts", "click")


@query(f"WITH {WALK} SELECT model_name, fold, step, round_even(t, 6) AS y_true, round_even(p, 6) AS y_pred, round_even(m, 6) AS y_pred_log, target_column, date FROM tp")
def mean_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.general_mode(_target(spark, sf), "ts", "click", [1, 24], 3)[1])


# Horizons of 1 and 6 rows: also the smallest tables then hold several seasons of training rows before the first fold.
STEPS, EXOG = [1, 6], 2
OTHERS = [s for s in STATIONS if s != "click"]


def _level(c: str, n: int) -> str:
    """The target ``n`` rows back, or ahead."""
    return f"lag(click, {n}) OVER w" if n >= 0 else f"lead(click, {-n}) OVER w"


def _horizon(step: int) -> str:
    back = -(-step // 24) * 24
    return f"""SELECT idx, ts, {step} AS step, {_level('click', -step)} AS y, {_level('click', -step)} - click AS dy, {_level('click', back - step)} AS seasonal,
  {_level('click', 0)} - {_level('click', 1)} AS ar_1, {_level('click', 1)} - {_level('click', 2)} AS ar_2, {_level('click', 2)} - {_level('click', 3)} AS ar_3,
  {_level('click', back - step)} - {_level('click', back)} AS sar_1, click, {', '.join(f'"{s}"' for s in OTHERS)} FROM r0 WINDOW w AS (ORDER BY idx)"""


def _design(steps: list[int]) -> str:
    return HOURLY_WIDE + f""", r0 AS (SELECT ts, ln(1 + click) AS click, {', '.join(f'"{s}"' for s in OTHERS)}, row_number() OVER (ORDER BY ts) - 1 AS idx FROM wide WHERE click IS NOT NULL),
hz AS (SELECT *, count(*) OVER (PARTITION BY step) AS n FROM ({' UNION ALL '.join(map(_horizon, steps))}) WHERE y IS NOT NULL)"""


def _regression(source: str) -> str:
    """CTEs from ``source`` (a row per step and fold with role) to ``ar`` with ``y_pred``: the ``EXOG`` features of the highest F besides the
    autoregressive terms, missing terms at their mean, least squares by freeing each term of the ones before it."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*TERMS, "dy"])
    terms = [*TERMS, *(f"e{k}" for k in range(1, EXOG + 1))]
    g = "OVER (PARTITION BY step, fold)"
    picked = ", ".join(f"max(value) FILTER (place = {k}) AS e{k}" for k in range(1, EXOG + 1))
    free = ", ".join(f"coalesce({t} - avg({t}) FILTER (train) {g}, 0) AS {t}_0" for t in terms)
    out = [
        f"dr AS (SELECT *, role = 'train' AND {whole} AS train FROM {source})",
        f"""lg AS (UNPIVOT (SELECT step, fold, idx, train, dy, {', '.join(f'"{s}"' for s in OTHERS)} FROM dr) ON {', '.join(f'"{s}"' for s in OTHERS)} INTO NAME feature VALUE value)""",
        "fs AS (SELECT step, fold, feature, pow(corr(value, dy), 2) AS r2, count(*) AS m FROM lg WHERE train GROUP BY ALL)",
        "rk AS (SELECT step, fold, feature, row_number() OVER (PARTITION BY step, fold ORDER BY r2 / (1 - r2) * (m - 2) DESC, feature) AS place FROM fs WHERE r2 < 1)",
        f"ex AS (SELECT step, fold, idx, {picked} FROM lg JOIN rk USING (step, fold, feature) GROUP BY ALL)",
        f"o0 AS (SELECT *, {free}, avg(dy) FILTER (train) {g} AS hat_0 FROM dr LEFT JOIN ex USING (step, fold, idx))",
    ]
    for i, t in enumerate(terms):
        mine = f"{t}_{i}"
        share = lambda c: f"(sum({mine} * {c}) FILTER (train) {g} / sum({mine} * {mine}) FILTER (train) {g}) * {mine}"  # noqa: E731, B023
        freed = "".join(f", {o}_{i} - {share(f'{o}_{i}')} AS {o}_{i + 1}" for o in terms[i + 1 :])
        out.append(f"o{i + 1} AS (SELECT *, hat_{i} + {share('dy')} AS hat_{i + 1}{freed} FROM o{i})")
    return ", ".join(out) + f", ar AS (SELECT *, click + hat_{len(terms)} AS y_pred FROM o{len(terms)})"


def _all_models(source: str) -> str:
    return f"""{_regression(source)}, means AS (SELECT step, fold, avg(y) AS m FROM {source} WHERE role = 'train' GROUP BY ALL),
lp AS (SELECT 'DUMMY' AS model_name, step, fold, ts, y, m AS p FROM {source} JOIN means USING (step, fold) WHERE role = 'test'
  UNION ALL SELECT 'SEASONAL', step, fold, ts, y, seasonal FROM {source} WHERE role = 'test' UNION ALL SELECT 'SARIMA', step, fold, ts, y, y_pred FROM ar WHERE role = 'test'),
tp AS (SELECT model_name, 'click' AS target_column, step, fold, ts AS date, y, p AS lp, exp(y) - 1 AS t, exp(p) - 1 AS p FROM lp),
fu AS (SELECT * FROM tp WHERE t IS NOT NULL AND p IS NOT NULL)"""


TERMS = ["ar_1", "ar_2", "ar_3", "sar_1"]
EVALUATION = _design(STEPS) + FOLDS + f""", xr AS (SELECT *, n - (3 - fold) * {max(STEPS)} AS test_end FROM hz, folds),
rl AS (SELECT *, CASE WHEN idx >= test_end - {max(STEPS)} THEN 'test' WHEN idx >= test_end - {2 * max(STEPS)} THEN 'val' ELSE 'train' END AS role FROM xr WHERE idx < test_end), """ + _all_models("rl")
EVENT = _design([1, 24]) + """, kn AS (SELECT *, 1 AS fold, count(*) FILTER (ts < TIMESTAMP '2024-01-20') OVER (PARTITION BY step) AS known FROM hz WHERE ts < TIMESTAMP '2024-01-27'),
rl AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'test' WHEN idx >= known - 24 THEN 'val' ELSE 'train' END AS role FROM kn), """ + _all_models("rl")


def _wide_target(spark: SparkSession, sf: str) -> DataFrame:
    return training.prepare(hourly_wide(spark, sf), "ts", "click")


def _baselines() -> dict[str, training.Model]:
    return {"SEASONAL": training.seasonal_model(), "SARIMA": training.arx_model(exog=EXOG)}


KGE_OR_NULL = f"CASE WHEN any_value(model_name) <> 'DUMMY' THEN {KGE} END"
SCORED = f"""sqrt(avg(pow(t - p, 2))) AS rmse, avg(abs(t - p)) AS mae, 1 / (1 + avg(pow(t - p, 2)) / var_pop(t)) AS nse, 1 - avg(pow(t - p, 2)) / var_pop(t) AS r2, {KGE_OR_NULL} AS kge"""


@query(f"WITH {EVALUATION}, s AS (SELECT model_name, target_column, step, fold, {SCORED} FROM fu GROUP BY ALL) SELECT model_name, target_column, step, "
       + ", ".join(f"round_even(avg({m}), 7) AS {m}, round_even(stddev_samp({m}), 7) AS {m}_std" for m in EV.SCORES) + " FROM s GROUP BY ALL")
def general_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.general_mode(_wide_target(spark, sf), "ts", "click", STEPS, 3, _baselines())[0], 7)


@query(f"WITH {EVALUATION} SELECT model_name, fold, step, round_even(t, 7) AS y_true, round_even(p, 7) AS y_pred, round_even(lp, 7) AS y_pred_log, target_column, date FROM tp")
def forecast_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.general_mode(_wide_target(spark, sf), "ts", "click", STEPS, 3, _baselines())[1], 7)


@query(f"WITH {EVENT} SELECT model_name || '_CASE_STUDY' AS model_name, target_column, step, "
       + ", ".join(f"round_even({m}, 7) AS {m}" for m in EV.SCORES) + f" FROM (SELECT model_name, target_column, step, {SCORED} FROM fu GROUP BY ALL)")
def case_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.case_mode(_wide_target(spark, sf), "ts", "click", [1, 24], "2024-01-20", "2024-01-27", _baselines())[0], 7)


@query(f"WITH {EVENT} SELECT date, " + ", ".join(f"""round_even(max(p) FILTER (model_name = '{m}' AND step = {s}), 7) AS "{m}_{s}h\"""" for s in (1, 24) for m in ("DUMMY", "SEASONAL", "SARIMA"))
       + ", round_even(max(t) FILTER (step = 1), 7) AS y_true_1h, round_even(max(t) FILTER (step = 24), 7) AS y_true_24h FROM tp GROUP BY date")
def case_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.case_mode(_wide_target(spark, sf), "ts", "click", [1, 24], "2024-01-20", "2024-01-27", _baselines())[2], 7)


ARX = DAILY + """, d AS (SELECT station, idx, value - lag(value, 1) OVER w AS ar_1, lead(value, 7) OVER w - value AS dy FROM daily WINDOW w AS (PARTITION BY station ORDER BY idx))"""


@query(f"WITH {ARX} SELECT 'intercept' AS term, round_even(regr_intercept(dy, ar_1), 4) AS value FROM d UNION ALL SELECT 'ar_1', round_even(regr_slope(dy, ar_1), 4) FROM d")
def arx_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    rows = ML.arx_frame(daily_shipments(spark, sf), ["station"], "idx", "value", step=7, order=1)
    return rounded(ML.coefficients(ML.fit_arx(rows, ["ar_1"]), ["ar_1"], rows), 4)


@query(f"""WITH {DAILY} SELECT station, idx, value - lag(value, 1) OVER w AS ar_1, lag(value, 1) OVER w - lag(value, 2) OVER w AS ar_2, lag(value, 17) OVER w - lag(value, 24) OVER w AS sar_1,
lead(value, 7) OVER w - value AS dy FROM daily WINDOW w AS (PARTITION BY station ORDER BY idx)""")
def arx_design(spark: SparkSession, sf: str) -> DataFrame:
    return ML.arx_frame(daily_shipments(spark, sf), ["station"], "idx", "value", step=7, order=2).drop("ts", "value")


def _least_squares(rows: str, terms: list[str], response: str) -> str:
    """CTEs to ``fitted`` with column ``hat``: each term is freed of the ones before it, with factors from the training rows."""
    named = ", ".join(f"{t} - (SELECT avg({t}) FILTER (train) FROM {rows}) AS {t}_0" for t in terms)
    out = [f"o0 AS (SELECT *, {named}, (SELECT avg({response}) FILTER (train) FROM {rows}) AS hat_0 FROM {rows})"]
    for i, t in enumerate(terms):
        mine = f"{t}_{i}"
        share = lambda c: f"(SELECT sum({mine} * {c}) FILTER (train) / sum({mine} * {mine}) FILTER (train) FROM o{i}) * {mine}"  # noqa: E731, B023
        freed = "".join(f", {o}_{i} - {share(f'{o}_{i}')} AS {o}_{i + 1}" for o in terms[i + 1 :])
        out.append(f"o{i + 1} AS (SELECT *, hat_{i} + {share(response)} AS hat_{i + 1}{freed} FROM o{i})")
    return ", ".join(out)


CHANGES = DAILY + """, ch AS (SELECT station, ts, value, value - lag(value, 1) OVER w AS ar_1, lag(value, 1) OVER w - lag(value, 2) OVER w AS ar_2, lag(value, 2) OVER w - lag(value, 3) OVER w AS ar_3,
  lag(value, 17) OVER w - lag(value, 24) OVER w AS sar_1, lead(value, 7) OVER w - value AS dy FROM daily WINDOW w AS (PARTITION BY station ORDER BY idx)),
al AS (SELECT station, ts, value, dy, coalesce(ar_1, 0) AS ar_1, coalesce(ar_2, 0) AS ar_2, coalesce(ar_3, 0) AS ar_3, coalesce(sar_1, 0) AS sar_1,
  ts < TIMESTAMP '2000-06-01' AND ar_1 IS NOT NULL AND ar_2 IS NOT NULL AND ar_3 IS NOT NULL AND sar_1 IS NOT NULL AS train FROM ch WHERE dy IS NOT NULL)"""


@query(f"WITH {CHANGES}, {_least_squares('al', TERMS, 'dy')} SELECT station, ts, value + dy AS y_true, round_even(value + hat_4, 4) AS y_pred FROM o4 WHERE ts >= TIMESTAMP '2000-06-01'")
def seasonal_arx(spark: SparkSession, sf: str) -> DataFrame:
    rows = ML.arx_frame(daily_shipments(spark, sf), ["station"], "idx", "value", step=7)
    cut = F.lit("2000-06-01").cast("timestamp_ntz")
    model = ML.fit_arx(rows.filter(F.col("ts") < cut), TERMS)
    test = rows.filter((F.col("ts") >= cut) & F.col("dy").isNotNull())
    scored = ML.predict(model, test, TERMS, "dy_hat")
    return rounded(scored.select("station", "ts", (F.col("value") + F.col("dy")).alias("y_true"), (F.col("value") + F.col("dy_hat")).alias("y_pred")), 4)


def _tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The wide hourly levels with their default lag, rolling and sum features."""
    return training.add_features(_wide_target(spark, sf), "ts")


TREE_STEP, TREE_FOLDS = 6, 1
TREES = _design([TREE_STEP]) + f""", fd AS (SELECT CAST(unnest(range(1, {TREE_FOLDS + 1})) AS INTEGER) AS fold), xr AS (SELECT *, n - ({TREE_FOLDS} - fold) * {TREE_STEP} AS test_end FROM hz, fd)"""


@query(f"""WITH {TREES} SELECT 'XGBOOST' AS model_name, CAST(step AS INTEGER) AS step, fold, count(*) AS n, min(ts) AS first_date, max(ts) AS last_date, round_even(sum(exp(y) - 1), 6) AS y_sum,
  TRUE AS same_after_loading, CAST(50 AS INTEGER) AS n_features, TRUE AS ends_early_or_full FROM xr WHERE idx >= test_end - {TREE_STEP} AND idx < test_end GROUP BY step, fold""")
def gbt_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """100 trees of depth 5 on the 50 most important of all default features, per fold; what was saved predicts the same when loaded again."""
    f = training.walk_forward_folds(_tree_rows(spark, sf), "ts", "click", [TREE_STEP], TREE_FOLDS)
    place = f"{shared_folder(spark)}/pipelines-{uuid.uuid4().hex}"
    made = checkpointed(training.as_predictions(training.gbt_fit(folder=place)(f), "ts", "XGBOOST", "click"))
    rows, _ = f.encoded
    again = [(k, training.Fitted.load(place, TREE_STEP, k)) for k in range(1, TREE_FOLDS + 1)]
    sizes = spark.createDataFrame([(k, len(m.places), 1 <= m.model.stages[1].getNumTrees <= 100) for k, m in again], "fold int, n_features int, ends_early_or_full boolean")
    repeated = functools.reduce(DataFrame.unionByName, [m.predict(rows) for _, m in again]).select("fold", F.col("ts").alias("date"), F.col("y_pred").alias("_again"))
    joined = made.join(repeated, ["fold", "date"])
    out = joined.groupBy("model_name", "step", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("y_true").alias("y_sum"),
        F.bool_and(F.col("y_pred_log") == F.col("_again")).alias("same_after_loading"),
    )
    return rounded(out.join(sizes, "fold"))


SPLITS, TRIES = 3, 2


@query(f"""WITH {_design([TREE_STEP])}, c AS (SELECT CAST(unnest(range({TRIES})) AS INTEGER) AS candidate), k AS (SELECT CAST(unnest(range(1, {SPLITS + 1})) AS INTEGER) AS fold),
tr AS (SELECT idx, y, count(*) OVER () AS m FROM hz WHERE idx < n - {3 * TREE_STEP}), pl AS (SELECT *, m - ({SPLITS + 1} - fold) * (m // {SPLITS + 1}) AS test_start, m // {SPLITS + 1} AS size FROM tr, c, k)
SELECT candidate, fold, CASE candidate {' '.join(f"WHEN {i} THEN '{p['max_depth']}'" for i, p in enumerate(ML.candidates(TRIES)))} END AS max_depth, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx,
  round_even(sum(y), 6) AS y_sum, TRUE AS scored FROM pl WHERE idx >= test_start AND idx < test_start + size GROUP BY candidate, fold""")
def parameter_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Two draws from the whole ranges over three expanding folds of a training part, each fold imputed and encoded by its own
    training rows; the scores follow from the written predictions."""
    f = training.walk_forward_folds(_wide_target(spark, sf), "ts", "click", [TREE_STEP], 2)
    tries = ML.candidates(TRIES)
    preds = training.sweep_folds(training.inner_folds(f, TREE_STEP, 1, SPLITS), tries)
    scores = training.sweep_scores(preds, tries)
    square = (F.col("y") - F.col("y_pred")) * (F.col("y") - F.col("y_pred"))
    again = preds.groupBy("candidate", "fold").agg(F.sqrt(F.avg(square)).alias("e")).groupBy("candidate").agg(F.avg("e").alias("e"))
    checked = scores.join(again, "candidate").select("candidate", F.col("params")["max_depth"].alias("max_depth"), (F.abs(F.col("rmse") - F.col("e")) < 1e-9).alias("scored"))
    out = preds.groupBy("candidate", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum("y").alias("y_sum"))
    return rounded(out.join(checked, "candidate"))


@query(f"""WITH {EVALUATION}, s AS (SELECT model_name, target_column, step, fold, {SCORED} FROM fu GROUP BY ALL),
a AS (SELECT model_name, step, fold, rmse, round_even(rmse, 6) AS r FROM s)
SELECT model_name AS model, 'general' AS mode, CAST(2 AS BIGINT) AS runs, count(*) AS logged, CAST(arg_min(step, [r, step, fold]) AS INTEGER) AS step, round_even(min(rmse), 6) AS rmse,
  round_even((SELECT avg(rmse) FROM s WHERE s.model_name = a.model_name AND s.step = 1), 6) AS best_mean FROM a GROUP BY model_name""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs log their scores, the second one twice as a retry does; best fold per model from the log, best mean from the snapshots."""
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    _, preds = training.general_mode(_wide_target(spark, sf), "ts", "click", STEPS, 3, _baselines())
    scored, best = checkpointed(EV.score(preds)), EV.BestTable(f"{folder}/best")
    for run in ("first", "second", "second"):
        log = EV.RunLog(f"{folder}/log", run)
        log.append(scored, "general", {"SARIMA": {"order": 3, "exog": EXOG}})
        best.merge(EV.summarise(scored))
    runs = log.read(spark)
    total = runs.groupBy("model", "mode").agg(F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.bround(F.col("metrics")["rmse"], 6), "step", "fold")
    lowest = runs.groupBy("model").agg(F.min_by("step", order).alias("step"), F.min(F.col("metrics")["rmse"]).alias("rmse"))
    means = best.read(spark).where("step = 1 AND model_name LIKE '%_BEST'").select(F.regexp_replace("model_name", "_BEST$", "").alias("model"), F.col("rmse").alias("best_mean"))
    out = total.join(lowest, "model").join(means, "model")
    return rounded(out.select("model", "mode", "runs", (F.col("_n") / F.col("runs")).cast("bigint").alias("logged"), "step", "rmse", "best_mean"))


COLS = [f"level_{s}" for s in STATIONS]
SNAP = HOURLY_WIDE + f""", r1 AS (SELECT ts, ln(1 + click) AS level_click, {', '.join(f'"{s}" AS level_{s}' for s in STATIONS if s != 'click')}, row_number() OVER (ORDER BY ts) - 1 AS idx FROM wide WHERE click IS NOT NULL),
r2 AS (SELECT *, lead(level_click, 24) OVER (ORDER BY idx) AS y FROM r1),
r3 AS (SELECT *, count(*) FILTER (ts < TIMESTAMP '2024-01-20') OVER () AS known FROM r2 WHERE y IS NOT NULL AND ts < TIMESTAMP '2024-01-27'),
r4 AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'test' WHEN idx >= known - 24 THEN 'val' ELSE 'train' END AS role FROM r3),
ix AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY ts) - 1 AS place FROM r4),
points AS ({' UNION ALL '.join(f"SELECT role || '|{c}' AS series, place AS idx, {c} AS value FROM ix WHERE {c} IS NOT NULL" for c in COLS)}), {spline_sql('points', 96)},
full_ AS (SELECT ix.ts, ix.idx, role, y, {', '.join(f'round_even(coalesce(ix.{c}, f_{c}.fill) * 1000, 0) / 1000 AS {c}' for c in COLS)} FROM ix
  {' '.join(f"LEFT JOIN fills f_{c} ON f_{c}.series = role || '|{c}' AND f_{c}.idx = ix.place" for c in COLS)}),
med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS d_{c}' for c in COLS)} FROM full_ WHERE role = 'train'),
fit AS (SELECT {', '.join(f'avg(coalesce({c}, d_{c})) AS a_{c}, stddev_pop(coalesce({c}, d_{c})) AS s_{c}' for c in COLS)} FROM full_, med WHERE role = 'train')"""


@query(f"""WITH RECURSIVE {SNAP} SELECT idx, ts, role AS split, CAST(24 AS INTEGER) AS step, round_even(y, 6) AS target, 'DUMMY' AS model_name,
{', '.join(f'round_even((coalesce({c}, d_{c}) - a_{c}) / s_{c}, 6) + 0.0 AS {c}' for c in COLS)}, {CALENDAR} FROM full_, med, fit""")
def feature_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.prepare(hourly_wide(spark, sf).select("ts", *[F.col(s).alias(f"level_{s}") for s in STATIONS]), "ts", "level_click")
    split = splits.event_split(training.with_horizon(rows, "level_click", 24), "ts", "2024-01-20", "2024-01-27", 24)
    return rounded(training.feature_snapshot(split, "ts", "DUMMY", "level_click"))
