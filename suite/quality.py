"""Outlier scores, consensus, removal, sampling; gap filling with the spline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import outliers
from gaugeline.operators.impute import fill_gaps, impute_wide
from gaugeline.plans import etl
from gaugeline.schema import SeriesSchema
from suite.frames import DENSE, HI, HOURLY_WIDE, LO, QUARTER, QUARTER_HOUR, SCHEMA, STATIONS, hourly_wide, quarter, rounded, table
from suite.registry import query

QC = SeriesSchema(key="station", ts="ts", values=("level", "rain"), meta=(), signed=())


def _tails(f: str) -> str:
    return f"""-ln(cume_dist() OVER (PARTITION BY station ORDER BY {f})) AS l_{f}, -ln(cume_dist() OVER (PARTITION BY station ORDER BY {f} DESC)) AS r_{f},
    avg(pow({f} - m_{f}, 3)) OVER (PARTITION BY station) AS g_{f}"""


def _side(f: str) -> str:
    return f"greatest(l_{f}, r_{f}, CASE WHEN g_{f} < 0 THEN l_{f} WHEN g_{f} > 0 THEN r_{f} ELSE l_{f} + r_{f} END)"


def _ecod(source: str, features: list[str]) -> str:
    """SQL of the score over complete rows of ``source``; all given metrics are present there."""
    means = ", ".join(f"avg({f}) OVER (PARTITION BY station) AS m_{f}" for f in features)
    return f"""ec1 AS (SELECT *, {means} FROM {source}), ec2 AS (SELECT *, {', '.join(_tails(f) for f in features)} FROM ec1),
    ec AS (SELECT *, {' + '.join(_side(f) for f in features)} AS ecod FROM ec2)"""


COMPLETE = QUARTER + ", comp AS (SELECT * FROM quarter WHERE level IS NOT NULL AND rain IS NOT NULL)"
# Two standardised metrics have the axes (1, 1) and (1, -1), with variance shares (1 + r) / 2 and (1 - r) / 2.
SCORED = ", " + _ecod("comp", ["level", "rain"]) + """, st AS (SELECT station, avg(level) AS ml, avg(rain) AS mr, stddev_pop(level) AS sl, stddev_pop(rain) AS sr, corr(level, rain) AS r
  FROM comp GROUP BY station), z AS (SELECT ec.*, (level - ml) / sl AS zl, (rain - mr) / sr AS zr, r FROM ec JOIN st USING (station)),
scored AS (SELECT *, sqrt(pow(zl - sqrt(0.5), 2) + pow(zr - sqrt(0.5), 2)) / ((1 + r) / 2) + sqrt(pow(zl - sqrt(0.5), 2) + pow(zr + sqrt(0.5), 2)) / ((1 - r) / 2) AS pca FROM z)"""


SCORES = COMPLETE + SCORED


def _limit(score: str, method: str) -> str:
    if method == "iqr":
        return f"quantile_cont({score}, 0.75) + 1.5 * (quantile_cont({score}, 0.75) - quantile_cont({score}, 0.25))"
    return f"quantile_cont({score}, {method})"


def _flagged(method: str, complete: str = COMPLETE) -> str:
    return complete + SCORED + f""", lim AS (SELECT station, {_limit('ecod', method)} AS ecod_threshold, {_limit('pca', method)} AS pca_threshold FROM scored GROUP BY station),
    flagged AS (SELECT s.*, ecod_threshold, pca_threshold, ecod > ecod_threshold AS ecod_outlier, pca > pca_threshold AS pca_outlier,
      ecod > ecod_threshold AND pca > pca_threshold AS is_outlier FROM scored s JOIN lim USING (station))"""


THREE = QUARTER + """, q3 AS (SELECT *, CASE WHEN station NOT IN ('click', 'view') THEN temp END AS flow FROM quarter),
full3 AS (SELECT * FROM q3 WHERE level IS NOT NULL AND rain IS NOT NULL AND flow IS NOT NULL AND station NOT IN ('click', 'view')),
full2 AS (SELECT * FROM q3 WHERE level IS NOT NULL AND rain IS NOT NULL AND station IN ('click', 'view')), """


@query(f"""WITH {THREE} {_ecod('full3', ['level', 'rain', 'flow'])}, {_ecod('full2', ['level', 'rain']).replace('ec1', 'ed1').replace('ec2', 'ed2').replace('ec AS', 'ed AS')}
SELECT q3.station, q3.ts, round_even(coalesce(ec.ecod, ed.ecod), 6) AS ecod FROM q3 LEFT JOIN ec USING (station, ts) LEFT JOIN ed USING (station, ts)""")
def ecod_score(spark: SparkSession, sf: str) -> DataFrame:
    features = ["level", "rain", "flow"]
    flow = F.when(~F.col("station").isin("click", "view"), F.col("temp"))
    marked = outliers.mark_complete(quarter(spark, sf).withColumn("flow", flow), ["station"], features)
    return rounded(outliers.ecod_score(marked, ["station"], features).select("station", "ts", "ecod"))


@query(f"WITH {SCORES} SELECT station, ts, round_even(pca, 6) AS pca FROM scored")
def pca_score(spark: SparkSession, sf: str) -> DataFrame:
    marked = outliers.mark_complete(quarter(spark, sf), ["station"], ["level", "rain"]).filter("_complete")
    return rounded(outliers.pca_score(marked, ["station"], ["level", "rain"]).select("station", "ts", "pca"))


@query(f"""WITH {_flagged('iqr')} SELECT station, round_even(max(ecod_threshold), 6) AS ecod_threshold, count(*) FILTER (ecod_outlier) AS outliers FROM flagged GROUP BY station""")
def ecod_threshold_flag(spark: SparkSession, sf: str) -> DataFrame:
    flagged = outliers.flag_outliers(quarter(spark, sf), QC, "iqr", detectors=["ecod"])
    return rounded(flagged.groupBy("station").agg(F.max("ecod_threshold").alias("ecod_threshold"), F.count_if("ecod_outlier").alias("outliers")))


@query(f"""WITH {_flagged('0.9')} SELECT q.station, q.ts, coalesce(ecod_outlier, false) AS ecod_outlier, coalesce(pca_outlier, false) AS pca_outlier, coalesce(is_outlier, false) AS is_outlier
FROM quarter q LEFT JOIN flagged USING (station, ts)""")
def consensus_flag(spark: SparkSession, sf: str) -> DataFrame:
    flagged = outliers.flag_outliers(quarter(spark, sf), QC, "percentile", 0.9)
    return flagged.select("station", "ts", "ecod_outlier", "pca_outlier", "is_outlier")


@query(f"""WITH {_flagged('0.9')} SELECT q.station, q.ts, CASE WHEN coalesce(is_outlier, false) THEN NULL ELSE q.level END AS level,
  CASE WHEN coalesce(is_outlier, false) THEN 5 ELSE q."level_Status" END AS "level_Status", CASE WHEN coalesce(is_outlier, false) THEN NULL ELSE q.rain END AS rain
FROM quarter q LEFT JOIN flagged USING (station, ts)""")
def outlier_removal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.remove_outliers(quarter(spark, sf).drop("temp"), QC, "percentile", 0.9))


def _report(d: str) -> str:
    return f"""SELECT station, '{d}' AS detector, round_even(max({d}_threshold), 6) AS threshold, count(*) FILTER ({d}_outlier) AS outliers, count(*) AS rows,
    round_even(100.0 * count(*) FILTER ({d}_outlier) / count(*), 6) AS outlier_rate FROM flagged GROUP BY station"""


@query(f"WITH {_flagged('0.95')} {_report('ecod')} UNION ALL {_report('pca')}")
def detector_comparison(spark: SparkSession, sf: str) -> DataFrame:
    flagged = outliers.flag_outliers(quarter(spark, sf), QC, "percentile", 0.95)
    return rounded(outliers.detector_report(flagged, ["station"]))


@query(f"WITH {_flagged('0.95')}, report AS ({_report('ecod')} UNION ALL {_report('pca')}) SELECT * FROM report WHERE station = 'view'")
def station_detectors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.compare_detectors(quarter(spark, sf), QC, "view", "percentile", 0.95)[1])


@query(f"WITH {_flagged('0.95').replace('FROM quarter', 'FROM (SELECT * REPLACE (' + chr(39) + 'all' + chr(39) + ' AS station) FROM quarter)')} {_report('ecod')} UNION ALL {_report('pca')}")
def all_detectors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.compare_detectors(quarter(spark, sf), QC, None, "percentile", 0.95)[1])


@query(f"""WITH {COMPLETE}, s AS (SELECT station, avg(level) AS ml, avg(rain) AS mr, var_pop(level) AS a, covar_pop(level, rain) AS b, var_pop(rain) AS c FROM comp GROUP BY station),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM s),
v AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS x1, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS y1 FROM e),
w AS (SELECT *, CASE WHEN abs(x1) >= abs(y1) THEN sign(x1) ELSE sign(y1) END AS s1, CASE WHEN abs(y1) >= abs(x1) THEN sign(-y1) ELSE sign(x1) END AS s2 FROM v)
SELECT station, ts, round_even(s1 * ((level - ml) * x1 + (rain - mr) * y1), 6) AS pc1, round_even(l1 / (l1 + l2), 6) AS explained1,
  round_even(s2 * ((level - ml) * -y1 + (rain - mr) * x1), 6) AS pc2, round_even(l2 / (l1 + l2), 6) AS explained2 FROM comp JOIN w USING (station)""")
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    marked = outliers.mark_complete(quarter(spark, sf), ["station"], ["level", "rain"])
    made = outliers.project(marked, ["station"], ["level", "rain"])
    return rounded(made.select("station", "ts", "pc1", "explained1", "pc2", "explained2"))


@query("""SELECT event_id, value, flag FROM (SELECT event_id, value, value > 100 AS flag, row_number() OVER (PARTITION BY value > 100 ORDER BY event_id) AS r FROM events)
WHERE r <= CASE WHEN flag THEN 300 ELSE 1500 END""")
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "value", (F.col("value") > 100).alias("flag"))
    return outliers.capped_sample(rows, "flag", ["event_id"], {True: 300, False: 1500})


@query("""WITH e AS (SELECT event_id, value, value > 100 AS flag, row_number() OVER (PARTITION BY value > 100 ORDER BY event_id) AS r, count(*) FILTER (value > 100) OVER () AS hits FROM events)
SELECT event_id, value, flag FROM e WHERE r <= CASE WHEN flag THEN 2000 ELSE greatest(1000, 5000 - least(hits, 2000)) END""")
def display_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "value", (F.col("value") > 100).alias("flag"))
    return outliers.display_sample(rows, "flag", ["event_id"], seed=None)


@query()
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "value", (F.col("value") > 100).alias("flag"))
    return outliers.display_sample(rows, "flag", ["event_id"], seed=42)


def spline_sql(points: str, limit: int) -> str:
    """CTEs from ``points(series, idx, value)`` to ``fills(series, idx, fill)``: the global natural spline, solved row by row."""
    return f"""kn AS (SELECT series, idx AS x, value AS y, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY series) AS n,
      lead(idx) OVER w - idx AS h, (lead(value) OVER w - value) / (lead(idx) OVER w - idx) AS s FROM {points} WINDOW w AS (PARTITION BY series ORDER BY idx)),
    sys AS (SELECT *, lag(h) OVER w AS a, 2.0 * (lag(h) OVER w + h) AS b, 6.0 * (s - lag(s) OVER w) AS r FROM kn WINDOW w AS (PARTITION BY series ORDER BY j)),
    fwd AS (SELECT series, j, n, h / b AS cp, r / b AS dp FROM sys WHERE j = 1 AND n > 2
      UNION ALL SELECT t.series, t.j, t.n, t.h / (t.b - t.a * f.cp), (t.r - t.a * f.dp) / (t.b - t.a * f.cp) FROM fwd f JOIN sys t ON t.series = f.series AND t.j = f.j + 1 WHERE t.j < t.n - 1),
    bwd AS (SELECT series, j, dp AS m FROM fwd WHERE j = n - 2
      UNION ALL SELECT f.series, f.j, f.dp - f.cp * b.m FROM bwd b JOIN fwd f ON f.series = b.series AND f.j = b.j - 1),
    seg AS (SELECT k.series, k.x, k.y, k.h, k2.y AS y2, coalesce(m1.m, 0) AS m1, coalesce(m2.m, 0) AS m2 FROM kn k JOIN kn k2 ON k2.series = k.series AND k2.j = k.j + 1
      LEFT JOIN bwd m1 ON m1.series = k.series AND m1.j = k.j LEFT JOIN bwd m2 ON m2.series = k.series AND m2.j = k.j + 1 WHERE k.h BETWEEN 2 AND {limit + 1} AND k.n >= 4),
    cells AS (SELECT *, unnest(range(1, h)) AS t FROM seg),
    rng AS (SELECT series, min(value) AS lo, max(value) AS hi, count(value) AS n FROM {points} GROUP BY series),
    fills AS (SELECT c.series, x + t AS idx, least(greatest((m1 * pow(h - t, 3) + m2 * pow(t, 3)) / (6.0 * h) + (y / h - m1 * h / 6.0) * (h - t) + (y2 / h - m2 * h / 6.0) * t,
      CASE WHEN c.series LIKE '%temp%' THEN lo - 0.5 * (hi - lo) ELSE greatest(lo - 0.5 * (hi - lo), 0) END), hi + 0.5 * (hi - lo)) AS fill
      FROM cells c JOIN rng USING (series))"""


def _even(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0.0)"


LIMIT = 4
METRICS = ["level", "rain", "temp"]
POINTS = ", points AS (" + " UNION ALL ".join(
    f"SELECT station || '|{m}' AS series, idx, {m} AS value FROM dense WHERE {m} IS NOT NULL" for m in METRICS
) + "), "
FILLED = "WITH RECURSIVE " + DENSE + POINTS + spline_sql("points", LIMIT)
JOINS = " ".join(f"LEFT JOIN fills f_{m} ON f_{m}.series = d.station || '|{m}' AND f_{m}.idx = d.idx" for m in METRICS)
META = "meta AS (SELECT event_type AS station, CAST(max(user_id) AS DOUBLE) AS altitude, max(props) AS river FROM events GROUP BY 1)"


@query(f"""{FILLED}, {META} SELECT d.ts, d.station, {', '.join(f"{_even(f'coalesce(d.{m}, f_{m}.fill)', 1)} AS {m}" for m in METRICS)},
  CAST(CASE WHEN d.level IS NULL THEN 4 ELSE coalesce(d."level_Status", 0) END AS BIGINT) AS "level_Status", altitude, river
FROM dense d {JOINS} LEFT JOIN meta USING (station)""")
def spline_fill(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "events").groupBy(F.col("event_type").alias("station")).agg(
        F.max("user_id").cast("double").alias("altitude"), F.max("props").alias("river")
    )
    filled, _ = fill_gaps(quarter(spark, sf), SCHEMA, LO, HI, QUARTER_HOUR, LIMIT, meta=meta)
    return filled.withColumns({m: F.col(m) + F.lit(0.0) for m in METRICS})


@query(f"""{FILLED} SELECT station AS station_id, 'before' AS period, round_even(100.0 * count(*) FILTER (level IS NULL) / count(*), 6) AS missing_percentage FROM dense GROUP BY station
UNION ALL SELECT d.station, 'after', round_even(100.0 * count(*) FILTER (d.level IS NULL AND f_level.fill IS NULL) / count(*), 6) FROM dense d {JOINS} GROUP BY d.station""")
def missing_before_after(spark: SparkSession, sf: str) -> DataFrame:
    _, missing = fill_gaps(quarter(spark, sf), SCHEMA, LO, HI, QUARTER_HOUR, LIMIT)
    return rounded(missing)


SPLIT = "CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END"
WIDE_POINTS = ", ".join(["x AS (SELECT *, " + SPLIT + " AS split FROM wide)", "ix AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ts) - 1 AS idx FROM x)"]) + ", points AS (" + " UNION ALL ".join(
    f"SELECT split || '|{s}' AS series, idx, \"{s}\" AS value FROM ix WHERE \"{s}\" IS NOT NULL" for s in STATIONS
) + "), "


@query(f"""WITH RECURSIVE {HOURLY_WIDE}, {WIDE_POINTS} {spline_sql('points', 3)}
SELECT ix.ts, split, {', '.join(f'''{_even(f'coalesce(ix."{s}", f_{s}.fill)', 3)} AS level_{s}''' for s in STATIONS)}, CAST(CASE WHEN ix.click IS NULL AND f_click.fill IS NOT NULL THEN 4 ELSE 0 END AS BIGINT) AS "level_Status_click"
FROM ix {' '.join(f"LEFT JOIN fills f_{s} ON f_{s}.series = split || '|{s}' AND f_{s}.idx = ix.idx" for s in STATIONS)}""")
def wide_impute(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda d: F.col("ts") < F.lit(d).cast("timestamp_ntz")
    split = F.when(day("2024-01-20"), "train").when(day("2024-01-25"), "val").otherwise("test")
    wide = hourly_wide(spark, sf).select(
        "ts", split.alias("split"), *[F.col(s).alias(f"level_{s}") for s in STATIONS], F.lit(0).cast("bigint").alias("level_Status_click")
    )
    made = impute_wide(wide, "ts", [f"level_{s}" for s in STATIONS], "split", 3)
    return made.withColumns({f"level_{s}": F.col(f"level_{s}") + F.lit(0.0) for s in STATIONS})


def _wide_cells(metrics: list[str]) -> str:
    return ", ".join(f"max({m}) FILTER (station = '{s}') AS \"{m}_{s}\"" for s in STATIONS for m in metrics)


# The stages one after the other: fill, flag, remove, hourly means, wide.
STAGED = FILLED + f""", filled AS (SELECT d.station, d.ts, {_even('coalesce(d.level, f_level.fill)', 1)} AS level, {_even('coalesce(d.rain, f_rain.fill)', 1)} AS rain,
  CASE WHEN d.level IS NULL THEN 4 ELSE coalesce(d."level_Status", 0) END AS status FROM dense d {JOINS}),
comp AS (SELECT * FROM filled WHERE level IS NOT NULL AND rain IS NOT NULL)"""


@query(f"""{_flagged('iqr', STAGED)}, kept AS (SELECT f.station, date_trunc('hour', f.ts) AS ts, coalesce(is_outlier, false) AS gone, f.level, f.rain, f.status FROM filled f LEFT JOIN flagged USING (station, ts)),
hourly AS (SELECT station, ts, {_even('avg(CASE WHEN NOT gone THEN level END)', 3)} AS level, CAST(max(CASE WHEN gone THEN 5 ELSE status END) AS DOUBLE) AS "level_Status",
  {_even('avg(CASE WHEN NOT gone THEN rain END)', 3)} AS rain FROM kept GROUP BY 1, 2)
SELECT ts, {_wide_cells(['level', '"level_Status"', 'rain'])} FROM hourly GROUP BY ts""".replace('""level_Status"_', '"level_Status_'))
def etl_hourly_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings through cleaning, gap filling, consensus outlier removal and resampling to the wide frame."""
    rules = {"level": "mean", "rain": "mean", "level_Status": "max"}
    names = [f"{m}_{s}" for s in STATIONS for m in ("level", "level_Status", "rain")]
    made = etl.build(
        quarter(spark, sf).drop("temp"), schema=QC, aliases={}, lo=LO, hi=HI, step=QUARTER_HOUR, rules=rules, names=names, fallback={}, max_fill_steps=LIMIT
    )["melted"]
    return made.select("ts", *[(F.col(n) + F.lit(0.0)).alias(n) for n in names])
