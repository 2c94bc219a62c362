import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import outliers as O
from gaugeline.schema import SeriesSchema

SCHEMA = SeriesSchema(key="station", ts="ts", values=("a", "b", "c"), meta=(), signed=())


def ecod(x):
    """Tail scores by counting, one column after the other."""
    n, total = len(x), np.zeros(len(x))
    for j in range(x.shape[1]):
        v = x[:, j]
        left = -np.log([(v <= t).sum() / n for t in v])
        right = -np.log([(v >= t).sum() / n for t in v])
        d = v - v.mean()
        skew = 0.0 if d.std() == 0 else (d**3).mean() / (d**2).mean() ** 1.5
        chosen = left if skew < 0 else right if skew > 0 else left + right
        total += np.max([left, right, chosen], axis=0)
    return total


def pca(x):
    live = x.std(axis=0) > 0
    z = (x[:, live] - x[:, live].mean(axis=0)) / x[:, live].std(axis=0)
    weight, axes = np.linalg.eigh(np.cov(z.T, bias=True).reshape(z.shape[1], -1))
    share = weight / weight.sum()
    out = np.zeros(len(x))
    for w, v in zip(share, axes.T, strict=True):
        v = v * np.sign(v[np.argmax(np.abs(v))])
        out += np.sqrt(((z - v) ** 2).sum(axis=1)) / w
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    parts = []
    for name, n in (("full", 300), ("pair", 200), ("empty", 20)):
        base = rng.normal(size=(n, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.4], [0, 0, 1]])
        base = np.round(base, 2)
        base[:: max(n // 6, 1)] *= 6
        part = pd.DataFrame(base, columns=["a", "b", "c"])
        part["station"], part["i"] = name, np.arange(n)
        parts.append(part)
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[pdf.station == "pair", "c"] = np.nan
    pdf.loc[pdf.station == "empty", ["a", "b", "c"]] = np.nan
    pdf.loc[(pdf.station == "full") & (pdf.i % 17 == 3), "b"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.select("station", "i", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"], *[F.lit(0).cast("bigint").alias(f"{c}_Status") for c in "abc"])
    df = df.withColumn("ts", F.timestamp_micros(F.col("i") * 900_000_000).cast("timestamp_ntz"))
    return df, pdf


def expected(pdf, score):
    out = {}
    for name, columns in (("full", ["a", "b", "c"]), ("pair", ["a", "b"])):
        part = pdf[pdf.station == name].dropna(subset=columns)
        out.update(zip(zip(part.station, part.i, strict=True), score(part[columns].to_numpy()), strict=True))
    return out


@pytest.mark.parametrize("name", ["ecod", "pca"])
def test_scores_equal_counting(rows, name):
    df, pdf = rows
    marked = O.mark_complete(df, ["station"], ["a", "b", "c"])
    fn = {"ecod": O.ecod_score, "pca": O.pca_score}[name]
    got = {(r["station"], r["i"]): r[name] for r in fn(marked, ["station"], ["a", "b", "c"]).collect()}
    want = expected(pdf, {"ecod": ecod, "pca": pca}[name])
    assert len(got) == len(pdf)
    for key, value in got.items():
        assert (value is None) == (key not in want)
        if value is not None:
            assert value == pytest.approx(want[key], rel=1e-9)


def test_constant_metric_is_ignored_by_the_axes(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": "x", "a": rng.normal(size=80), "b": 7.0, "c": rng.normal(size=80)})
    marked = O.mark_complete(spark.createDataFrame(pdf), ["s"], ["a", "b", "c"])
    got = O.pca_score(marked, ["s"], ["a", "b", "c"]).toPandas()
    assert np.allclose(np.sort(got["pca"]), np.sort(pca(pdf[["a", "b", "c"]].to_numpy())))


@pytest.mark.parametrize("method", ["iqr", "percentile"])
def test_consensus_and_removal(rows, method):
    df, pdf = rows
    flagged = O.flag_outliers(df, SCHEMA, method, 0.97).toPandas()
    scores = {n: expected(pdf, f) for n, f in (("ecod", ecod), ("pca", pca))}
    hits = None
    for n, found in scores.items():
        mine = set()
        for station in ("full", "pair"):
            values = {k: v for k, v in found.items() if k[0] == station}
            q1, q3, p = np.percentile(list(values.values()), [25, 75, 97])
            limit = q3 + 1.5 * (q3 - q1) if method == "iqr" else p
            mine |= {k for k, v in values.items() if v > limit}
        hits = mine if hits is None else hits & mine
    assert hits
    assert {(r.station, r.i) for r in flagged[flagged.is_outlier].itertuples()} == hits
    cleaned = O.remove_outliers(df, SCHEMA, method, 0.97).toPandas()
    before = pdf.set_index(["station", "i"])
    for r in cleaned.itertuples():
        was = before.loc[(r.station, r.i)]
        for c in "abc":
            value, status = getattr(r, c), getattr(r, f"{c}_Status")
            if (r.station, r.i) in hits:
                assert np.isnan(value) and status == (0 if (r.station, c) == ("pair", "c") else 5)
            else:
                assert status == 0 and (value == was[c] or np.isnan(was[c]))


def test_all_rows_as_one_group(rows):
    df, pdf = rows
    both = df.filter("station <> 'empty'")
    flagged, report = O.compare_detectors(both, SCHEMA, features=["a", "b"])
    x = pdf[pdf.station != "empty"].dropna(subset=["a", "b"])[["a", "b"]].to_numpy()
    scores = ecod(x)
    q1, q3 = np.percentile(scores, [25, 75])
    got = {r["detector"]: r for r in report.collect()}
    assert got["ecod"]["rows"] == len(x) and got["ecod"]["outliers"] == (scores > q3 + 1.5 * (q3 - q1)).sum()
    one, _ = O.compare_detectors(both, SCHEMA, "pair", features=["a", "b"])
    assert one.count() == 200 and one.columns[:2] == ["station", "i"]


def test_unknown_method(rows):
    with pytest.raises(ValueError):
        O.flag_outliers(rows[0], SCHEMA, "other")


def test_planted_outliers(spark):
    base = spark.range(400).select(F.lit("s").alias("station"), "id", *[(F.randn(i) * 0.3 + 2).alias(c) for i, c in enumerate("ab")])
    odd = spark.range(400, 420).select(F.lit("s").alias("station"), "id", (F.rand(1) * 2 + 8).alias("a"), (F.rand(2) * 2 - 9).alias("b"))
    schema = SeriesSchema(key="station", ts="id", values=("a", "b"), meta=(), signed=())
    flagged = O.flag_outliers(base.unionByName(odd).withColumn("truth", F.col("id") >= 400), schema)
    errors = O.label_errors(flagged, ["station"], "is_outlier", "truth").first()
    assert errors["errors"] <= 10
    report = {r["detector"]: r for r in O.detector_report(flagged, ["station"]).collect()}
    assert report["ecod"]["rows"] == 420 and report["pca"]["outliers"] >= 20


def test_projection_keeps_distances(rows):
    df, pdf = rows
    marked = O.mark_complete(df, ["station"], ["a", "b"]).filter("station = 'pair'")
    got = O.project(marked, ["station"], ["a", "b"]).orderBy("i").toPandas()
    x = pdf[pdf.station == "pair"][["a", "b"]].to_numpy()
    x = x - x.mean(axis=0)
    assert np.allclose(got["pc1"] ** 2 + got["pc2"] ** 2, (x**2).sum(axis=1))
    assert got["explained1"][0] + got["explained2"][0] == pytest.approx(1.0) and got["explained1"][0] >= got["explained2"][0]
    assert got["pc1"].var() >= got["pc2"].var()


def test_samples(spark):
    df = spark.range(9000).select("id", (F.col("id") % 3 == 0).alias("flag"))
    got = O.display_sample(df, "flag", ["id"], seed=7).toPandas()
    assert got["flag"].sum() == 2000 and (~got["flag"]).sum() == 3000 and got["id"].is_unique
    again = O.display_sample(df.repartition(7), "flag", ["id"], seed=7).toPandas()
    assert set(again["id"]) == set(got["id"])
    few = O.display_sample(df.filter("id < 30"), "flag", ["id"]).toPandas()
    assert len(few) == 30


def test_rows_are_ranked_over_range_edges(spark):
    import numpy as np

    from gaugeline.operators.chunks import ranked_rows

    rng = np.random.default_rng(4)
    rows = [(int(i), None if i % 3 else "a", None if i % 50 == 7 else float(v)) for i, v in enumerate(np.where(rng.random(4000) < 0.4, 0.0, rng.integers(-5, 200, 4000)))]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(6)
    got = ranked_rows(df, ["g"], "v", F.xxhash64("id")).collect()
    assert len({r["id"] for r in got}) == sum(v is not None for _, _, v in rows) == len(got)
    for g in ("a", None):
        mine = np.sort([v for _, h, v in rows if h == g and v is not None])
        for r in (r for r in got if r["g"] == g):
            assert r["n"] == len(mine) and r["below"] == np.searchsorted(mine, r["v"]) and r["below"] + r["cnt"] == np.searchsorted(mine, r["v"], "right")


def test_a_station_without_a_name_is_flagged(spark):
    import numpy as np

    from gaugeline import SeriesSchema
    from gaugeline.operators.outliers import flag_outliers

    rng = np.random.default_rng(5)
    values = [(float(a), float(b)) for a, b in rng.normal(0, 1, (300, 2))] + [(40.0, 40.0)]
    rows = [(s, i, a, b) for s in ("a", None) for i, (a, b) in enumerate(values)]
    own = SeriesSchema(key="s", ts="i", values=("u", "w"), meta=(), signed=())
    got = flag_outliers(spark.createDataFrame(rows, "s string, i long, u double, w double"), own).collect()
    flagged = {s: {r["i"] for r in got if r["s"] == s and r["is_outlier"]} for s in ("a", None)}
    assert flagged["a"] == flagged[None] and 300 in flagged["a"]
    scores = {s: sorted((r["i"], r["ecod"]) for r in got if r["s"] == s) for s in ("a", None)}
    assert scores["a"] == scores[None] and all(e is not None for _, e in scores[None])
