import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugeline.operators import windows as W
from gaugeline.operators.gaps import gap_blocks, gap_distribution, missing_rate


def series(spark, values, name="a"):
    pdf = pd.DataFrame({"s": name, "idx": np.arange(len(values)), "v": values})
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def noisy(n, seed=0, holes=0.1):
    rng = np.random.default_rng(seed)
    v = np.cumsum(rng.normal(size=n)) + 50
    v[rng.random(n) < holes] = np.nan
    return v


def test_rolling_rules_of_missing_values(spark):
    made = W.row_features(series(spark, [1.0, 2.0, np.nan, 4.0, 5.0]), ["s"], "idx", ["v"], windows=[2], sums=[2]).orderBy("idx").collect()
    assert [r["rolling_mean_2_v"] for r in made] == [None, 1.5, None, None, 4.5]
    assert [r["cum_sum_2_v"] for r in made] == [1.0, 3.0, 2.0, 4.0, 9.0]


def test_features_equal_pandas(spark, small_chunks):
    v = noisy(400)
    v[100:140] = 7.25
    made = W.row_features(series(spark, v), ["s"], "idx", ["v"], lags=[1, 5], windows=[3, 10], sums=[4, 60]).orderBy("idx").toPandas()
    s = pd.Series(v)
    for k in (1, 5):
        assert np.allclose(made[f"lag_{k}_v"], s.shift(k), equal_nan=True)
    for w in (3, 10):
        assert np.allclose(made[f"rolling_mean_{w}_v"], s.rolling(w).mean(), equal_nan=True)
        assert np.allclose(made[f"rolling_std_{w}_v"], s.rolling(w).std(), equal_nan=True, atol=1e-7)
    for w in (4, 60):
        assert np.allclose(made[f"cum_sum_{w}_v"], s.rolling(w, min_periods=1).sum(), equal_nan=True)
    assert list(made.loc[110:139, "rolling_std_10_v"]) == [0.0] * 30
    assert list(made.loc[110:139, "rolling_mean_10_v"]) == [7.25] * 30


def test_engineered_columns_are_zero_filled(spark):
    made = W.engineer(series(spark, [np.nan, 2.0, 3.0]), ["s"], "idx", ["v"], [1], [2], [2]).orderBy("idx").collect()
    assert [r["v"] for r in made] == [None, 2.0, 3.0]
    assert [r["lag_1_v"] for r in made] == [0.0, 0.0, 2.0]
    whole = W.engineer(series(spark, [np.nan, 2.0, 3.0]), ["s"], "idx", ["v"], [1], [2], [2], compat=True).orderBy("idx").collect()
    assert [r["v"] for r in whole] == [0.0, 2.0, 3.0]
    assert [r["rolling_mean_2_v"] for r in whole] == [0.0, 1.0, 2.5]


def test_horizon_targets_drop_the_tail(spark, small_chunks):
    v = np.arange(50.0)
    got = W.horizon_targets(series(spark, v), ["s"], "idx", "v", [1, 24]).toPandas()
    assert len(got) == 49 + 26
    assert ((got["y"] - got["v"]) == got["step"]).all()


def test_sequences(spark, small_chunks):
    df = series(spark, np.arange(30.0)).withColumn("w", F.col("v") * 10)
    got = W.sequences(df, ["s"], "idx", ["v", "w"], 4, "v").orderBy("idx").collect()
    assert len(got) == 26
    assert got[0]["x"] == [[i, i * 10.0] for i in range(4)] and got[0]["y"] == 4.0
    assert got[-1]["x"][-1] == [28.0, 280.0] and got[-1]["y"] == 29.0
    assert W.sequences(series(spark, np.arange(4.0)), ["s"], "idx", ["v"], 4, "v").count() == 0


def test_padding(spark):
    got = W.pad_predictions(series(spark, [np.nan, np.nan, 3.0, np.nan, 5.0]), ["s"], "idx", "v").orderBy("idx").collect()
    assert [r["v"] for r in got] == [3.0, 3.0, 3.0, None, 5.0]


def test_rolling_mode(spark, small_chunks):
    rng = np.random.default_rng(5)
    codes = [None if x == 9 else int(x) for x in rng.choice([0, 1, 2, 5, 9], 120)]
    codes[40:60] = [None] * 20
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(codes)], "s string, idx long, c long")
    got = [r["mode_7"] for r in W.rolling_mode(df, ["s"], "idx", "c", [7]).orderBy("idx").collect()]
    for i, mode in enumerate(got):
        seen = [c for c in codes[max(0, i - 6) : i + 1] if c is not None]
        assert mode == (min(set(seen), key=lambda c: (-seen.count(c), c)) if seen else None)


def test_gap_blocks_with_long_gaps(spark):
    v = noisy(300, 2, 0.4)
    v[:7] = np.nan
    v[50:190] = np.nan
    v[-4:] = np.nan
    df = series(spark, v).unionByName(series(spark, np.full(9, np.nan), "empty")).unionByName(series(spark, np.ones(5), "full"))
    got = gap_blocks(df, ["s"], "idx", "v", rows=8).toPandas()
    missing = np.isnan(v)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], missing.astype(int), [0]])))
    expected = {(int(a), int(b)) for a, b in edges.reshape(-1, 2)}
    mine = got[got.s == "a"]
    assert set(zip(mine["gap_start"], mine["gap_end"], strict=True)) == expected
    assert set(mine["kind"]) == {"leading", "trailing", "interior"}
    assert got[got.s == "empty"][["gap_start", "gap_end", "kind"]].values.tolist() == [[0, 9, "all"]]
    assert (got.s == "full").sum() == 0
    counts = gap_distribution(df.filter("s = 'a'"), ["s"], "idx", "v").toPandas()
    assert counts["gaps"].sum() == len(expected)
    assert missing_rate(df, "s", "v", "before").filter("station_id = 'empty'").first()["missing_percentage"] == 100.0


def test_rolling_forgets_levels_spikes_and_nan(spark, small_chunks):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(1e6, 10, 60), rng.normal(0, 1e-3, 60)])
    made = W.row_features(series(spark, v), ["s"], "idx", ["v"], windows=[8], sums=[8]).orderBy("idx").toPandas()
    plain = [np.std(v[k - 7 : k + 1], ddof=1) for k in range(70, 120)]
    assert np.allclose(made["rolling_std_8_v"][70:], plain, rtol=1e-9, atol=0)
    assert np.allclose(made["cum_sum_8_v"][70:], [v[k - 7 : k + 1].sum() for k in range(70, 120)], rtol=0, atol=1e-15)
    spike = series(spark, [1e16, 1.0, 1.0, 1.0, 0.1, 0.2])
    made = W.row_features(spike, ["s"], "idx", ["v"], sums=[2]).orderBy("idx").toPandas()
    assert np.allclose(made["cum_sum_2_v"][2:], [2, 2, 1.1, 0.3], rtol=1e-15)
    holed = spark.range(12).select(F.lit("a").alias("s"), F.col("id").alias("idx"), F.when(F.col("id") == 3, float("nan")).otherwise(F.col("id") + 0.0).alias("v"))
    made = W.row_features(holed, ["s"], "idx", ["v"], windows=[3], sums=[3]).orderBy("idx").toPandas()
    assert made["rolling_mean_3_v"][2] == 1 and made["rolling_mean_3_v"][3:6].isna().all() and made["rolling_mean_3_v"][6] == 5
    assert list(made["cum_sum_3_v"][3:7]) == [3, 6, 9, 15]


def test_any_code_counts(spark):
    df = spark.createDataFrame([("a", k, c) for k, c in enumerate([7, 7, 7, 1])], "s string, idx long, c int")
    got = W.rolling_mode(df, ["s"], "idx", "c", [3]).orderBy("idx").collect()
    assert [r["mode_3"] for r in got] == [7, 7, 7, 7]


def test_modes_of_ten_thousand_codes(spark, small_chunks):
    import collections

    import numpy as np

    from gaugeline.operators.windows import rolling_mode

    rng = np.random.default_rng(6)
    rows = [(s, i, None if rng.random() < 0.2 else int(rng.integers(0, 10_000)) if rng.random() < 0.5 else int(rng.integers(0, 4))) for s in ("a", None) for i in range(300)]
    rows += [("wide", i, i * 7 % 10_007) for i in range(10_000)]
    got = {(r["s"], r["i"]): (r["mode_5"], r["mode_40"]) for r in rolling_mode(spark.createDataFrame(rows, "s string, i long, c int"), ["s"], "i", "c", [5, 40]).collect()}
    assert len(got) == len(rows)
    for s in ("a", None, "wide"):
        codes = [c for t, _, c in rows if t == s]
        for i in range(0, len(codes), 1 if s != "wide" else 97):
            for k, w in enumerate((5, 40)):
                counts = collections.Counter(c for c in codes[max(0, i - w + 1) : i + 1] if c is not None)
                want = min(counts, key=lambda c: (-counts[c], c)) if counts else None
                assert got[s, i][k] == want


def test_all_windows_share_one_sort(spark):
    """What a task holds does not grow with the windows: every other sort would hold all rows of the task once more."""
    df = spark.range(50).select(F.lit("a").alias("s"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    made = W.row_features(df, ["s"], "i", ["v"], lags=[1], windows=[6, 24], sums=[3, 96, 672, 2880])
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    last = made.orderBy(F.desc("i")).first()
    assert (last["cum_sum_3_v"], last["cum_sum_96_v"], last["rolling_mean_6_v"], last["rolling_mean_24_v"]) == (144.0, 1225.0, 46.5, 37.5)
