import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.operators import impute as I
from gaugeline.schema import SeriesSchema

SCHEMA = SeriesSchema(key="station", ts="ts", values=("level", "Temperatura_Interna"), meta=("Altitude",), signed=("Temperatura_Interna",))
LO, HI = "2024-01-01", "2024-01-01 23:45:00"


def dense_spline(pos, val, at):
    """Natural cubic spline by one dense solve."""
    n = len(pos)
    h, slope = np.diff(pos), np.diff(val) / np.diff(pos)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    m = np.linalg.solve(a, b)
    out = []
    for x in at:
        j = min(np.searchsorted(pos, x, side="right") - 1, n - 2)
        u, w = pos[j + 1] - x, x - pos[j]
        out.append((m[j] * u**3 + m[j + 1] * w**3) / (6 * h[j]) + (val[j] / h[j] - m[j] * h[j] / 6) * u + (val[j + 1] / h[j] - m[j + 1] * h[j] / 6) * w)
    return np.array(out)


def test_golden_values():
    at, out = I.solve_gaps(np.array([0.0, 1, 4, 5, 6]), np.array([10.0, 12, 20, 19, 15]), np.array([1]))
    assert list(at) == [2, 3]
    assert out == pytest.approx([15.06603774, 18.22641509], abs=1e-8)


@settings(max_examples=30, deadline=None)
@given(st.integers(4, 400), st.integers(0, 10_000))
def test_local_solution_equals_global(n, seed):
    rng = np.random.default_rng(seed)
    pos = np.cumsum(rng.choice([1, 1, 1, 2, 5, 90], n)).astype(float)
    val = rng.normal(0, 100, n)
    left = np.flatnonzero(np.diff(pos) > 1)
    if not len(left):
        return
    at, out = I.solve_gaps(pos, val, left)
    assert np.allclose(out, dense_spline(pos, val, at), rtol=1e-9, atol=1e-7)


def grid_values(spark, values, station="a", column="level"):
    rows = [(station, i, float(v)) for i, v in enumerate(values) if v is not None]
    df = spark.createDataFrame(rows, f"station string, i long, {column} double")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, i * 900)")).drop("i")


def test_pieces_equal_the_whole(spark):
    rng = np.random.default_rng(4)
    keep = rng.random(3000) < 0.5
    rows = [("a", int(i), float(np.sin(i / 30) * 50 + rng.normal())) for i in np.flatnonzero(keep)]
    df = spark.createDataFrame(rows, "s string, idx long, v double")
    got = I.spline_points(df, ["s"], "idx", "v", 6, knots=100).orderBy("idx").toPandas()
    pos, val = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    inside = [i for a, b in zip(pos[:-1], pos[1:], strict=True) if 1 < b - a <= 7 for i in range(int(a) + 1, int(b))]
    assert list(got["idx"]) == inside
    assert np.allclose(got["v"], dense_spline(pos, val, inside), atol=1e-8)


def fill(spark, df, limit, **more):
    filled, missing = I.fill_gaps(df, SCHEMA, LO, HI, 900, limit, **more)
    return filled.orderBy("station", "ts").toPandas(), missing.toPandas()


def test_limits_edges_and_codes(spark):
    values = [None, 1.0, 2.0, None, None, 4.0, None, None, None, 6.0, 7.26, None] + [None] * 84
    got, missing = fill(spark, grid_values(spark, values).withColumn("level_Status", F.lit("1").cast("bigint")), 2)
    assert len(got) == 96
    level = got["level"]
    assert np.isnan(level[0]) and np.isnan(level[6:9]).all() and np.isnan(level[11:]).all()
    expected = dense_spline(np.array([1.0, 2, 5, 9, 10]), np.array([1.0, 2, 4, 6, 7.26]), [3, 4])
    assert list(level[3:5]) == list(np.round(expected, 1))
    assert level[10] == 7.3
    assert list(got["level_Status"][:12]) == [4, 1, 1, 4, 4, 1, 4, 4, 4, 1, 1, 4]
    rates = missing.set_index("period")["missing_percentage"]
    assert rates["before"] == pytest.approx(100 * 91 / 96) and rates["after"] == pytest.approx(100 * 89 / 96)


def test_three_points_are_left_alone(spark):
    got, _ = fill(spark, grid_values(spark, [1.234, None, 2.0, 3.0]), 5)
    assert list(got["level"][:4].fillna(-1)) == [1.234, -1, 2.0, 3.0]


def test_negative_values_and_codes(spark):
    df = grid_values(spark, [5.0, -3.0, 4.0, 6.0, 7.0]).withColumn("level_Status", F.lit(1).cast("bigint"))
    got, _ = fill(spark, df, 2)
    assert np.isnan(got["level"][1]) and got["level_Status"][1] == 4
    got, _ = fill(spark, df, 2, keep_code=True)
    assert np.isnan(got["level"][1]) and got["level_Status"][1] == 2
    warm, _ = fill(spark, grid_values(spark, [5.0, -3.0, 4.0, 6.0], column="Temperatura_Interna").withColumn("level", F.lit(1.0)), 2)
    assert warm["Temperatura_Interna"][1] == -3.0


def test_values_stay_within_half_the_range(spark):
    values = [0.0, 100.0, None, None, None, None, None, None, None, None, 100.0, 0.0, 50.0]
    got, _ = fill(spark, grid_values(spark, values), 20)
    assert got["level"][:13].max() <= 150.0 and got["level"][:13].min() >= 0.0
    assert got["level"][5] == 150.0


def test_off_grid_duplicates_and_metadata(spark):
    df = grid_values(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    late = df.withColumn("ts", F.expr("ts + interval 7 minutes")).withColumn("level", F.lit(999.0))
    meta = spark.createDataFrame([("a", 12.5)], "station string, Altitude double")
    got, _ = fill(spark, df.unionByName(late).unionByName(df), 2, meta=meta)
    assert len(got) == 96 and got["level"].max() == 5.0
    assert set(got["Altitude"]) == {12.5}


def test_kept_duplicates_shift_the_knots(spark):
    df = grid_values(spark, [1.0, 2.0, None, 4.0, 9.0, 7.0])
    twin = df.filter("level = 2.0").withColumn("level", F.lit(2.5))
    got, _ = fill(spark, df.unionByName(twin), 2, dedupe=False)
    assert len(got) == 97
    want = dense_spline(np.array([0.0, 1, 2, 4, 5, 6]), np.array([1.0, 2, 2.5, 4, 9, 7]), [3])
    assert list(got["level"][got["ts"] == pd.Timestamp("2024-01-01 00:30:00")]) == list(np.round(want, 1))


def test_long_series_and_short_ones(spark):
    rows = [("a", i, None if i in (3, 4, 9) else float(i * i)) for i in range(15)] + [("b", i, None if i == 1 else 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "s string, idx long, v double").withColumn("c", F.lit(0).cast("bigint"))
    got = I.impute_long(df, ["s"], "idx", "v", F.lit(False), max_gap=1, status="c").orderBy("s", "idx").toPandas()
    a, b = got[got.s == "a"].reset_index(), got[got.s == "b"].reset_index()
    assert np.isnan(a["v"][[3, 4]]).all() and abs(a["v"][9] - 81) < 0.5 and list(np.flatnonzero(a["c"] == 4)) == [9]
    assert np.isnan(b["v"][1]) and (b["c"] == 0).all()


def test_wide_columns_per_split(spark):
    n = 60
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({
        "Data_Hora_Medicao": pd.date_range("2024-01-01", periods=n, freq="h"),
        "Cota_Adotada_1": rng.normal(50, 10, n), "Temperatura_Interna_1": rng.normal(0, 5, n), "Vazao_Adotada_1": np.nan,
        "Cota_Adotada_Status_1": 0, "Altitude_1": np.nan, "split": ["train"] * 40 + ["test"] * 20,
    })
    pdf.loc[[5, 6, 39, 40, 45], "Cota_Adotada_1"] = np.nan
    pdf.loc[10:20, "Temperatura_Interna_1"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    df = df.withColumn("Data_Hora_Medicao", F.col("Data_Hora_Medicao").cast("timestamp_ntz"))
    got = I.impute_wide(df, "Data_Hora_Medicao", split="split", max_gap=3).orderBy("Data_Hora_Medicao").toPandas()
    train = pdf.iloc[:40]["Cota_Adotada_1"]
    seen = np.flatnonzero(train.notna())
    assert list(got["Cota_Adotada_1"][[5, 6]]) == list(np.round(dense_spline(seen.astype(float), train.dropna().to_numpy(), [5, 6]), 3))
    assert np.isnan(got["Cota_Adotada_1"][39]) and np.isnan(got["Cota_Adotada_1"][40]) and not np.isnan(got["Cota_Adotada_1"][45])
    assert got["Temperatura_Interna_1"][10:21].isna().all() and got["Vazao_Adotada_1"].isna().all() and got["Altitude_1"].isna().all()
    assert list(np.flatnonzero(got["Cota_Adotada_Status_1"] == 4)) == [5, 6, 45]
    kept = pdf["Cota_Adotada_1"].notna()
    assert (got["Cota_Adotada_1"][kept] == pdf["Cota_Adotada_1"][kept].round(3)).all()
