import pandas as pd
import pytest

from gaugeline.operators import reports, reshape as R
from gaugeline.operators.clean import merge_aliases, off_grid, rejects, rename_key
from pyspark.sql import functions as F


def test_pivot_golden(spark):
    rows = [(1, "a", None), (1, "a", 5.0), (1, "b", 7.0), (2, "a", None), (2, "b", None), (3, "a", 1.0), (3, "b", None), (3, "gone", None)]
    df = spark.createDataFrame(rows, "ts int, name string, value double")
    got = R.pivot_wide(df, "ts", "name", "value")
    assert got.columns == ["ts", "a", "b"]
    assert sorted(map(tuple, got.collect())) == [(1, 5.0, 7.0), (3, 1.0, None)]
    assert R.all_null_series(df, ["name"], "value").collect() == [("gone",)]
    assert R.drop_all_null(df, ["name"], "value").count() == 7


def test_pivot_takes_the_first_duplicate(spark):
    df = spark.createDataFrame([(1, "a", 9.0, 1), (1, "a", 2.0, 2)], "ts int, name string, value double, o int")
    assert R.pivot_wide(df, "ts", "name", "value", order="o").first()["a"] == 9.0


def test_any_number_of_columns(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("name"))
    assert R.names_of(df, "name") == sorted(map(str, range(30)))


def test_single_horizon_has_no_suffix(spark):
    rows = [("A", 24, "2024-01-01", 1.0, 2.0), ("A", 24, "2024-01-01", 1.0, 4.0), ("B", 24, "2024-01-02", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "model_name string, step int, date string, y_true double, y_pred double")
    got = R.predictions_wide(df, ["A", "B"], [24])
    assert sorted(map(tuple, got.select("date", "A", "B", "y_true").collect())) == [("2024-01-01", 3.0, None, 1.0), ("2024-01-02", None, 5.0, 3.0)]
    assert R.horizon_view(got, 24).columns == got.columns
    with pytest.raises(ValueError):
        R.horizon_view(got.drop("y_true"), 24)


def test_model_label(spark):
    df = spark.createDataFrame([("A", 1.239), ("B", None)], "model string, rmse double")
    assert [r[0] for r in df.select(R.model_label()).collect()] == ["A (RMSE: 1.24 cm)", "B"]


def test_alias_ranges(spark):
    df = spark.createDataFrame([("x", "2024-01-01"), ("x", "2024-02-01"), ("y", "2024-01-01"), (None, "2024-01-01")], "codigoestacao string, t string")
    df = df.select("codigoestacao", F.col("t").cast("timestamp_ntz").alias("Data_Hora_Medicao"))
    assert sorted(r[0] or "" for r in merge_aliases(df, {"x": "y"}).collect()) == ["", "y", "y", "y"]
    limited = merge_aliases(df.filter("codigoestacao is not null"), {"x": "y"}, valid={"x": ("2024-01-15", "2024-03-01")})
    assert limited.count() == 2


def test_small_helpers(spark):
    assert rename_key(spark.createDataFrame([("1",)], "CodigoEstacao string")).columns == ["codigoestacao"]
    df = spark.createDataFrame([("1,5", "x"), ("y", None)], "a string, b string")
    assert {r["column"]: r["rejected"] for r in rejects(df, ["a", "b"]).collect()} == {"a": 1, "b": 1}
    t = spark.createDataFrame([("a", "2024-01-01 00:15:00"), ("a", "2024-01-01 00:15:00"), ("a", "2024-01-01 00:16:00")], "s string, t string")
    row = off_grid(t.withColumn("t", F.col("t").cast("timestamp_ntz")), "s", "t", 900).first()
    assert (row["readings"], row["off_grid"], row["duplicated"]) == (3, 1, 2)


def test_histogram_of_equal_values(spark):
    got = reports.histogram(spark.createDataFrame([("a", 2.0)] * 5, "s string, v double"), ["s"], "v").collect()
    assert got == [("a", 1, 5)]


def test_histogram_without_groups(spark):
    got = reports.histogram(spark.range(101).select(F.col("id").cast("double").alias("v")), [], "v", 4).orderBy("bin").collect()
    assert [tuple(r) for r in got] == [(1, 25), (2, 25), (3, 25), (4, 26)]


def test_correlation_of_sparse_columns(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4], "b": [2.0, 1, 4, 3], "k": [5.0] * 4})
    got = {(r["a"], r["b"]): r["r"] for r in reports.correlation_matrix(spark.createDataFrame(pdf), ["a", "b", "k"]).collect()}
    assert got["a", "b"] == pytest.approx(pdf.corr().loc["a", "b"]) and got["b", "a"] == got["a", "b"]
    assert got["a", "a"] == pytest.approx(1.0) and got["a", "k"] is None and len(got) == 9


def test_missing_keys_are_duplicates_too(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert R.duplicate_rows(df, ["k"]).count() == 2
