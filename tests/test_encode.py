import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline import schema as S
from gaugeline.operators import encode as E


def test_numeric_fit_equals_arrays(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y"], 200), "a": rng.normal(5, 2, 200), "k": 3.0})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).withColumn("none", F.lit(None).cast("double"))
    fitted = E.fit_numeric(df, ["a", "k", "none"], ["g"])
    got = E.apply_numeric(df, fitted, ["a", "k", "none"], ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        full = part["a"].fillna(part["a"].median())
        want = (full - full.mean()) / full.std(ddof=0)
        assert np.allclose(np.sort(got.loc[got.g == g, "a"]), np.sort(want))
    assert set(got["k"]) == {0.0} and got["none"].isna().all()


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([(1,), (None,), (3,)], "c_Status bigint")
    seen = E.categories(train, "c_Status")
    assert seen == [0, 1, 3]
    got = E.one_hot(spark.createDataFrame([(1,), (2,), (None,)], "c_Status bigint"), {"c_Status": seen}).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    assert E.categories(spark.range(1500), "id") == list(range(1500))  # as many as there are


def test_roles():
    names = ["Data_Hora_Medicao", "Cota_Adotada_1", "Cota_Adotada_Status_1", "Altitude_1", "Rio_Codigo_1", "lag_6_Cota_Adotada_1", "y"]
    assert S.numeric_columns(names, "y") == ["Cota_Adotada_1", "lag_6_Cota_Adotada_1"]
    assert S.categorical_columns(names, "y") == ["Cota_Adotada_Status_1", "Rio_Codigo_1"]
    assert S.imputable_columns(names) == ["Cota_Adotada_1", "lag_6_Cota_Adotada_1", "y"]


def test_feature_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 2, 3.0, 4.0, "x", 5.0, 1.0)],
        "Cota_Adotada_1 double, Cota_Adotada_Status_1 long, lag_6_Cota_Adotada_1 double, Altitude_1 double, name string, Chuva_Adotada_1 double, date double",
    )
    assert S.feature_columns(df.schema) == ["Cota_Adotada_1", "Chuva_Adotada_1"]


def test_calendar_needs_the_timestamp(spark):
    with pytest.raises(ValueError):
        E.calendar_features(spark.range(1), "ts")


def test_routing_passes_the_rest_through(spark):
    df = spark.createDataFrame([(1.0, 0, 9.0, "a"), (3.0, 2, 8.0, None)], "Cota_1 double, Cota_Status_1 long, Altitude_1 double, Rio_Codigo_1 string")
    got = E.encode(df, df, None).orderBy("Altitude_1").collect()
    assert set(got[0].asDict()) == {"Cota_1", "Cota_Status_1_0", "Cota_Status_1_2", "Altitude_1", "Rio_Codigo_1_a", "Rio_Codigo_1_missing_value"}
    assert (got[0]["Cota_1"], got[0]["Altitude_1"], got[0]["Rio_Codigo_1_missing_value"], got[1]["Cota_1"]) == (1.0, 8.0, 1.0, -1.0)


def test_rows_of_a_large_group_are_scaled_where_they_are(spark):
    """Few groups: no shuffle brings all rows of a group to one task."""
    df = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") > 0, "x").alias("g"), F.col("id").cast("double").alias("a"))
    got = E.apply_numeric(df, E.fit_numeric(df, ["a"], ["g"]), ["a"], ["g"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    rows = [r["a"] for r in got.where("g = 'x'").collect()]
    assert got.count() == 1000 and abs(sum(rows)) < 1e-6 and got.where("g is null").first()["a"] == 0.0


def test_many_groups_are_joined(spark, monkeypatch):
    from gaugeline.operators import chunks

    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0), ("y", None)], "g string, a double")
    fitted = E.fit_numeric(df, ["a"], ["g"])
    few = E.apply_numeric(df, fitted, ["a"], ["g"]).collect()
    monkeypatch.setattr(chunks, "FEW_GROUPS", 1)
    many = E.apply_numeric(df, fitted, ["a"], ["g"]).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(many) == 4
