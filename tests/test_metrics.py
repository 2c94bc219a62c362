import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import metrics as M

SEEDED = np.random.RandomState(42)
T3 = SEEDED.randn(20) * 10 + 50
CASES = {
    "perfect": ([10.0, 20, 30, 40, 50], [10.0, 20, 30, 40, 50], (1.0, 1.0, 1.0, 0.0, 0.0)),
    "small": ([10.0, 20, 30, 40, 50], [12.0, 18, 32, 38, 52], (0.983229, 0.981062, 0.980392, 2.0, 2.0)),
    "seeded": (T3, T3 + SEEDED.randn(20) * 2, (0.976719, 0.974059, 0.957944, 1.960599, 1.552019)),
    "scale": ([100.0, 200, 300, 400, 500], [100.0, 200, 300, 750, 750], (0.433163, -0.038708, 0.350877, 192.353841, 120.0)),
}


@pytest.mark.parametrize("case", CASES)
def test_golden_scores(spark, case):
    truth, pred, expected = CASES[case]
    df = spark.createDataFrame(pd.DataFrame({"t": truth, "p": pred}))
    row = df.agg(M.kge("t", "p", "cv"), M.kge("t", "p", "sd"), M.nnse("t", "p"), M.rmse("t", "p"), M.mae("t", "p")).first()
    assert list(row) == pytest.approx(list(expected), abs=1e-6)


def test_constant_sides_are_undefined_not_errors(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "t double, p double")
    row = df.agg(M.pearson("t", "p").alias("r"), M.kge("t", "p").alias("k"), M.kge("t", "p", undefined=0.0).alias("k0"), M.nse("p", "t").alias("n")).first()
    assert (row["r"], row["k"], row["k0"], row["n"]) == (None, None, 0.0, None)


def test_only_complete_pairs_count(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 100.0), (3.0, None), (5.0, 5.0)], "t double, p double")
    row = df.agg(M.rmse("t", "p").alias("rmse"), M.r2("t", "p").alias("r2")).first()
    assert row["rmse"] == pytest.approx(np.sqrt(0.5))
    assert row["r2"] == pytest.approx(1 - 1 / 8)


def test_unknown_variant(spark):
    with pytest.raises(ValueError):
        M.kge(F.lit(1.0), F.lit(1.0), "other")
