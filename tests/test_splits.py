from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.operators import splits as P

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def hours(spark, n):
    return spark.range(n).select(F.timestamp_micros(F.col("id") * 3_600_000_000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("row"))


@QUICK
@given(n=st.integers(60, 160), folds=st.integers(1, 4), block=st.integers(2, 10), embargo=st.integers(0, 3))
def test_walk_forward_roles(spark, n, folds, block, embargo):
    got = P.walk_forward(hours(spark, n), "ts", folds, block, embargo).toPandas()
    for k in range(1, folds + 1):
        part = got[got.fold == k]
        end = n - (folds - k) * block
        roles = {r: sorted(part.loc[part.role == r, "row"]) for r in ("train", "val", "test")}
        assert roles["test"] == list(range(end - block, end))
        assert roles["val"] == list(range(end - 2 * block, end - block))
        assert roles["train"] == list(range(0, end - 2 * block - embargo))


@QUICK
@given(n=st.integers(40, 150), splits=st.integers(2, 5), gap=st.integers(0, 5))
def test_expanding_folds(spark, n, splits, gap):
    got = P.time_series_split(hours(spark, n), "ts", splits, gap).toPandas()
    size = n // (splits + 1)
    for k in range(splits):
        part, start = got[got.fold == k + 1], n - (splits - k) * size
        assert sorted(part.loc[part.role == "test", "row"]) == list(range(start, start + size))
        assert sorted(part.loc[part.role == "train", "row"]) == list(range(max(start - gap, 0)))


def test_event_window(spark):
    got = P.event_split(hours(spark, 100), "ts", "1970-01-03", "1970-01-04", 10).toPandas()
    assert got.groupby("role")["row"].agg(["min", "max"]).loc[["train", "val", "test"]].values.tolist() == [[0, 37], [38, 47], [48, 71]]
    assert P.event_split(hours(spark, 100), "ts", "1980-01-01", "1980-01-02", 10).count() == 0


def test_tail(spark):
    assert sorted(r["row"] for r in P.tail(hours(spark, 50), "ts", 3).collect()) == [47, 48, 49]
    assert P.tail(hours(spark, 2), "ts", 3).count() == 2
