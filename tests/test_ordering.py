import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frondlake.operators.ordering import exact_percentiles, rank_by_digest, shuffle_key


def _percentiles(values, p):
    return float(np.percentile(np.array(values, dtype=float), p * 100))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-5000, 5000)), min_size=1, max_size=60))
def test_percentiles_match_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: r for r in exact_percentiles(
        df, ["g"], {"v": F.col("v")}, {"p10": 0.1, "median": 0.5, "p90": 0.9}, few=5).collect()}
    groups = {g: [v for h, v in rows if h == g] for g in {g for g, _ in rows}}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9)):
            assert got[g][f"v_{name}"] == pytest.approx(_percentiles(values, p))


def test_percentiles_of_small_and_empty_inputs(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (None,)], "v int")
    row = exact_percentiles(df, [], {"v": F.col("v")}, {"p10": 0.1, "top": 1.0}).first()
    assert row["v_p10"] == pytest.approx(1.2) and row["v_top"] == 10
    none = exact_percentiles(df.where("v > 99"), [], {"v": F.col("v")}, {"p": 0.5}).collect()
    assert [r["v_p"] for r in none] == [None]
    assert exact_percentiles(df.where("v = 2"), [], {"v": F.col("v")}, {"p": 0.9}).first()["v_p"] == 2


@pytest.mark.parametrize("few", [1, 50, 1 << 14])
def test_percentiles_of_skewed_values(spark, few):
    """A value that fills a third of a group, outliers, infinities and a dense cluster: several passes are needed."""
    rng = np.random.default_rng(4)
    values = np.concatenate([np.full(700, 3.0), rng.normal(0, 1e-6, 600), rng.normal(0, 1e9, 600), [1e300, -1e300, np.inf, -np.inf],
                             rng.integers(0, 50, 100)])
    df = spark.createDataFrame([(float(v), float(v % 7) if np.isfinite(v) else float("nan")) for v in values], "v double, w double").repartition(5)
    names = {f"p{i}": i / 20 for i in range(1, 20)}
    row = exact_percentiles(df, [], {"v": F.col("v"), "w": F.col("w")}, names, few=few).first()
    other = np.array([v % 7 for v in values if np.isfinite(v)])
    for name, p in names.items():
        assert row[f"v_{name}"] == pytest.approx(_percentiles(values, p), rel=1e-9, abs=1e-15)
        assert row[f"w_{name}"] == pytest.approx(_percentiles(other, p), rel=1e-9, abs=1e-15)


def test_percentiles_of_many_distinct_values(spark):
    df = spark.range(200_000).selectExpr("id % 2 AS g", "cast(xxhash64(id) AS double) AS v")
    found = exact_percentiles(df, ["g"], {"v": F.col("v")}, {"median": 0.5}, few=1000)
    got = {r["g"]: r["v_median"] for r in found.collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got == want


def test_rank_is_the_global_order(spark):
    df = spark.range(500).withColumn("d", shuffle_key(F.col("id"), 7))
    ranked = rank_by_digest(df, "d", digits=1).orderBy("d").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 501))
    again = rank_by_digest(df.repartition(3), "d", digits=3).orderBy("d").collect()
    assert [r["id"] for r in ranked] == [r["id"] for r in again]
