import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelrisk.operators import clean, profile, reshape
from parcelrisk.operators.ranking import exact_quantiles, prefix_sums


def test_value_counts_and_distinct_count(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "v string")
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    d = spark.createDataFrame([("a",), (None,), ("a",)], "v string")
    assert profile.distinct_count(d, "v").first()[0] == 2


def test_top_k_puts_nan_and_null_last(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 2.0)], "k int, x double")
    assert [r.x for r in clean.top_k(df, "x", 2, ["k"]).collect()] == [2.0, 1.0]


def test_describe_matches_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    r = profile.describe_by(df, "x").first()
    assert r.n == 4 and r.mean == 4 and abs(r.std - 3.559026) < 1e-6
    assert (r.min, r.q25, r.q50, r.q75, r.max) == (1.0, 1.75, 3.0, 5.25, 9.0)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in range(6)], "x double")
    h = profile.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 1, 1, 2]
    dens = profile.histogram(df, "x", 5, density=True).orderBy("bin").collect()
    assert abs(sum(r.density * (r.bin_hi - r.bin_lo) for r in dens) - 1) < 1e-12


def test_box_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "x double")
    r = profile.box_stats(df, "x").first()
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers) == (2, 3, 4, 1, 4, 1)


def test_pivot_mean_and_sum(spark):
    df = spark.createDataFrame([("k1", 2018, 1.0), ("k1", 2018, 3.0), ("k1", 2019, 5.0),
                                ("k2", 2019, 7.0)], "k string, y int, v double")
    mean = {r.k: (r["2018"], r["2019"]) for r in reshape.pivot_by(df, "k", "y", "v", "mean", [2018, 2019]).collect()}
    total = {r.k: (r["2018"], r["2019"]) for r in reshape.pivot_by(df, "k", "y", "v", "sum", [2018, 2019]).collect()}
    assert mean == {"k1": (2.0, 5.0), "k2": (None, 7.0)}
    assert total == {"k1": (4.0, 5.0), "k2": (None, 7.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy_with_groups_and_ties(spark, seed):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, 3000)
    x = np.round(rng.gamma(2.0, 3.0, 3000), 1)   # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
    for k in range(3):
        want = np.quantile(x[g == k], probs)
        have = [got[k][f"q{int(round(p * 100))}"] for p in probs]
        assert np.allclose(have, want, rtol=0, atol=1e-9)


def test_prefix_sums_equal_a_global_running_sum(spark):
    rng = np.random.default_rng(5)
    vals = rng.permutation(2000).astype(float)
    w = rng.integers(0, 5, 2000)
    df = spark.createDataFrame([(float(v), int(c)) for v, c in zip(vals, w)], "v double, w long")
    out = prefix_sums(df, "v", ["w"], descending=True).orderBy("v").collect()
    order = np.argsort(-vals)
    cum = dict(zip(vals[order], np.cumsum(w[order])))
    assert all(r._cum_w == cum[r.v] and r._tot_w == w.sum() for r in out)
    assert not math.isnan(out[0].v)


def test_prefix_sums_use_many_ranges(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("w"))
    out = prefix_sums(df, "v", ["w"])
    assert all(r._cum_w == int(r.v) + 1 for r in out.collect())


def test_null_groups_nan_and_empty(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("a", None), (None, 5.0), (None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    d = {r.g: r for r in profile.describe_by(df, "x", ["g"]).collect()}
    assert (d["a"].n, d["a"].mean, d["a"].std, d["a"].q50) == (1, 1.0, None, 1.0)
    assert (d[None].n, d[None].q50, d[None].max) == (2, 6.0, 7.0)
    assert (d["b"].n, d["b"].mean, d["b"].q50) == (0, None, None)
    assert {r.g for r in profile.box_stats(df, "x", ["g"]).collect()} == {"a", "b", None}
    empty = df.limit(0)
    assert profile.describe_by(empty, "x").first().n == 0
    assert profile.distinct_count(empty, "x").first()[0] == 0
    assert [r["count"] for r in profile.histogram(empty, "x", 3).collect()] == [0, 0, 0]
    assert profile.distinct_count(df, "x").first()[0] == 4
