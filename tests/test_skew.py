"""One key holding a third of all rows: results stay whole and exact."""
import numpy as np
from pyspark.sql import functions as F

from parcelrisk.operators import clean, evaluate, features, match, profile
from parcelrisk.operators.ranking import exact_quantiles, row_numbers


def skewed(spark, n=30000):
    # a third of the rows share key 0; the rest spread over 1000 keys
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
        ((F.col("id") * 7919) % 1013 / 1013.0).alias("x"))


def test_membership_with_hot_key(spark):
    df = skewed(spark)
    keys = spark.range(0, 1001, 2).select(F.col("id").alias("k"))       # even keys, 0 included
    out = match.flag_membership(df, keys, "k", normalise=None, out="hit")
    rows = out.groupBy("hit").count().collect()
    got = {r.hit: r["count"] for r in rows}
    k = np.where(np.arange(30000) % 3 == 0, 0, np.arange(30000) % 1000 + 1)
    assert got[1] == int((k % 2 == 0).sum()) and sum(got.values()) == 30000


def test_quantiles_and_curve_with_hot_group(spark):
    df = skewed(spark).withColumn("g", (F.col("k") == 0).cast("int"))
    pdf = df.select("g", "x").toPandas()
    got = {r.g: r for r in exact_quantiles(df, "x", [0.1, 0.5, 0.9], ["g"]).collect()}
    for g in (0, 1):
        want = np.quantile(pdf.x[pdf.g == g], [0.1, 0.5, 0.9])
        assert np.allclose([got[g].q10, got[g].q50, got[g].q90], want, atol=1e-12)
    auc = evaluate.auc(df, "x", "g").first().auc
    assert abs(auc - evaluate.auc_roc(df, "x", "g")) < 1e-9
    h = profile.histogram(df, "x", 10, by=["g"]).groupBy("g").agg(F.sum("count").alias("n")).collect()
    assert sorted(r.n for r in h) == sorted(pdf.g.value_counts().tolist())


def test_row_numbers_with_hot_ties_match_a_full_sort(spark):
    df = skewed(spark, 20000).repartition(5)
    got = row_numbers(df, [F.col("k").desc(), F.col("id").asc()], "pos") \
        .select("id", "pos").toPandas().sort_values("pos")
    pdf = df.select("id", "k").toPandas().sort_values(["k", "id"], ascending=[False, True])
    assert got.pos.tolist() == list(range(20000))
    assert got.id.tolist() == pdf.id.tolist()


def test_one_hot_levels_with_a_hot_count(spark):
    # 3000 levels seen once (one tied count) and a few frequent ones
    rare = spark.range(3000).select(F.format_string("r%05d", "id").alias("c"))
    hot = spark.range(900).select(F.format_string("h%d", F.col("id") % 3).alias("c"))
    lv = features.one_hot_levels(rare.unionByName(hot), "c").toPandas()
    want = sorted([(-300, f"h{i}") for i in range(3)] + [(-1, f"r{i:05d}") for i in range(3000)])
    assert lv.sort_values("level_index").level.tolist() == [w[1] for w in want]
    assert sorted(lv.level_index) == list(range(3003))
    assert lv.loc[lv.all_zero == 1, "level"].tolist() == ["r02999"]


def test_row_at_far_from_the_head(spark):
    df = skewed(spark, 5000).repartition(4)
    far = clean.row_at(df, ["k", "id"], 4321).first()
    pdf = df.toPandas().sort_values(["k", "id"]).reset_index(drop=True)
    assert far.id == pdf.id[4321]
    assert clean.row_at(df, ["k", "id"], 5000).count() == 0


def test_prefix_sums_over_skewed_groups_are_exact(spark):
    from parcelrisk.operators.ranking import prefix_sums
    df = skewed(spark, 12000).groupBy("k", "x").agg(F.count(F.lit(1)).alias("w"))
    out = prefix_sums(df, "x", ["w"], ["k"], descending=True,
                      next_of=["w"]).toPandas()
    pdf = df.toPandas().sort_values(["k", "x"], ascending=[True, False])
    pdf["cum"] = pdf.groupby("k").w.cumsum()
    m = out.merge(pdf, on=["k", "x"])
    assert len(m) == len(pdf) == len(out)
    assert (m._cum_w == m.cum).all()
    after = m.sort_values(["k", "x"], ascending=[True, False]).groupby("k").w_x.shift(-1)
    assert (m._next_w.fillna(-1) == after.reindex(m.index).fillna(-1)).all()
    assert (m._tot_w == m.groupby("k").w_x.transform("sum")).all()
