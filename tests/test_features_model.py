from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parcelrisk.operators import features as feat
from parcelrisk.operators import folds, model
from parcelrisk.operators.schema import ColumnRoles


def test_string_index_order_and_drop_last(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "c")], "k int, c string")
    lv = {r.level: (r.level_index, r.all_zero) for r in feat.one_hot_levels(df, "c").collect()}
    assert lv == {"c": (0, 0), "a": (1, 0), "b": (2, 1)}
    roles = ColumnRoles(key="k", categorical=("c",))
    out, _ = feat.build_features(df, roles, handle_invalid="error")
    vecs = {r.k: r.v for r in out.select("k", vector_to_array("features").alias("v")).collect()}
    assert vecs[1] == [0.0, 0.0]          # 'b' is the dropped, all-zero level
    assert vecs[3] == [1.0, 0.0] and vecs[2] == [0.0, 1.0]


def test_scaler_constant_column_is_zero(spark):
    df = spark.createDataFrame([(i, 5.0, float(i)) for i in range(4)], "k int, c double, x double")
    out, _ = feat.build_features(df, ColumnRoles(key="k", numeric=("c", "x")))
    rows = out.select(vector_to_array("features").alias("v")).collect()
    assert all(r.v[0] == 0.0 for r in rows)


def test_folds_are_stable_and_balanced(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    a = folds.assign_folds(df, "key", 10, seed=1)
    b = folds.assign_folds(df.repartition(7), "key", 10, seed=1)
    assert a.exceptAll(b).count() == 0
    counts = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(counts) == 10 and min(counts) > 400


def test_oof_scores_every_row_once(spark):
    n, k = 400, 4
    df = spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") % 3).cast("double").alias("x"),
        ((F.col("id") % 3) == 0).cast("int").alias("y"))
    roles = ColumnRoles(key="key", numeric=("x",), label="y")
    data, _ = feat.build_features(df, roles)
    data = folds.assign_folds(data, "key", k)
    out = model.oof_score(data, "features", "y", "fold", k, keep=["key"], parallelism=2)
    rows = out.collect()
    assert len(rows) == n and len({r.key for r in rows}) == n
    assert all(0.0 <= r.prob1 <= 1.0 and abs(r.prob0 + r.prob1 - 1) < 1e-9 for r in rows)


def test_rarest_level_is_all_zero_as_reported(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c"), (7, None),
                                (8, None), (9, None), (10, None)], "k int, c string")
    out, _ = feat.build_features(df, ColumnRoles(key="k", categorical=("c",)))
    got = {r.k: list(r.v) for r in out.select("k", vector_to_array("features").alias("v")).collect()}
    assert got[6] == [0, 0, 0] and got[7] == [1, 0, 0] and got[1] == [0, 1, 0] and got[4] == [0, 0, 1]
    levels = {r.level: r.all_zero for r in feat.one_hot_levels(
        df.fillna(feat.NULL_LEVEL, ["c"]), "c").collect()}
    assert levels == {"NaN": 0, "a": 0, "b": 0, "c": 1}


def _toy(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("key"), (F.col("id") % 6).alias("period"),
        ((F.col("id") * 37) % 101 / 101.0).alias("x"),
        (((F.col("id") * 37) % 101) > 40).cast("int").alias("y"))


def _flip(df, cond):
    return df.withColumn("y", F.when(cond, 1 - F.col("y")).otherwise(F.col("y")))


def _scores(out, key="key"):
    return {r[key]: round(r.prob1, 12) for r in out.collect()}


def test_holdout_scores_test_rows_only_and_never_sees_their_labels(spark):
    roles = ColumnRoles(key="key", numeric=("x",), label="y")

    def run(df):
        data, _ = feat.build_features(df, roles)
        return model.holdout_score(folds.hash_split(data, "key", 0.7, seed=5), "features", "y",
                                   "is_train", keep=["key"])
    base = _toy(spark)
    split = {r.key: r.is_train for r in folds.hash_split(base, "key", 0.7, seed=5).collect()}
    a = _scores(run(base))
    assert set(a) == {k for k, t in split.items() if t == 0}
    b = _scores(run(_flip(base, ~F.col("key").isin([k for k, t in split.items() if t == 1]))))
    assert a == b


def test_walk_forward_uses_only_earlier_periods(spark):
    roles = ColumnRoles(key="key", passthrough=("period",), numeric=("x",), label="y")

    def run(df):
        data, _ = feat.build_features(df, roles)
        return model.walk_forward_score(data, "features", "y", "period", [2, 3, 4, 5],
                                        keep=["key"], parallelism=2)
    base = _toy(spark)
    a = run(base)
    assert a.count() == base.where("period >= 2").count()
    # labels of period 4 and later cannot move the scores of periods 2-4
    b = run(_flip(base, F.col("period") >= 4))
    early = lambda out: _scores(out.where("period <= 4"))
    assert early(a) == early(b)


def test_oof_never_sees_the_labels_of_the_scored_fold(spark):
    roles = ColumnRoles(key="key", numeric=("x",), label="y")

    def run(df):
        data, _ = feat.build_features(df, roles)
        data = folds.assign_folds(data, "key", 3, seed=9)
        return model.oof_score(data, "features", "y", "fold", 3, keep=["key"], parallelism=3)
    base = _toy(spark, 450)
    fold0 = [r.key for r in folds.assign_folds(base, "key", 3, seed=9).where("fold = 0").collect()]
    a = run(base)
    b = run(_flip(base, F.col("key").isin(fold0)))
    pick = lambda out: _scores(out.where("fold = 0"))
    assert pick(a) == pick(b) and len(pick(a)) == len(fold0)


def test_spread_for_fitting_spreads_only_few_partitions(spark):
    dp = spark.sparkContext.defaultParallelism
    one = feat.spread_for_fitting(spark.range(0, 1000, numPartitions=1))
    assert one.rdd.getNumPartitions() == dp and one.count() == 1000
    many = feat.spread_for_fitting(spark.range(0, 1000, numPartitions=dp + 3))
    assert many.rdd.getNumPartitions() == dp + 3
