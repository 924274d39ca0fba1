import datetime as dt
import os
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parcelrisk.operators import features as feat
from parcelrisk.operators import model_store, sketches
from parcelrisk.operators.schema import ColumnRoles
from parcelrisk.session import scratch_dir
from parcelrisk.sources.archives import read_zip_members
from parcelrisk.sources.readers import read_zipped_delimited
from parcelrisk.sources.rejects import read_with_rejects
from parcelrisk.sources.sinks import write_partitions, write_zipped_delimited

AWKWARD = [(1, 'a,"b"', None), (2, "two\nlines", "é"), (3, "", "x"), (4, " pad ", "ß")]


# ------------------------------------------------------------- archives

def test_members_are_read_one_task_each(spark):
    path = scratch_dir(spark, "members-test")
    rows = spark.createDataFrame(AWKWARD * 25, "k int, s string, t string").coalesce(2)
    wrote = write_zipped_delimited(rows, path, encoding="ISO-8859-1", member_rows=30).collect()
    assert sum(r["rows"] for r in wrote) == 100
    schema = "t string, k int, s string"                                # another order
    got = read_zip_members(spark, path, schema, encoding="ISO-8859-1")
    n_members = sum(-(-r["rows"] // 30) for r in wrote)
    assert n_members >= 4 and got.rdd.getNumPartitions() == n_members
    whole = read_zipped_delimited(spark, path, schema, encoding="ISO-8859-1")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert {r["s"] for r in got.collect()} == {'a,"b"', "two\nlines", None, " pad "}


def test_member_errors_and_empty_folder(spark):
    path = scratch_dir(spark, "members-test")
    write_zipped_delimited(spark.range(3), path).collect()
    with pytest.raises(Exception, match="columns not in the file"):
        read_zip_members(spark, path, "other long").collect()
    assert read_zip_members(spark, path, "id long", member="*.txt").count() == 0
    with pytest.raises(Exception, match="gone"):
        read_zip_members(spark, path + "/gone", "id long").collect()


def test_overwriting_archives_publishes_when_all_are_there(spark):
    path = scratch_dir(spark, "members-test").replace("file:", "")
    write_zipped_delimited(spark.range(50).repartition(3), path).collect()
    bad = spark.range(10).withColumn("id", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception):
        write_zipped_delimited(bad, path, mode="overwrite")
    assert read_zipped_delimited(spark, path, "id long", glob="part-*.zip").count() >= 50
    new = write_zipped_delimited(spark.range(7).coalesce(1), path, mode="overwrite")
    assert [r["rows"] for r in new.collect()] == [7]
    assert sorted(f for f in os.listdir(path) if f.endswith(".zip")) == ["part-00000.zip"]
    assert read_zip_members(spark, path, "id long").count() == 7


# ------------------------------------------------------------- rejects

def test_rejects_keep_the_line_and_the_reason(spark):
    base = scratch_dir(spark, "rejects-test").replace("file:", "")
    os.makedirs(f"{base}/in")
    with open(f"{base}/in/a.csv", "w", encoding="latin-1") as f:
        f.write('k,name,at\n1,"Müller, A",2020-01-01\nx,b,2020-01-02\n3,c\n4,d,NA\n5,,soon\n,e,2020-01-03\n\n')
    with open(f"{base}/in/b.csv", "w", encoding="latin-1") as f:
        f.write("k,name,at\n7,g,2020-02-01,more\n8,h,\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("at", T.DateType()), T.StructField("k", T.IntegerType(), False)])
    got = read_with_rejects(spark, f"{base}/in", schema, f"{base}/out", encoding="ISO-8859-1")
    assert {(r["k"], r["at"]) for r in got.rows.collect()} == {(1, dt.date(2020, 1, 1)), (4, None), (8, None)}
    assert {(os.path.basename(r["file"]), r["reason"], r["line"]) for r in got.rejects.collect()} == {
        ("a.csv", "k: not of type int", "x,b,2020-01-02"), ("a.csv", "number of columns", "3,c"),
        ("a.csv", "at: not of type date", "5,,soon"), ("a.csv", "k: no value", ",e,2020-01-03"),
        ("b.csv", "number of columns", "7,g,2020-02-01,more")}
    assert (got.n_rows, got.n_rejects) == (3, 5)
    with pytest.raises(ValueError):
        read_with_rejects(spark, f"{base}/in", "other int", f"{base}/out2")


# ------------------------------------------------------------- sketches

def test_profiles_merge_within_the_stated_errors(spark):
    rng = random.Random(4)
    rows = [(2000 + i % 3, rng.choice("abc"), rng.randrange(3000), rng.gauss(0, 1)) for i in range(9000)]
    rows += [(2003, "a", None, None), (2003, "a", None, float("nan"))]
    df = spark.createDataFrame(rows, "year int, area string, who int, v double")
    path = sketches.store_profile(sketches.sketch_profile(df, ["year", "area"], ["who"], ["v"]),
                                  scratch_dir(spark, "profile-test"))
    stored = spark.read.parquet(path)
    for by in (["year"], ["area"], []):
        got = sketches.read_profile(sketches.merge_profiles(stored, by), [0.1, 0.5])
        for r in got.collect():
            own = [x for x in rows if all(r[c] == x[0 if c == "year" else 1] for c in by)]
            exact = len({x[2] for x in own if x[2] is not None})
            assert r["n_rows"] == len(own) and abs(r["who_distinct"] - exact) <= exact * sketches.distinct_error()
            values = sorted(x[3] for x in own if x[3] is not None and x[3] == x[3])
            for p, name in ((0.1, "v_q10"), (0.5, "v_q50")):
                if not values:
                    assert r[name] is None
                else:
                    rank = sum(v <= r[name] for v in values) / len(values)
                    assert abs(rank - p) <= sketches.rank_error() + 1 / len(values)
    plan = sketches.merge_profiles(stored, ["year"])._jdf.queryExecution().executedPlan().toString()
    assert "who_hll" in plan and "who#" not in plan            # only the sketches are read


# ------------------------------------------------------------- features

ROLES = ColumnRoles(key="id", label="y", numeric=("a", "b"), categorical=("c", "d"), binary=("e",))


def _table(spark, n=300, unseen=False):
    rng = random.Random(9)
    rows = [(i, rng.gauss(0, 1), rng.uniform(0, 5), rng.choice(["x", "x", "y", "z", None]),
             rng.choice("pqrs"), rng.randrange(2)) for i in range(n)]
    rows = [(*r, int(r[1] + (r[3] == "y") + rng.gauss(0, .5) > .5)) for r in rows]
    if unseen:
        rows = [(1000 + r[0], *r[1:3], "never", *r[4:]) for r in rows]
    return spark.createDataFrame(rows, "id int, a double, b double, c string, d string, e int, y int")


def test_sparse_features_are_those_of_the_pipeline(spark):
    df = _table(spark)
    want, _ = feat.build_features(df, ROLES)
    want = {r["id"]: r["f"] for r in want.select("id", vector_to_array("features").alias("f")).collect()}
    got = feat.sparse_features(df, "id", ROLES.numeric, ROLES.categorical, ROLES.binary)
    for r in got.collect():
        v = [0.0] * r["features"]["size"]
        for i, x in zip(r["features"]["indices"], r["features"]["values"]):
            v[i] = x
        assert v == pytest.approx(want[r["id"]])
    ml = feat.as_ml_vectors(got, "features", scratch_dir(spark, "vectors-test"))
    model = LogisticRegression(featuresCol="features", labelCol="y").fit(ml.join(df.select("id", "y"), "id"))
    assert model.numFeatures == len(want[0])


def test_sparse_features_take_no_levels_to_the_driver(spark):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("many"))
    p = feat.sparse_features(df, "id", (), ("many",))
    assert p.select("features.size").first()[0] == 499
    text = p._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in text and "UDF" not in text
    assert p.count() == 500 and feat.sparse_features(df.limit(0), "id", (), ("many",)).count() == 0


# ------------------------------------------------------------- models

def test_models_are_saved_and_loaded(spark):
    df = _table(spark)
    lr = LogisticRegression(featuresCol=model_store.FEATURES, labelCol="y", regParam=0.1)
    fitted = model_store.fit_fold_models(df, ROLES, 3, seed=5, estimator=lr)
    path = model_store.save_fold_models(fitted, scratch_dir(spark, "models-test"))
    other = spark.newSession()
    loaded = model_store.load_fold_models(other, path)
    assert loaded.roles == ROLES and loaded.k == 3 and loaded.seed == 5
    a = {r["id"]: (r["fold"], r["prob1"]) for r in model_store.score_known(fitted, df).collect()}
    b = {r["id"]: (r["fold"], r["prob1"]) for r in model_store.score_known(loaded, df).collect()}
    assert a == b and len(a) == 300 and {f for f, _ in a.values()} == {0, 1, 2}
    new = model_store.score_new(loaded, _table(spark, 40, unseen=True).drop("y")).collect()
    assert len(new) == 40 and all(0 < r["prob1"] < 1 and r["spread"] >= 0 for r in new)
    with pytest.raises(Exception):
        model_store.save_fold_models(fitted, path)              # a set is not overwritten


def test_known_rows_are_scored_from_one_written_table(spark):
    # the models' scans were a union of copies of the table's whole plan
    df = _table(spark)
    joined = df.join(df.groupBy("id").count().withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i", "count")
    lr = LogisticRegression(featuresCol=model_store.FEATURES, labelCol="y", regParam=0.1)
    fitted = model_store.fit_fold_models(df, ROLES, 3, seed=5, estimator=lr)
    got = model_store.score_known(fitted, joined)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Exchange" not in plan
    want = {(r["id"], r["fold"], r["prob1"]) for r in model_store.score_known(fitted, df).collect()}
    assert {(r["id"], r["fold"], r["prob1"]) for r in got.collect()} == want and len(want) == 300


def test_two_score_tables_meet_without_their_sources(spark):
    df = _table(spark)
    joined = df.join(df.groupBy("id").count().withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i", "count")
    lr = LogisticRegression(featuresCol=model_store.FEATURES, labelCol="y", regParam=0.1)
    fitted = model_store.fit_fold_models(joined, ROLES, 3, seed=5, estimator=lr)
    a, b = (model_store.score_known(fitted, joined).select("id", F.col("prob1").alias(n)) for n in "ab")
    both = a.join(b, "id")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan
    assert both.where("a = b").count() == 300


def test_one_period_and_histogram_without_values(spark):
    from parcelrisk.operators.model import walk_forward_score
    from parcelrisk.operators.profile import histogram
    d = spark.createDataFrame([(1, 2020, 0.5, 1), (2, 2020, 0.1, 0)], "id int, year int, x double, y int")
    for table in (d, d.limit(0)):
        got = walk_forward_score(table, "x", "y", "year", keep=["id"])
        assert got.collect() == [] and got.columns == ["id", "y", "year", "prediction", "prob0", "prob1"]
    v = spark.createDataFrame([(None,)], "v double").union(spark.createDataFrame([(float("nan"),)], "v double"))
    assert [tuple(r) for r in histogram(v, "v", 2, lo=5.0).orderBy("bin").collect()] == [
        (0, 5.0, 5.5, 0), (1, 5.5, 6.0, 0)]
    some = histogram(spark.createDataFrame([(5.5,)], "v double"), "v", 2, lo=5.0, hi=None)
    assert [r["bin_lo"] for r in some.orderBy("bin").collect()] == [5.0, 5.25]
