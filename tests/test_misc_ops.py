from pyspark.sql import functions as F

from parcelrisk.operators import clean, profile, reshape, schema
from parcelrisk.session import scratch_dir
from parcelrisk.sources import list_files, read_table, synthetic_binary, write_run


def test_describe_approx_close_to_exact(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    a = profile.describe_by(df, "x", approx=True).first()
    e = profile.describe_by(df, "x").first()
    assert (e.q25, e.q50, e.q75) == (250.0, 500.0, 750.0)
    assert abs(a.q50 - 500) <= 1 and a.n == 1001


def test_null_profile_and_schema_report(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    prof = {r.column_name: (r.data_type, r.nulls, r.non_nulls) for r in profile.null_profile(df).collect()}
    assert prof == {"a": ("int", 1, 2), "b": ("string", 2, 1)}
    rep = [tuple(r) for r in schema.schema_report(df).orderBy("position").collect()]
    assert rep == [(0, "a", "int", 3), (1, "b", "string", 3)]


def test_mean_group_size_ignores_null_group(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    r = reshape.mean_group_size(df, ["k"]).first()
    assert (r.n_rows, r.n_groups, r.mean_group_size) == (4, 2, 2.0)


def test_sort_nulls_last_and_row_at(spark):
    df = spark.createDataFrame([(1, 3.0), (2, float("nan")), (3, None), (4, 1.0)], "k int, x double")
    assert [r.k for r in clean.sort_nulls_last(df, ["x"], ascending=False).collect()][:2] == [1, 4]
    assert clean.row_at(df, ["k"], 2).first().k == 3
    assert clean.row_at(df, ["k"], 9).count() == 0


def test_row_at_is_one_row_among_ties_and_repeats(spark):
    rows = [(None, 1), ("a", 2), ("a", 3), ("a", 3), (None, 1), ("b", 9)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = [clean.row_at(df, ["g"], n).collect() for n in range(7)]
    assert [len(r) for r in got] == [1] * 6 + [0]
    assert sorted(map(str, [tuple(r[0]) for r in got[:6]])) == sorted(map(str, rows))
    assert [r[0].g for r in got[:6]] == ["a", "a", "a", "b", None, None]


def test_record_profile(spark):
    df = spark.createDataFrame([(7, "x", 2.5)], "k int, s string, v double")
    got = {(r.column_name, r.value) for r in reshape.record_profile(df, "k").collect()}
    assert got == {("s", "x"), ("v", "2.5")}


def test_drop_columns_strict_and_other_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert schema.other_columns(df, ["b"]) == ["a", "c"]
    assert schema.column_slice(df, 1, 3).columns == ["b", "c"]
    try:
        schema.drop_columns(df, ["zz"])
        raise AssertionError("missing column must raise")
    except ValueError:
        pass
    assert schema.drop_columns(df, ["zz"], strict=False).columns == ["a", "b", "c"]


def test_write_run_and_list_files(spark):
    base = scratch_dir(spark, "runs-test")
    df = synthetic_binary(spark, 100, ["a", "b", "c"], seed=1)
    path = write_run(df, base, run_id="20200101-000000")
    assert path.endswith("run_id=20200101-000000")
    assert read_table(spark, path).count() == 100
    assert list_files(spark, path, "*.parquet").count() >= 1
    vals = {r.a for r in df.collect()}
    assert vals <= {0, 1}
