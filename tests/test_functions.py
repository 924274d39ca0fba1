from pyspark.sql import functions as F

from parcelrisk.sources import entry_table_name

from parcelrisk.functions import (
    bool_to_int, composite_key, flag, not_in_keep_null, numeric_key_to_string, safe_ratio,
    zero_pad,
)


def col(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_zero_pad_never_truncates_and_keeps_sign_and_null(spark):
    df = spark.createDataFrame([("42",), ("1234567",), (None,), ("-42",)], "v string")
    assert col(df, zero_pad("v", 6)) == ["000042", "1234567", None, "-00042"]


def test_composite_key(spark):
    df = spark.createDataFrame([(335240, 1605), (12, 3)], "major long, minor long")
    assert col(df, composite_key(["major", "minor"], [6, 4])) == ["3352401605", "0000120003"]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (0.0, 0.0)], "a double, b double")
    assert col(df, safe_ratio("a", "b")) == [0.25, None, None]


def test_flag_and_bool(spark):
    df = spark.createDataFrame([("Y",), ("N",), (None,), ("y",)], "f string")
    assert col(df, flag("f")) == [1, 0, 0, 0]
    b = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert col(b, bool_to_int("b")) == [1, 0, 0]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("Closed",), ("Completed",), ("Issued",), (None,)], "s string")
    kept = df.where(not_in_keep_null("s", ["Closed", "Completed"])).collect()
    assert sorted([r[0] for r in kept], key=str) == ["Issued", None] or \
        sorted([str(r[0]) for r in kept]) == ["Issued", "None"]


def test_numeric_key_to_string(spark):
    df = spark.createDataFrame([(7732500.0,)], "k double")
    assert col(df, numeric_key_to_string("k")) == ["7732500"]


def test_entry_table_name():
    assert [entry_table_name(x) for x in ("EXTR_ValueHistory_V.csv", "Other.tar.csv")] == [
        "valuehistory_v", "other"]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert col(df, F.bround("x", 0)) == [0.0, 2.0, 2.0]
