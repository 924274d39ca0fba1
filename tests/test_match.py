from parcelrisk.operators.match import flag_membership, matched, staged_match, unmatched


def test_flag_membership_case_insensitive_no_fanout(spark):
    left = spark.createDataFrame([("A St",), ("B St",), (None,)], "addr string")
    keys = spark.createDataFrame([("a ST",), ("a st",)], "address string")
    out = flag_membership(left, keys, "addr", "address", out="TARGET")
    got = sorted((r.addr or "", r.TARGET) for r in out.collect())
    assert got == [("", 0), ("A St", 1), ("B St", 0)]
    assert out.count() == 3


def test_semi_and_anti_partition_the_input(spark):
    left = spark.createDataFrame([("X",), ("x",), ("Y",)], "a string")
    keys = spark.createDataFrame([("x",)], "a string")
    semi = sorted(r.a for r in matched(left, keys, "a").collect())
    anti = sorted(r.a for r in unmatched(left, keys, "a").collect())
    assert semi == ["X", "x"] and anti == ["Y"]


def test_staged_match(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    u1 = spark.createDataFrame([("a",)], "k string")
    u2 = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: r.stage for r in staged_match(left, [u1, u2], "k").collect()}
    assert got == {"a": 1, "b": 2, "c": None}


def test_match_summary_counts(spark):
    from parcelrisk.operators.match import match_summary
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    u1 = spark.createDataFrame([("a",)], "k string")
    u2 = spark.createDataFrame([("a",), ("b",)], "k string")
    staged = staged_match(left, [u1, u2], "k")
    got = [tuple(r) for r in match_summary(staged, 2).orderBy("stage").collect()]
    assert got == [(1, 1, 2), (2, 1, 1)]
