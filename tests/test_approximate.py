import random

import pytest
from pyspark.sql import functions as F

from parcelrisk.operators.approximate import _left_over, near_texts, nearest_text


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slipped(rng, s, n):
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice("ab 0é")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1:], s[:i] + c + s[i + 1:]])
    return s


def texts_of(spark, texts):
    return spark.createDataFrame([(x,) for x in texts], "text string")


@pytest.mark.parametrize("distance,q", [(0, 2), (1, 2), (2, 2), (2, 3), (3, 2), (1, 1)])
def test_near_texts_are_all_pairs(spark, distance, q):
    rng = random.Random(distance * 10 + q)
    right = ["", "a", "ab", "0000000000", "0" * 14] + [
        "".join(rng.choice("ab0 é") for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14]))) for _ in range(90)]
    left = [slipped(rng, rng.choice(right), rng.randint(0, 4)) for _ in range(110)] + ["", "00000"]
    want = {(x, y, edits(x, y)) for x in left for y in right if edits(x, y) <= distance}
    got = near_texts(texts_of(spark, left * 2), texts_of(spark, right), distance, q)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_nearest_text_keeps_rows_and_prefers_the_nearest(spark):
    universe = spark.createDataFrame(
        [("12 Main St", 5), ("12 Main St", 4), ("13 Main St", 7), ("9 Oak Ave", 9), (None, 1)], "addr string, area int")
    rows = [(1, "12 MAIN ST"), (2, "12 Man St"), (3, "1 Main St"), (4, "9 Oak Avenue"), (5, None), (6, ""),
            (7, "12 Man St")]
    d = nearest_text(spark.createDataFrame(rows, "id int, a string"), universe, "a", "addr", "area", [0, 1, 2])
    got = {r["id"]: (r["area"], r["area_distance"], r["area_stage"]) for r in d.collect()}
    assert got == {1: (4, 0, 1), 2: (4, 1, 2), 3: (4, 1, 2), 4: (None,) * 3, 5: (None,) * 3,
                   6: (None,) * 3, 7: (4, 1, 2)}
    assert d.columns == ["id", "a", "area", "area_distance", "area_stage"]
    with pytest.raises(ValueError):
        near_texts(texts_of(spark, []), texts_of(spark, []), -1)


def test_blocks_go_by_the_rarest_grams(spark):
    # all texts share a long frequent part; they meet through what is their own
    left = texts_of(spark, [f"common street name {i:04d}" for i in range(600)])
    met = near_texts(left, left, 0)
    assert met.count() == 600
    p = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    grams = left.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(22)), lambda i: F.substring(
        "text", i, F.lit(2)))).alias("g")).groupBy("g").count()
    assert grams.agg(F.max("count")).first()[0] >= 600           # which would be one block of all


@pytest.mark.parametrize("distance", [1, 2])
def test_numbers_in_a_row_meet_only_near_ones(spark, distance):
    # every gram is in hundreds of these texts
    names = [f"customer#{i:09d}" for i in range(0, 4000, 7)]
    slips = [n.replace("om", "mo") if i % 2 else n[:12] + "x" + n[12:] for i, n in enumerate(names[::9])] + names[::9]
    want = {(x, y, edits(x, y)) for x in slips for y in names if abs(len(x) - len(y)) <= distance
            and sum(a != b for a, b in zip(x[-4:], y[-4:])) <= distance * 2 and edits(x, y) <= distance}
    left, right = texts_of(spark, slips), texts_of(spark, names)
    assert {tuple(r) for r in near_texts(left, right, distance).collect()} == want
    met = _left_over(left, right, distance, "l").join(_left_over(right, left, distance, "r"), "rest")
    assert met.select("l", "r").distinct().count() == len(want)


def test_long_and_short_texts_meet(spark):
    # 32 characters is where texts cease to meet by what is left of them (two edits)
    rng = random.Random(5)
    right = ["".join(rng.choice("ab0 ") for _ in range(n)) for n in range(29, 38) for _ in range(6)]
    left = [slipped(rng, x, rng.randint(0, 3)) for x in right * 2]
    want = {(x, y, edits(x, y)) for x in left for y in right if edits(x, y) <= 2}
    got = near_texts(texts_of(spark, left), texts_of(spark, right), 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
