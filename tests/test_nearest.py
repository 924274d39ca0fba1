import math
import random

import pytest
from pyspark.sql import functions as F

from parcelrisk.operators.grid import nearest_k, neighbours_of


def plain(points, rows, k, exclude_self):
    out = []
    for p, px, py in points:
        near = sorted((math.sqrt((x - px) * (x - px) + (y - py) * (y - py)), key) for key, x, y in rows
                      if not (exclude_self and key == p))
        out += [(p, key, d, n) for n, (d, key) in enumerate(near[:k], 1)]
    return sorted(out)


def scattered(seed):
    """Dense and thin regions, one place with a third of all rows, and outliers."""
    rng = random.Random(seed)
    rows = [(i, 5.0, 5.0) for i in range(150)]
    rows += [(1000 + i, rng.gauss(50, .01), rng.gauss(50, .01)) for i in range(120)]
    rows += [(2000 + i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(120)]
    rows += [(3000 + i, float(rng.randrange(20)), float(rng.randrange(20))) for i in range(60)]
    return rows + [(4000, 1e5, 1e5), (4001, -1e4, 3.0)]


@pytest.mark.parametrize("k,exclude_self", [(1, False), (5, True), (40, True), (1000, False)])
def test_equals_all_pairs(spark, k, exclude_self):
    rows = scattered(k)
    points = sorted({*rows[::9], *rows[-2:]})
    got = nearest_k(spark.createDataFrame(points, "id int, x double, y double"),
                    spark.createDataFrame(rows, "id int, x double, y double").repartition(3),
                    "x", "y", k, "id", "id", exclude_self)
    assert sorted(tuple(r) for r in got.collect()) == plain(points, rows, k, exclude_self)


def test_defined_edge_cases(spark):
    schema = "id int, x double, y double"
    rows = [(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 0.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in nearest_k(df, df, "x", "y", 3, "id", "id").collect()] == [(1, 1, 0.0, 1)]
    assert nearest_k(df, df, "x", "y", 3, "id", "id", exclude_self=True).collect() == []
    assert nearest_k(df.limit(0), df, "x", "y", 3, "id", "id").collect() == []
    assert nearest_k(df, df.limit(0), "x", "y", 3, "id", "id").collect() == []


def test_rows_meet_by_cells_only(spark):
    rows = [(i, random.Random(i).random(), random.Random(-i).random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    p = nearest_k(df.where("id < 5"), df, "x", "y", 3, "id", "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_neighbours_of_a_full_cell_are_dealt_to_many_tasks(spark):
    rows = [(i, random.Random(i).random() * 3, random.Random(-i).random()) for i in range(9000)]
    rows += [(1, .5, .5)] * 3 + [(None, .5, .5), (9001, None, .5), (9002, float("nan"), .5)]
    points = [(k, px, py) for k, px, py in rows[:40]] + rows[-4:]
    schema = "id int, x double, y double"
    got = neighbours_of(spark.createDataFrame(points, schema).coalesce(1),
                        spark.createDataFrame(rows, schema).coalesce(1), "x", "y", 1.0, "id", "id")
    near = [(k, q) for k, px, py in points for q, x, y in rows if None not in (px, x)
            and math.sqrt((x - px) ** 2 + (y - py) ** 2) <= 1.0]
    order = lambda r: tuple((v is None, v or 0) for v in r)                              # noqa: E731
    assert sorted([(r[0], r[1]) for r in got.collect()], key=order) == sorted(near, key=order)
    work = got.select("neighbour", F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert len(work) >= 3 and max(r["count"] for r in work) < 0.7 * len(near)
