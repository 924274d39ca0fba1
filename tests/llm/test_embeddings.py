import numpy as np
import pytest

from helpers import SF_SMALL
from parcelrisk.llm import embeddings as E
from parcelrisk.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """All pairs; {(id, n_links, component, kept)} for unique ids."""
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows
            if lab is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    root, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, x, lab) in enumerate(good):
        for j, y, other in good[:k]:
            if lab == other and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, links[i], find(i), find(i) == i) for i, _, _ in rows}


def clusters(seed, sizes, dim=16, noise=0.06):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        centre = rng.standard_normal(dim)
        for x in centre + noise * np.linalg.norm(centre) * rng.standard_normal((n, dim)):
            rows.append((len(rows), (x * rng.uniform(.5, 3)).astype(np.float32).tolist(), k % 3))
    return rows


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("small", [1024, 20])       # 20: by centre and tiles
def test_equals_all_pairs(spark, small):
    rows = clusters(1, [1] * 40 + [2] * 30 + [9] * 12 + [70, 150])
    df = spark.createDataFrame(rows, ROWS)
    res = got(E.near_duplicate_vectors(df, window=16, block=64, small=small))
    assert res == brute(rows)
    assert sum(not kept for *_, kept in res) > 200


@pytest.mark.parametrize("noise", [0.02, 0.1, 0.2])     # all within, some, chains
def test_large_components_are_counted_in_full(spark, noise):
    rows = clusters(2, [220, 5], noise=noise)
    df = spark.createDataFrame(rows, ROWS)
    assert got(E.near_duplicate_vectors(df, window=8, block=32, small=16, recall=1 - 1e-9)) == brute(rows)


def test_copies_of_one_vector(spark):
    v = [1.0, -2.0, 0.5]
    rows = [(i, v, 1) for i in range(600)] + [(600 + i, [2 * x for x in v], 1) for i in range(5)] \
        + [(700, v, 2), (701, v, None)]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    want = {(i, 604, 0, i == 0) for i in range(605)} | {(700, 0, 700, True), (701, 0, 701, True)}
    assert got(E.near_duplicate_vectors(df, window=4, block=50, small=100)) == want


def test_defined_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0),
            (6, [inf, 1.0], 0), (7, [1.0, 1.0], None), (8, [1.0, 1.0], 0), (9, [1.0, 1.0, 0.0], 0),
            (10, [1e-38, 1e-38], 0), (11, [3e38, 3e38], 0), (12, [-1.0, -1.0], 0)]
    df = spark.createDataFrame(rows, ROWS)
    want = {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 9, 12)} | {
        (8, 2, 8, True), (10, 2, 8, False), (11, 2, 8, False)}
    assert got(E.near_duplicate_vectors(df)) == want
    assert E.near_duplicate_vectors(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, [1.0, 2.0], "a", 1), (4, [1.0, 2.0], "a", 2), (4, [1.0, 2.0], "a", 3),
                                 (None, [5.0, 2.0], "a", 4)],
                                "vec_id long, v array<double>, label string, node int")
    res = sorted((tuple(r) for r in E.near_duplicate_vectors(odd, vector_col="v").collect()), key=str)
    assert res == [(4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True), (None, 2, 4, False)]


def test_query_over_the_whole_table_and_recall_at_the_threshold(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert got(QUERIES["op11_embedding_dedup"](spark, SF_SMALL)) == brute(given)
    # pairs just above the threshold, in 64 dimensions among others
    rng, rows = np.random.default_rng(4), []
    for _ in range(1500):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        c = rng.uniform(0.931, 0.95)
        rows += [(len(rows), x.tolist(), 0), (len(rows) + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 0)]
    df = spark.createDataFrame(rows, ROWS)
    found = sum(r["n_links"] for r in E.near_duplicate_vectors(df).collect()) / 3000
    assert found >= 0.995
