import random

import numpy as np
import pytest
import xxhash

from helpers import documents, sample_texts
from parcelrisk.llm import simhash as S
from parcelrisk.llm.components import connected_components
from parcelrisk.llm.queries import QUERIES


def plain_fingerprint(text, k):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_fingerprints_equal_plain_version(spark):
    texts = [None, "", " \n", "One", "one two", "A b C d", "É e É e É e", "x " * 500,
             "a\x1cb c\x85d e", *[t for _, t in sample_texts(spark)[:60]]]
    for k in (1, 3, 5):
        for t in texts:
            assert S.fingerprint(t, k) == plain_fingerprint(t, k)


def test_manhattan_distance_is_a_lower_bound_of_the_bit_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 4000), np.uint64)
    for w in (1, 2, 4, 8):
        u, v = S.embed(a, w), S.embed(b, w)
        got = np.bitwise_count(u ^ v)
        x, y = (np.unpackbits(z.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                .reshape(len(z), -1, w).sum(2).astype(int) for z in (a, b))
        assert (got == np.abs(x - y).sum(1)).all()
        assert (got <= np.bitwise_count(a ^ b)).all()


def planted(seed, centres=25, each=14):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(each):
            out.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("bits,limit,segment", [(3, 8192, 2), (3, 3, 2), (2, 3, 2), (1, 3, 2), (4, 8192, 4)])
def test_links_connect_what_all_pairs_connect(spark, bits, limit, segment):
    """Chains of near fingerprints; a low limit sends cells the linear way."""
    fps = planted(bits)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = S.fingerprint_links(df, bits, segment, limit)
    pairs = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in pairs)
    linked = set(pairs) | {(b, a) for a, b in pairs}
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    assert components(fps, lambda a, b: (a, b) in linked) == want


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e})
    both = set(edges) | {(b, a) for a, b in edges}
    want = components(nodes, lambda a, b: (a, b) in both)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_plain_version(spark):
    from helpers import SF_SMALL
    rows = sample_texts(spark)
    fp = {i: plain_fingerprint(t, 3) for i, t in rows}
    want = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = QUERIES["op1_simhash"](spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert len(set(want.values())) < len(want)


def test_nulls_repeats_and_empty(spark):
    df = documents(spark, ["a b c d e", "a b c d e", None, "", "other words in here now", "a b c d e"],
                   [None, 5, 7, 6, None, 5])
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in
                 S.near_duplicates(df, shingle=3).collect() if r.doc_id is not None)
    assert got == [(False, 5, 5), (False, 5, 5), (False, 6, 6), (False, 7, 6)]
    none = [r.component_id for r in S.near_duplicates(df, shingle=3).filter("doc_id is null").collect()]
    assert sorted(none, key=str) == [5, None]
    assert S.near_duplicates(documents(spark, []), shingle=3).count() == 0


def test_keep_one_per_group(spark):
    df = documents(spark, ["a b c d e", "a b c d e", None, "", "other words in here now",
                           "a b c d e", "a b c d e", "sole text of a null id"],
                   [None, 5, 7, 6, 9, 5, 8, None]).selectExpr("*", "1 as fp", "2 as r1", "3 as `id`")
    got = S.keep_one_per_group(df, shingle=3)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == [
        (False, 5), (False, 6), (False, 9), (True, None)]
    assert S.keep_one_per_group(documents(spark, []), shingle=3).count() == 0
