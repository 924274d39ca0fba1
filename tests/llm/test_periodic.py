import random
import re
import zlib

import numpy as np
import pytest

from helpers import documents, sample_texts, sha
from parcelrisk.llm import periodic as P
from parcelrisk.llm.queries import QUERIES


def plain_runs(w, min_words=6, min_exponent=4):
    """Every period tried at every place."""
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = q
        while i < n:
            if w[i] == w[i - q]:
                s = i - q
                while i < n and w[i] == w[i - q]:
                    i += 1
                if i - s >= max(min_words, min_exponent * q) and not any(
                        all(w[k] == w[k - d] for k in range(s + d, i)) for d in range(1, q)):
                    out.append((s, i - s, q))
            i += 1
    return sorted(out)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_damage(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    w = plain_damage(doc_id, words_of(text))
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    four = (None,) * 4 if best is None else (
        best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("min_words,min_exponent", [(6, 4), (2, 2), (4, 3), (1, 2)])
def test_runs_equal_every_period_tried(min_words, min_exponent):
    rng = random.Random(min_words)
    gram = 3 if min_exponent >= 3 and min_words >= 4 else 1
    for _ in range(400):
        n, k = rng.randint(1, 40), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < .5:
            a, p = rng.randrange(n), rng.randint(1, 6)
            w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
        want = plain_runs(w, min_words, min_exponent)
        assert P.runs_of(w, min_words, min_exponent) == want
        twice, got = np.array(w + w), []
        for lo, hi in P.candidate_stretches(twice, np.array([0, n, 2 * n]), gram, min_words, min_exponent):
            assert (lo < n) == (hi <= n)         # never across texts
            got += [(lo + s, m, q) for s, m, q in P.runs_of(twice[lo:hi].tolist(), min_words, min_exponent)]
        assert sorted(got) == sorted(want + [(s + n, m, q) for s, m, q in want])


def test_query_equals_plain_version(spark, tmp_path):
    texts = [t for _, t in sample_texts(spark)][:120]
    texts = [t if t is None or len(t) < 3000 else t[:3000] for t in texts]
    texts += [None, "", " \t\n\x0b", "a", "a " * 6, "a b " * 4, "x a b a b a b a b\ny", "no " * 5,
              "É\x0bÉ\x0cÉ\x1cÉ É É É É É É"]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    rows = {tuple(r) for r in got.collect()}
    assert rows == {plain_row(i, t) for i, t in enumerate(texts)}
    assert sum(r[1] for r in rows) > 5


def test_long_text_in_one_period_and_many(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(2000)]
    texts = ["z " * 60_000, " ".join(base * 20), " ".join(base[:7] * 4000 + base)]
    got = {r["doc_id"]: r for r in P.periodic_runs(documents(spark, texts)).collect()}
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 60_000, 1)] and got[0]["collapsed"] == "z"
    assert (0, 40_000, 2000) in [tuple(r) for r in got[1]["runs"]]
    assert got[2]["runs"][0]["period"] == 7 and got[2]["runs"][0]["length"] >= 28_000


def test_defined_edge_cases(spark):
    docs = spark.createDataFrame(
        [(None, "q " * 9, "1", "x"), (5, None, "2", None), (5, "q " * 9, "3", "x"), (5, "q " * 9, "3", "x")],
        "doc_id long, text string, runs string, `n_words` string")
    got = sorted(P.periodic_runs(docs).collect(), key=str)
    assert [(r["doc_id"], r["n_words"], len(r["runs"]), r["collapsed"]) for r in got] == [
        (5, 0, 0, ""), (5, 9, 1, "q"), (5, 9, 1, "q"), (None, 9, 1, "q")]
    assert P.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(docs, min_exponent=1)
