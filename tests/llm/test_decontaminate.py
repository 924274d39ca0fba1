import random
import re

from helpers import ascii_lower, documents, sha
from parcelrisk.llm import decontaminate as D


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))


def plain(text, items, window=10):
    w = words_of(text)
    hit, names = set(), set()
    for name, t in items:
        iw = words_of(t)
        if not iw:
            continue
        n = min(window, len(iw))
        wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                if name is not None:
                    names.add(str(name))
    return len(w), hit, sorted(names)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check(spark, texts, items, **kw):
    df = documents(spark, texts)
    got = {r.doc_id: r for r in D.benchmark_hits(df, bench(spark, items), **kw).collect()}
    for i, t in enumerate(texts):
        n, hit, names = plain(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, len(hit), names), t
        assert {x for s in r.spans for x in range(s.start, s.end)} == hit


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 9, 10, 11, 25])))) for i in range(15)]
    texts = []
    for _ in range(60):
        parts = rng.choices(vocab + ["zz"], k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 8))
            parts[rng.randint(0, len(parts)):0] = w[a:a + rng.randint(5, 14)]
        texts.append(" ".join(parts))
    return texts, items


def test_random_small_vocabulary(spark):
    texts, items = corpus(1)
    check(spark, [*texts, None, "", "..."], items)


def test_groups_of_items_and_cut_items(spark):
    """A size bound so low that items come in several groups and long ones are cut."""
    texts, items = corpus(2)
    check(spark, texts, [*items, (99, texts[0] + " " + texts[1])], max_words=14)


def test_normalisation_and_edges(spark):
    item = "Alpha, beta; GAMMA-delta 5 é É naïve x_y (end) last"
    texts = [f"pre {item} post", item.upper(), item.lower().replace(" ", "\n"), None, "", "one"]
    check(spark, texts, [(1, item), (2, None), (3, ""), (1, item), (None, "one"), (4, "...")])
    check(spark, texts, [])
    assert D.benchmark_hits(documents(spark, []), bench(spark, [(1, item)])).count() == 0


def test_cut_and_drop(spark):
    item = " ".join(f"b{i}" for i in range(12))
    filler = " ".join(f"f{i}" for i in range(30))
    texts = [f"{filler}. {item}! {filler}", item, filler, None, f"Pre {item}"]
    df = documents(spark, texts).selectExpr("*", "1 as spans", "2 as __d_items")
    got = D.decontaminate(df, bench(spark, [(1, item)]))
    assert got.columns == df.columns
    rows = {r.doc_id: r.text for r in got.collect()}
    assert rows == {0: f"{filler}. ! {filler}", 2: filler, 3: None}


def test_long_text_in_segments(monkeypatch):
    monkeypatch.setattr(D, "_SEGMENT", 16)
    text = "Word " * 50 + "x" * 100 + " é" * 40
    got = [w for part in D.normal_words(text) for w in part]
    assert got == [w.encode() for w in words_of(text)]


def test_query_digest(spark):
    from parcelrisk.llm.queries import QUERIES
    from helpers import SF_SMALL, sample_texts
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    texts = dict(sample_texts(spark))
    for r in QUERIES["op3_decontaminate"](spark, SF_SMALL).collect():
        n, hit, names = plain(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            n, len(hit), len(names), sha(",".join(names)), bool(hit))


def test_the_automaton_is_held_in_arrays():
    import pickle
    rng = random.Random(6)
    words = [f"w{rng.randrange(4000)}".encode() for _ in range(30_000)]
    a = D.SuffixAutomaton([(str(k), words[k * 300:k * 300 + 300], True) for k in range(100)], 10)
    vocabulary = len(pickle.dumps(a.vocab))
    assert len(pickle.dumps(a)) - vocabulary < 60 * len(words)
    text = b" ".join([b"x", *words[40:60], b"y", *words[900:909], b"z"]).decode()
    assert a.scan(text) == (32, [(1, 21)], {"0"})
