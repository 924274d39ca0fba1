import random
import re
from collections import Counter
from itertools import combinations, product

from helpers import SF_SMALL, ascii_lower
from parcelrisk.llm import url_filter as U
from parcelrisk.llm.queries import QUERIES

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?x=1", "https://example.com/en/",
        "https://example.com/en", "https://notexample.com/en/x", "https://a.example.com/en/x#t",
        "x://a.net/es/://b.com/", "x://a.net/fr/a/b", "x://net/fr/", "x://a.org/es/", "x://a.com?q=/en/",
        "x://a.com#/", "x://É.COM/", "x://www.example.com/en/1", "x://m.www.example.com/en/1",
        "x://a.b.net/es", "://a.com/", "a\nb://c.com/d\ne"]


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host))
            and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def none(spark):
    return spark.createDataFrame([], "tokens array<string>, post string, support double, confidence double")


def test_fixed_rules(spark):
    got = {r.page_id: r for r in U.judge_urls(pages(spark, URLS), none(spark)).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (
            host, path, rule, verdict or "allow"), url


def sample(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        farm, lang = rng.random() < 0.2, rng.choice(["en", "xx", "yy"])
        host = "spam.site.org" if farm else rng.choice(["a.site.org", "b.site.org"])
        rows.append((f"http://{host}/{lang}/{rng.randint(1, 3)}", farm and lang != "en"))
    return rows


def tokens(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return [r.t for r in df.select(U.url_tokens(df.url).alias("t")).collect()]


def plain_rules(bags, min_support, min_confidence):
    """All token sets that reach both limits: {set: (support, confidence)}."""
    seen, bad = Counter(), Counter()
    for bag, b in bags:
        for k in range(1, len(bag) + 1):
            for c in combinations(sorted(bag), k):
                seen[c] += 1
                bad[c] += b
    return {c: (bad[c] / len(bags), bad[c] / n) for c, n in seen.items()
            if bad[c] >= min_support * len(bags) and bad[c] / n >= min_confidence}


def test_mined_rules_equal_plain_counts(spark):
    rows = sample(spark)
    got = U.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), min_support=0.02,
                       min_confidence=0.6).collect()
    bags = list(zip((set(t) for t in tokens(spark, [u for u, _ in rows])), (b for _, b in rows)))
    every = plain_rules(bags, 0.02, 0.6)
    least = {c: v for c, v in every.items() if not any(set(o) < set(c) for o in every)}
    spelled = {}
    for r in got:
        assert [a[0] for a in r.alternatives] == r.tokens and r.post in r.tokens
        for c in product(*r.alternatives):
            spelled[tuple(sorted(c))] = (r.support, r.confidence)
    assert spelled == least and least
    single = Counter(t for bag, _ in bags for t in bag)
    for r in got:
        assert r.post == min(r.tokens, key=lambda t: (single[t], t))
        for a in r.alternatives:           # a class: tokens of the same URLs
            assert len({frozenset(i for i, (bag, _) in enumerate(bags) if t in bag) for t in a}) == 1


def test_index_equals_plain_match(spark):
    rows = sample(spark)
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)] + [(None, None, True)] * 2,
                               "page_id long, url string, bad boolean").selectExpr("*", "1 as id", "2 as host")
    rules = U.mine_rules(df, min_support=0.02)
    have = tokens(spark, [u for u, _ in rows])
    every = [set(c) for c in plain_rules([(set(t), b) for t, (_, b) in zip(have, rows)] + [({"label"}, True)] * 2,
                                         0.02, 0.6) if c != ("label",)]
    more = ["http://spam.site.org/other/9", "http://x.site.org/xx/1", "http://spam/yy"]      # not labelled
    got = U.judge_urls(df.unionByName(spark.createDataFrame(
        [(1000 + i, u) for i, u in enumerate(more)], "page_id long, url string"), allowMissingColumns=True), rules)
    have = dict(enumerate(have)) | {1000 + i: t for i, t in enumerate(tokens(spark, more))}
    for r in got.filter("page_id is not null").collect():
        assert r.mined == any(s <= set(have[r.page_id]) for s in every), r
        assert r.verdict == ("block" if r.mined else "allow")
    assert got.filter("page_id is null").count() == 2
    assert got.filter("mined").count() > 20


def test_long_paths_of_one_site_make_one_rule(spark):
    path = "/".join(f"part{i}" for i in range(25))
    rows = [(f"http://bad.site.org/{path}", True)] * 20 + [(f"http://ok.site.org/{i}", i % 9 == 0) for i in range(980)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = U.mine_rules(df, min_support=0.01).collect()
    assert len(rules) == 1 and len(rules[0].tokens) == 1 and rules[0].support == 0.02
    assert {f"path:part{i}" for i in range(25)} <= set(rules[0].alternatives[0])
    asked = [f"http://bad.site.org/{path}", "http://bad.site.org/", "http://ok.site.org/part7", "http://ok.site.org/1"]
    got = U.judge_urls(pages(spark, asked), U.mine_rules(df, min_support=0.01))
    # what all 2 ** 27 sets of these tokens would say
    assert [r.mined for r in got.orderBy("page_id").collect()] == [True, True, True, False]


def test_empty_tables(spark):
    rules = U.mine_rules(spark.createDataFrame([], "url string, bad boolean"))
    assert rules.count() == 0
    assert U.judge_urls(spark.createDataFrame(
        [], "page_id long, url string"), rules).count() == 0


def test_query(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    rows = QUERIES["op4_url_filter"](spark, SF_SMALL).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))
