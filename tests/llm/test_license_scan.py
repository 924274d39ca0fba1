import re
from collections import Counter

from helpers import SF_SMALL, ascii_lower, documents, sample_texts
from parcelrisk.llm import license_scan as L
from parcelrisk.llm.queries import QUERIES


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def grams(w):
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def dice(a, b):
    return 2 * (a & b).total() / (a.total() + b.total())


def plain(text):
    """Every unit against every template."""
    lines = (text or "").split("\n")
    units = [(i, i + 1) for i, x in enumerate(lines) if words(x)]
    blocks, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and words(lines[j]):
            j += 1
        if j > i:
            blocks.append((i, j))
        i = max(j, i + 1)
    units += [b for b in blocks if b[1] - b[0] > 1] + [(0, len(lines))] * (len(blocks) > 1)
    out = []
    for s, e in units:
        g = grams(words("\n".join(lines[s:e])))
        scores = [(-dice(g, grams(words(t))), name) for name, t in L.TEMPLATES]
        best = min(scores)
        if -best[0] >= L.MIN_DICE:
            out.append((s, e, best[1], -best[0]))
    return sorted(out)


def scanned(df):
    return {r[0]: [tuple(h) for h in r.hits] for r in L.scan_licenses(df).collect()}


MIT = [t for n, t in L.TEMPLATES if n == "MIT"][1]
CASES = [None, "", "\n\n", "word", "Released under the MIT License.", "released UNDER the mit-license!!",
         "text before\nLicensed under CC BY-NC 4.0.\nafter", MIT, MIT.replace(". ", ".\n"),
         "Intro words here.\n\n" + MIT.replace(", ", ",\n").replace("copies", "duplicates") + "\n\nEnd.",
         "This work is licensed under the GNU General Public License, version 2 or 3.",
         "Licensed under the Apache License", " ".join(["Licensed under CC BY 4.0."] * 5), "the " * 9000]


def test_cases(spark):
    got = scanned(documents(spark, CASES))
    for i, t in enumerate(CASES):
        assert got[i] == plain(t), t
    assert got[4][0][2] == "MIT" and got[7][0][2:] == ("MIT", 1.0) and got[9]


def test_table(spark):
    rows = sample_texts(spark)
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[i] == plain(t) for i, t in rows)
    for r in QUERIES["op5_license_scan"](spark, SF_SMALL).collect():
        want = plain(dict(rows)[r.doc_id])
        assert r.n_hits == len(want) and r.licenses == ",".join(sorted({h[2] for h in want}))
        assert (r.license, r.dice) == (min((-h[3], h[2]) for h in want)[1], max(h[3] for h in want)
                                       ) if want else (r.license is None and r.dice is None)


def test_size_bounds_lose_nothing():
    known = L.Templates(L.TEMPLATES, 0.8)
    for n in range(1, 400):
        near = set(known.candidates(n))
        for k, size in enumerate(known.sizes):
            if 2 * min(n, size) / (n + size) >= 0.8:
                assert k in near


def test_nulls_repeats_and_empty(spark):
    df = documents(spark, [CASES[4]] * 2 + [None], [None, None, None]).selectExpr("*", "1 as hits", "2 as id")
    assert [len(r.hits) for r in L.scan_licenses(df).collect()] == [1, 1, 0]
    assert scanned(documents(spark, [])) == {}
