import random

import pytest

from helpers import documents
from parcelrisk.llm import license_scan as L
from parcelrisk.llm.queries import QUERIES

MIT = [t for n, t in L.TEMPLATES if n == "MIT"][1]
CODE = "\n".join(f"int f{i}(int a{i}) {{ return a{i} * {i}; }}" for i in range(60))
GPL = [t for n, t in L.TEMPLATES if n == "GPL-3.0"][1]
HEADER = "/*\n * " + GPL.replace("This program is distributed", "\n *\n * This program is distributed").replace(
    "You should", "\n *\n * You should") + "\n */\n"
PROSE = " ".join(f"word{i} and the other{i} of it" for i in range(300))
THREE = MIT.replace("The above", "\n\nThe above").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
FULL = dict(L.full_texts())
CASES = [
    (PROSE + "\n\n" + THREE + "\n\n" + PROSE, ["MIT"]),
    (HEADER + CODE, ["GPL-3.0"]),
    (HEADER.replace("either version 3", "either version 2") + CODE, ["GPL-2.0"]),
    ("Photo by X. Licensed under CC BY 4.0. All other rights reserved by their owners.", ["CC-BY-4.0"]),
    ("Copyright 2020 Example Corp. Licensed under the Apache License, Version 2.0. See LICENSE.", ["Apache-2.0"]),
    (PROSE + " Licensed under CC BY-NC 4.0. " + PROSE + " Released under the MIT License. x", ["CC-BY-NC-4.0", "MIT"]),
    (" ".join(["Licensed under CC BY 4.0."] * 5), ["CC-BY-4.0"] * 5),
    *((PROSE + "\n\n" + t + "\n\n" + PROSE, [n]) for n, t in FULL.items()),
    (PROSE, []), (CODE, []), ("", []), (None, []),
]


def scanned(spark, texts):
    rows = L.scan_licenses(documents(spark, texts)).collect()
    return {r.doc_id: r for r in rows}


def test_notices_in_long_lines_and_across_paragraphs(spark):
    got = scanned(spark, [t for t, _ in CASES])
    for i, (text, want) in enumerate(CASES):
        assert [p.license for p in got[i].passages] == want, (i, got[i])
    mit = got[0].passages[0]
    assert got[0].hits == [] and mit.dice == 1.0 and (mit.first_line, mit.end_line) == (2, 7)


def test_units_are_not_reported_again(spark):
    got = scanned(spark, ["a\nReleased under the MIT License.\nb", MIT, "x\n\n" + MIT.replace(", ", ",\n") + "\n\ny"])
    assert all(r.hits and r.passages == [] for r in got.values())


def test_query_reports_passages(spark, tmp_path):
    documents(spark, [t for t, _ in CASES[:6]]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()}
    assert [got[i].licenses for i in range(6)] == [",".join(sorted(w)) for _, w in CASES[:6]]


def best_dice(words, template):
    """The best score of any window, by trying all."""
    bag = L.Counter(L.bigrams(template))
    m, top = len(template) - 1, 0.0
    for i in range(len(words) - 1):
        for j in range(i + 2, len(words) + 1):
            g = L.Counter(L.bigrams(words[i:j]))
            top = max(top, 2 * (g & bag).total() / (j - i - 1 + m))
    return top


@pytest.mark.parametrize("seed", range(40))
def test_windows_equal_brute_force(seed):
    r = random.Random(seed)
    template = [b"abcd"[k:k + 1] for k in (r.randrange(4) for _ in range(r.randrange(3, 9)))]
    known = L.Passages([("X", b" ".join(template).decode())], 0.8)
    words = [b"abcdz"[k:k + 1] for k in (r.randrange(5) for _ in range(30))]
    want, got = best_dice(words, template), known.find(words)
    assert (max(d for *_, d in got) if got else 0) == (want if want >= 0.8 else 0)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
