import random
import re
import string

import pytest

from parcelrisk.llm import secret_scan as S

LOWER = string.ascii_lowercase + string.digits
MIXED = LOWER + string.ascii_uppercase
ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": LOWER, "UPPER": LOWER.upper(),
             "lower_-": LOWER + "_-", "mixed": MIXED, "base64": MIXED + "+/", "base64url": MIXED + "-_"}
PREFIXES = ["", "k_", "npm_", "key-"]
N = 200


def tokens(alphabet, n, prefix, halves=False):
    r = random.Random(f"{alphabet}{n}{prefix}{halves}")
    out = []
    while len(out) < N:
        t = prefix + "".join(r.choices(alphabet, k=n)) + ("-" + "".join(r.choices(alphabet, k=n)) if halves else "")
        # the scan's candidates have a digit and a letter
        if re.search("[0-9]", t) and re.search("[A-Za-z]", t):
            out.append(t)
    return out


def share_found(spark, groups):
    rows = [(f"{k}|{i}", f"see {t} there") for k, ts in groups.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(8)
    found = dict.fromkeys(groups, 0)
    for r in S.secret_spans(df).collect():
        found[r.doc_id.split("|")[0]] += bool(r.spans)
    return {k: n / N for k, n in found.items()}


@pytest.mark.parametrize("n", [20, 24, 32, 40])
def test_random_tokens_of_each_class_and_length_are_found(spark, n):
    found = share_found(spark, {f"{k} {p}": tokens(a, n, p) for k, a in ALPHABETS.items() for p in PREFIXES})
    assert {k: v for k, v in found.items() if v < 0.97} == {}


def test_hex_parts_behind_a_prefix_are_found(spark):
    hexes = ALPHABETS["hex"]
    found = share_found(spark, {f"{n} {p}": tokens(hexes, n, p, halves=True) for n in (10, 12, 15)
                                for p in ("k_", "key-", "sk-live_", "api03-")})
    assert {k: v for k, v in found.items() if v < 0.97} == {}


def test_names_keep_their_thresholds():
    names = ["how-to-cook-rice-in-2020-guide", "converting-mp3-to-mp4-files", "Users/John/Documents/file2",
             "release_notes_for_version_12_final", "the-quick-brown-fox-jumps-12", "getElementByIdFromCache2"]
    for x in names:
        assert next(c for c, p, _ in S.CLASSES if re.search(p, x)) in ("alnum", "base64"), x
