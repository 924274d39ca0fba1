"""Every stage and the whole pipeline against the plain versions."""
import re

import pytest

import corpus_pipeline
import test_decontaminate
import test_line_dedup
import test_quality
import test_simhash
from helpers import SF_SMALL, documents
from parcelrisk.llm import packing, quality
from parcelrisk.llm.common import table
from parcelrisk.llm.queries import WORD_BPE, tokenizer_file
from tokenizers import Tokenizer


def plain_quality(docs, langs):
    stops = {w for ws in quality.STOP_WORDS.values() for w in ws}
    out = {}
    for i, t in docs.items():
        n, chars, symbols, dup, repeat = test_quality.plain(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        words = {w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)}
        listed = re.match("[A-Za-z]*", langs[i] or "")[0].lower() in quality.STOP_WORDS
        if n >= 50 and repeat <= 0.5 * n and 2 <= chars / n <= 20 and symbols / n <= 0.1 \
                and (len(words & stops) >= 2 or not listed) and dup / len(lines) <= 0.5:
            out[i] = t
    return out


def plain_lines(docs):
    rows = test_line_dedup.plain(list(docs.items()))
    return {i: (k if d else docs[i]) for i, _, d, k in rows}


def plain_simhash(docs):
    fp = {i: test_simhash.plain_fingerprint(t, 3) for i, t in docs.items()}
    least = test_simhash.components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    return {i: t for i, t in docs.items() if least[i] == i}


def plain_decontaminate(docs, items):
    out = {}
    for i, t in docs.items():
        n, hit, _ = test_decontaminate.plain(t, items)
        if len(hit) > 0.5 * n:
            continue
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        keep = [True] * len(t)
        for w in hit:
            end = spans[w + 1][0] if w + 1 in hit else spans[w][1]
            keep[spans[w][0]:end] = [False] * (end - spans[w][0])
        out[i] = "".join(c for c, k in zip(t, keep) if k)
    return out


def stages(spark):
    rows = table(spark, SF_SMALL, "documents").collect()
    docs, langs = ({r.doc_id: r[c] for r in rows} for c in ("text", "lang"))
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    yield docs
    for f in (lambda d: plain_quality(d, langs), plain_lines, plain_simhash, lambda d: plain_decontaminate(d, items)):
        docs = f(docs)
        yield docs


def test_each_stage_and_the_whole(spark):
    want = list(stages(spark))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_dedup", "decontamination", "best_fit_packing"]
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    for (name, stage), texts in zip(corpus_pipeline.STAGES[:-1], want[1:]):
        docs = stage(spark, docs, SF_SMALL).checkpoint()
        assert docs.columns == columns
        got = {r.doc_id: r for r in docs.collect()}
        assert {i: r.text for i, r in got.items()} == texts, name
        if name != "quality_rules":
            assert all(r.n_chars == len(r.text) for r in got.values())
    last = want[-1]
    t = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    top = packing.CAPACITIES[-1]
    pieces = []
    for i, text in last.items():
        n = len(t.encode(text, add_special_tokens=False).ids) + 1
        pieces += [(min(top, n - s), i, s) for s in range(0, n, top)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    where, used, final = packing.best_fit([p[0] for p in pieces], packing.CAPACITIES)
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.start, r.length, r.bin_id, r.bin_used, r.capacity) for r in rows) == sorted(
        (i, s, n, b, used[b], final[b]) for (n, i, s), b in zip(pieces, where))


@pytest.mark.parametrize("texts,ids", [([], []), ([None, "", None], [1, None, None])])
def test_empty_and_null_documents(spark, texts, ids):
    docs = documents(spark, texts, ids)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() == (1 if texts else 0)
    assert corpus_pipeline.STAGES[0][1](spark, documents(spark, texts, ids), SF_SMALL).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF_SMALL).count() == (1 if texts else 0)
