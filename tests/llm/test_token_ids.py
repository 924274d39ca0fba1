import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import SF_SMALL, documents, sample_texts
from parcelrisk.llm import token_ids as K
from parcelrisk.llm.queries import QUERIES, WORD_BPE, tokenizer_file

PATH = tokenizer_file(WORD_BPE)

CASES = [None, "", " \n", "One", "It's the 42nd ÉTÉ…", "e\u0301 \u0301x", "a<|endoftext|>b <| x",
         "<|startoftext|>", "tab\tvt\x0bff\x0cnel\x85nbsp\u00a0ls\u2028end", "ΣΑΣ İstanbul ß ﬁ",
         "😀😀 x" * 50, "x" * 3000, "\ufeffbom", "  lead  and trail  ", "\x1c\x1d a\x00b"]


def plain(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_byte_coding_round_trip(n):
    rng = np.random.default_rng(n)
    v = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    v[:4] = np.array([0, 255, 256, 2**32 - 1])[:min(n, 4)]
    control, data = K.pack_bytes(v)
    assert len(control) == -(-n // 4)
    assert (K.unpack_bytes(control, data, n) == v).all()


def test_words_are_encoded_as_whole_texts(monkeypatch):
    t = Tokenizer.from_file(PATH)
    for size in (8 << 20, 40):
        monkeypatch.setattr(K, "_CHUNK", size)
        got = {}
        for rows, lengths, ids in K.encode_texts(K.load(PATH), CASES):
            for row, part in zip(rows, np.split(ids, np.cumsum(lengths)[:-1])):
                got.setdefault(int(row), []).extend(part.tolist())
        for i, text in enumerate(CASES):
            assert got.get(i, []) == t.encode(text or "", add_special_tokens=False).ids, text


def test_files_round_trip(spark, tmp_path, monkeypatch):
    rows = [(i * 7 % 101, t) for i, t in enumerate(CASES * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as part")
    K.write_token_files(df.repartition(5), f"{tmp_path}/f", PATH, 2)
    got = K.read_token_files(spark, f"{tmp_path}/f")
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids)))
                  for r in got.collect()) == plain(rows)
    # the files themselves are in order
    seen = [i for r in spark.read.parquet(f"{tmp_path}/f/ids").orderBy("part", "block").collect()
            for i in r.doc_ids]
    assert seen == sorted(seen)
    assert K.token_counts(df, PATH, extra=1).columns == ["doc_id", "ids", "part", "n_tokens"]


def test_ranks_follow_frequency(spark, tmp_path):
    K.write_token_files(documents(spark, ["b b b a a c", "a"]), f"{tmp_path}/f", PATH, 2)
    ranks = {r.token: r["rank"] for r in spark.read.parquet(f"{tmp_path}/f/ranks").collect()}
    t = Tokenizer.from_file(PATH)
    a, b, c = (t.encode(x).ids[0] for x in "abc")
    assert (ranks[min(a, b)], ranks[max(a, b)], ranks[2], ranks[c]) == (0, 1, 2, 3)


def test_nulls_repeats_and_empty(spark, tmp_path):
    df = documents(spark, ["x y", "x y", None, "z"], [None, None, 3, 3])
    K.write_token_files(df, f"{tmp_path}/f", PATH, 2)
    rows = K.read_token_files(spark, f"{tmp_path}/f").collect()
    assert sorted((r.start, r.doc_id is None) for r in rows)[:2] == [(0, True), (3, True)]
    assert sum(r.n_tokens for r in rows) == 3 + 3 + 1 + 2
    K.write_token_files(documents(spark, []), f"{tmp_path}/g", PATH, 2)
    assert K.read_token_files(spark, f"{tmp_path}/g").count() == 0


def test_query_equals_plain_version(spark):
    got = QUERIES["op6_token_ids"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == plain(sample_texts(spark))


def test_stores_trim_to_the_texts_seen_most(monkeypatch):
    t = K.WordTokenizer(PATH)
    monkeypatch.setattr(K.WordTokenizer, "WORDS", 30)
    monkeypatch.setattr(K.WordTokenizer, "PIECES", 30)
    whole = Tokenizer.from_file(PATH)
    for r in range(12):
        words = [f"word{r}x{i}," for i in range(25)] + ["the", "often", "é%%%"]
        n, ids = t.encode_words(words)
        got = np.split(ids, np.cumsum(n)[:-1])
        assert [x.tolist() for x in got] == [
            whole.encode(w, add_special_tokens=False).ids for w in words]
    assert "the" in t.words.index and len(t.words.index) <= 30 + 28


def test_words_of_several_chunks_are_encoded_once(monkeypatch):
    seen = []
    encode = K.WordTokenizer._encode_words
    monkeypatch.setattr(K.WordTokenizer, "_encode_words",
                        lambda self, words: seen.extend(map(str, words)) or encode(self, words))
    monkeypatch.setattr(K.WordTokenizer, "WORDS", 5)
    monkeypatch.setattr(K.WordTokenizer, "PIECES", 5)
    monkeypatch.setattr(K, "_CHUNK", 200)
    words = [f"Éa{i}b, <|{i} 漢" for i in range(20)]
    texts = [" ".join(words[i % 3::3]) for i in range(6)]
    t, whole = K.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    got = {}
    for rows, lengths, ids in K.encode_texts(t, texts):
        for row, part in zip(rows, np.split(ids, np.cumsum(lengths)[:-1])):
            got.setdefault(int(row), []).extend(part.tolist())
    assert [got[i] for i in range(6)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(seen) == len(set(seen)) == 41
