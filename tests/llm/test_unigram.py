import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from helpers import documents, sample_texts
from parcelrisk.llm import unigram as U
from parcelrisk.llm.queries import PIECES, tokenizer_file

CASES = [None, "", " ", "  ", "a", " a", "a ", "a  b", "▁a▁ b", "Hello world", "é😀\n\tx", "<s> <0x0A>",
         "\ufeff\x00\x00a", "x" * 700, "the " * 50 + "Straße", "😀" * 300, "日本語 テスト"]


def reference(vocab, unk_id, byte_fallback):
    t = Tokenizer(models.Unigram(vocab, unk_id, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def public_vocab():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


def test_public_vocabulary(spark):
    vocab, unk = public_vocab()
    count = reference(vocab, unk, True)
    texts = CASES + [t for _, t in sample_texts(spark)[:50]]
    got, _ = U.count_texts(U.load(tokenizer_file(PIECES)), texts)
    for t, n in zip(texts, got):
        assert n == count(t), t


@pytest.mark.parametrize("seed,fallback", [(s, f) for s in range(8) for f in (True, False)])
def test_ties_and_unknowns_of_random_vocabularies(seed, fallback):
    """Few different scores, so that many paths tie."""
    rng = random.Random(seed)
    letters = "abc▁é"
    pieces = {"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(40)}
    vocab = [("<unk>", 0.0)] + [(p, -float(rng.randint(1, 3))) for p in sorted(pieces)]
    if fallback:
        vocab += [(f"<0x{i:02X}>", -5.0) for i in range(256)]
    model = U.Unigram(vocab, 0, fallback)
    count = reference(vocab, 0, fallback)
    texts = ["".join(rng.choices("abc é z", k=rng.randint(1, 60))) for _ in range(120)]
    texts += ["".join(rng.choices("abcz", k=230)) for _ in range(5)]     # one by one
    got, _ = U.count_texts(model, texts)
    assert got.tolist() == [count(t) for t in texts]


def test_batch_and_single_search_agree():
    model = U.load(tokenizer_file(PIECES))
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choices("theéxz😀", k=rng.randint(0, 30))) for _ in range(400)]
    n, s = model.count_words(words)
    one = [model.count_one(w) for w in words]
    assert n.tolist() == [x[0] for x in one] and s.tolist() == [x[1] for x in one]


def test_long_word_in_bounded_memory():
    model = U.load(tokenizer_file(PIECES))
    word = "▁" + "ab" * 6000
    vocab, unk = public_vocab()
    assert model.count_one(word)[0] == reference(vocab, unk, True)(word)


def test_rows(spark):
    df = documents(spark, CASES, [None] * 3 + list(range(len(CASES) - 3))).selectExpr(
        "*", "1 as n_tokens", "2 as SCORE")
    got = U.unigram_token_counts(df, tokenizer_file(PIECES))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "score"]
    want, _ = U.count_texts(U.load(tokenizer_file(PIECES)), CASES)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(want.tolist())
    assert U.unigram_token_counts(documents(spark, []), tokenizer_file(PIECES)).count() == 0
    assert np.isfinite(got.agg({"score": "sum"}).first()[0])
