import random
from collections import defaultdict

import pytest

from helpers import documents
from parcelrisk.llm import packing as P
from parcelrisk.llm.queries import WORD_BPE, tokenizer_file


def plain_plan(lengths, capacities, least):
    """Best fit by looking at every bin."""
    left, bins, where = sum(lengths), [], []
    for n in lengths:
        fit = [(room, b) for b, (room, _) in enumerate(bins) if room >= n]
        if fit:
            _, b = min(fit)
        else:
            c = min((c for c in capacities if c >= max(n, least)),
                    key=lambda c: (P.sequence_cost(c) / min(c, left), c))
            bins.append((c, 0))
            b = len(bins) - 1
        bins[b] = (bins[b][0] - n, bins[b][1] + n)
        where.append(b)
        left -= n
    final = [min(c for c in capacities if c >= u) for _, u in bins]
    return sum(map(P.sequence_cost, final)), where, [u for _, u in bins], final


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_plain_version(seed):
    rng = random.Random(seed)
    caps = (8, 16, 40)
    lengths = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 150))), reverse=True)
    best = min((plain_plan(lengths, caps, c) for c in caps), key=lambda x: x[0])
    assert P.best_fit(lengths, caps) == best[1:]


def check(rows, lengths, caps):
    """Every token of every document in one place, no bin too full or too large."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for i, n in lengths.items():
        at = 0
        for start, length in sorted(docs[i]):
            assert start == at and length <= max(caps)
            at += length
        assert at == (n or 0)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_used for r in rs} == {at}
        assert {r.capacity for r in rs} == {min(c for c in caps if c >= at)}
    return bins


@pytest.mark.parametrize("shard", [50_000, 40])
def test_all_pieces_are_placed(spark, shard):
    rng = random.Random(9)
    lengths = {i: rng.choice([1, 5, 30, 64, 100, 129, 1000]) for i in range(300)} | {900: 0, 901: None}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long").selectExpr(
        "*", "1 as shard", "2 as place", "3 as bin_id")
    caps = (16, 32, 64)
    rows = P.pack_lengths(df, capacities=caps, shard_pieces=shard).collect()
    bins = check(rows, lengths, caps)
    full = sum(n or 0 for n in lengths.values())
    assert full / sum(rs[0].capacity for rs in bins.values()) > 0.95


def test_documents_nulls_repeats_and_empty(spark):
    path = tokenizer_file(WORD_BPE)
    df = documents(spark, ["a b c", None, "", "word " * 900, "a b c", "a b c"], [1, 2, 3, 4, None, None])
    rows = P.pack_documents(df, path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length) for r in rows) == [
        (False, 1, 0, 4), (False, 2, 0, 1), (False, 3, 0, 1), (False, 4, 0, 901),
        (True, 0, 0, 4), (True, 0, 0, 4)]
    assert len({(r.bin_id, r.bin_offset) for r in rows}) == len(rows)
    assert P.pack_documents(documents(spark, []), path).count() == 0


def test_the_plan_does_not_depend_on_the_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(60) if i % 7 else None, rng.randrange(1, 3000)) for i in range(400)]
    rows += [(5, 700)] * 90 + [(None, 9000)] * 5
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    plans = [sorted(map(str, P.pack_lengths(df.repartition(n), shard_pieces=60).collect())) for n in (1, 3, 7)]
    assert plans[0] == plans[1] == plans[2] and len(plans[0]) >= 495
