import hashlib
import itertools
import random
import re
import zlib

import pytest

from helpers import SF_SMALL
from parcelrisk.llm import conversation as C
from parcelrisk.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (role, text)]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        role, text = said
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """All edit sequences, by dynamic programming over (row, roles so far):
    the least (cost, audit, repaired rows)."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    made = {"u": "user", "a": "assistant"}
    memo = {}

    def best(i, state, inserted):
        if (i, state, inserted) in memo:
            return memo[i, state, inserted]
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for r in moves[state]:
                if r != "s":
                    c, a, out = best(i, r, inserted + 1)
                    found.append((c + 5, "I" + a, ((made[r], ""),) + out))
        if i < len(rows):
            role, text = rows[i]
            c, a, out = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, out))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 if fault[i] == "truncated" else 0
                if role[:1] in moves[state]:
                    c, a, out = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, ((role, text),) + out))
                for r in moves[state]:
                    if r != "s":
                        c, a, out = best(i + 1, r, 0)
                        found.append((c + 1 + more, "R" + a, ((made[r], text),) + out))
        memo[i, state, inserted] = min(found, default=(10**9, "", ()))
        return memo[i, state, inserted]

    return best(0, "", 0)


def plain_report(rows, convs):
    out = set()
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        said = [(r[2], r[3]) for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        fault = faults(said)
        pairs = zip([r[:1] for r, _ in said], [r[:1] for r, _ in said[1:]])
        cost, audit, repaired = cheapest(said, fault)
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                 *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
                 sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                 hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return out


def invented(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ask"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role,
                         rng.choice(["Yes.", "No", " \n", "", None, "Who?", f"Turn {turn}. ", "x\x0b"])))
    return rows


def test_graph_equals_every_edit_sequence():
    letters = "sua0x1SUAX"
    words = ["".join(w) for k in range(4) for w in itertools.product(letters, repeat=k)]
    rng = random.Random(2)
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(4, 14))) for _ in range(300)]
    graph = C.SuffixGraph()
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for w in sorted(set(words), key=lambda w: w[::-1]):
        fault = ["blank" if c in "0123" else "truncated" if c.isupper() else "" for c in w]
        rows = [(roles[C._INITIAL[c]], str(k)) for k, c in enumerate(w)]
        cost, audit, repaired = cheapest(rows, fault)
        got = graph.add(w)
        assert got[:2] == (cost, audit), w
        assert tuple((r, t) for _, r, t in C.edited(audit, iter(rows))) == repaired


def test_report_equals_plain_version(spark):
    rows = invented(1, 150)
    got = C.repair_report(spark.createDataFrame(rows, ROWS))
    assert {tuple(r) for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                                         "audit", "repaired_sha256").collect()} == plain_report(
        [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows],
        {r[0] for r in rows})


@pytest.mark.parametrize("source", ["given", "invented"])
def test_query_equals_plain_version(spark, tmp_path, source):
    if source == "given":
        rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()]
    else:
        rows = invented(7, 60) + [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi"), (900, 0, "user", "x.")]
        rows += rows[:40]                                                # repeated rows
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == plain_report(plain_damage(rows), {r[0] for r in rows})


def test_repaired_rows_are_legal_and_whole(spark):
    rows = spark.createDataFrame(invented(5, 80), ROWS)
    by = {}
    for r in C.repaired_rows(rows).orderBy("conv_id", "place").collect():
        by.setdefault(r["conv_id"], []).append(r)
    for conv in by.values():
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in conv))
        assert [r["place"] for r in conv] == list(range(len(conv)))


def test_long_conversation_and_edge_cases(spark):
    long = [(1, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(20_001)]
    got = C.repair_report(spark.createDataFrame(long, ROWS)).collect()
    # the leading assistant goes, the rest alternates
    assert got[0]["audit"] == "D" + "K" * 20_000 and got[0]["cost"] == 2 and got[0]["illegal"] == 0
    empty = spark.createDataFrame([], ROWS)
    assert C.repair_report(empty).collect() == [] and C.repaired_rows(empty).collect() == []
    clash = spark.createDataFrame([(1, 0, "user", "Hi.", 3), (1, 1, "assistant", "Yes.", 4)],
                                  "conv string, turn int, letter string, said string, copies int")
    got = C.repair_report(clash, "conv", "turn", "letter", "said").collect()
    assert got[0]["conv"] == "1" and got[0]["audit"] == "KK"
