import random

from helpers import ascii_lower, documents, sample_texts
from parcelrisk.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=20, min_docs=3):
    """doc rows -> [(id, n_lines, n_dropped, kept)] for unique or repeated ids."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = ascii_lower(line.strip(WS))
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            h = holders.get(ascii_lower(line.strip(WS)), ())
            last = max((x for x in h if x is not None), default=None)
            if len(h) >= min_docs and (i is None or i < last):
                continue
            kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def check(spark, rows):
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept)
           for r in L.line_keep_bitmaps(df, with_text=True).collect()]
    assert order(got) == order(plain(rows))
    for r in L.line_keep_bitmaps(df).collect():
        assert sum(x.length for x in r.keep_runs) == r.n_lines - r.n_dropped
    applied = L.drop_repeated_lines(df)
    assert applied.columns == df.columns
    want = [(i, t if not d else k) for (i, t), (_, _, d, k) in zip(rows, plain(rows))]
    assert order([(r.doc_id, r.text or "") for r in applied.collect()]) == order(
        [(i, t or "") for i, t in want])


def test_cases(spark):
    shared = "this line is shared by several documents"
    edge = "exactly twenty chars"
    assert len(edge) == 20
    check(spark, [
        (1, f"{shared}\nown one\n  {shared.upper()}\t\n"), (2, f"x\n{shared}\r"),
        (3, f"{shared}\n{shared}"), (4, None), (5, ""), (6, "\n\n"), (7, edge), (8, edge + "\x0b"),
        (9, f"{edge}\ntail"), (10, edge[:-1]), (11, edge[:-1]), (12, edge[:-1]),
        (13, "É" * 20), (14, "é" * 20), (15, "É" * 20), (16, "É" * 20),
        (17, "only two documents hold this line"), (18, "only two documents hold this line"),
        (18, "a second text of one id"), (17, f"{edge}\nonly two documents hold this line"),
        (None, f"{shared}\nnull id"), (None, shared), (None, shared), (2, f"x\n{shared}\r")])


def test_random_tables(spark):
    rng = random.Random(3)
    pool = [f"{'w' * rng.randint(10, 30)} {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    check(spark, rows)


def test_hot_line_and_long_document(spark):
    hot = "a line that a third of all documents hold"
    rows = [(i, f"{hot}\nown text of document number {i}" if i % 3 == 0 else f"document {i}")
            for i in range(300)]
    rows.append((300, "\n".join([hot, "filler line number one hundred"] * 3000)))
    check(spark, rows)


def test_whole_small_table(spark):
    rows = sample_texts(spark)
    check(spark, rows)
    assert any(d for _, _, d, _ in plain(rows)) or rows


def test_empty_and_clashing_names(spark):
    assert L.line_keep_bitmaps(documents(spark, [])).count() == 0
    df = documents(spark, ["x\ny"] * 2).selectExpr("*", "1 as doc", "2 as place", "3 as __l_runs", "4 as h1")
    assert sorted(map(tuple, L.drop_repeated_lines(df).collect())) == sorted(map(tuple, df.collect()))


