"""Conversation repair: the cheapest edits that give each conversation a legal
order of roles, ``(system? (user assistant)+)?``.

Faults of a row, the first one counts: blank (no visible character), duplicate
(role and text stood earlier in the conversation), truncated (the last visible
character ends no sentence).  Edits: keep a row (K, 0), give it the role user
or assistant (R, 1), delete it (D, 2; a must for blank and duplicate rows),
insert an empty row of user or assistant (I, 5); a truncated row that stays
costs 5 more.  Of equally cheap edits the ASCII-least sequence is taken.

1. Equal rows are counted, and each (conversation, role, text) gets its first
   turn, so a row knows whether it is a duplicate.
2. Rows stream in the order of conversation and turn; a conversation becomes its
   signature, one letter of role initial and fault per row.
3. The different signatures form a word graph that shares suffixes: dealt by
   ranges of their reversed letters and sorted, they are read from the end, and
   a node (a letter and the node after it) is made once per range.  As the input
   is sorted, no later signature can meet the nodes that leave the current path,
   so these are closed and only the path is held.  A node has, per grammar state,
   the cost to go and the first edit of the best audit suffix.
4. The audits are joined to the conversations by signature and applied to the
   rows in a second stream.

Edge cases: a null role or text is one space, so the text is blank and the role
fits nowhere, as an empty role does; rows without a turn come first; rows of
one turn follow each other by role, then text; all rows without a conversation
form one.  Input columns other than the four named are not read.  An empty
table gives an empty result.  A conversation is hashed in order, thus by one
task; that holds one letter per row and otherwise streams.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, col, fresh, written

# The grammar over role initials.  States: 0 nothing yet, 1 after
# s, 2 after u, 3 after a; 0 and 3 may end.  ``_KEEP[state][initial]`` is the
# next state, ``_NEXT[state]`` that after a row of the one role that may be made
# there: user, or assistant in state 2.
_KEEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_NEXT = [2, 2, 3, 2]
_MADE = ["user", "user", "assistant", "user"]
_LEGAL = {"su", "ua", "au"}
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5
_FAR = 1 << 60

# Letters of a signature: role initial s, u, a or x (any other), as it is, in
# capitals when truncated, and as a digit when the row has to go.
_GONE = {"s": "0", "u": "1", "a": "2", "x": "3"}
_INITIAL = {**{k: k for k in "suax"}, **{k.upper(): k for k in "suax"},
            **{v: k for k, v in _GONE.items()}}


class SuffixGraph:
    """The word graph's current path, from the end of a signature to its start.

    Signatures come in ascending order of their reversed letters."""

    def __init__(self):
        self.letters = ""                            # reversed
        self.cost = array("q", [0, 2 * INSERT, INSERT, 0])
        self.edit = array("b", b" II ")
        self.illegal = array("q", [0])

    def add(self, signature: str) -> tuple[int, str, int]:
        """(cost, audit, illegal neighbours) of a signature."""
        word = signature[::-1]
        shared = _common(self.letters, word)
        del self.cost[4 * shared + 4:], self.edit[4 * shared + 4:], self.illegal[shared + 1:]
        for k in range(shared, len(word)):
            self._node(word[k], word[k - 1] if k else "")
        self.letters = word
        return self.cost[-4], self._audit(), self.illegal[-1]

    def _node(self, letter: str, after: str) -> None:
        initial = _INITIAL[letter]
        stays, extra = letter not in "0123", CUT if letter in "SUAX" else 0
        to_go = self.cost[-4:]
        own, edit = [0] * 4, [0] * 4
        for state in range(4):
            best, op = to_go[state] + DELETE, 68                           # D
            if stays:
                kept = _KEEP[state].get(initial)
                if kept is not None and to_go[kept] + extra < best:
                    best, op = to_go[kept] + extra, 75                     # K
                if (n := to_go[_NEXT[state]] + extra + RENAME) < best:
                    best, op = n, 82                                       # R
            own[state], edit[state] = best, op
        two, three = own[2], own[3]
        self._insert(own, edit, 2, three)
        self._insert(own, edit, 3, two)
        self._insert(own, edit, 0, own[2])
        self._insert(own, edit, 1, own[2])
        self.cost.extend(own)
        self.edit.extend(edit)
        pair = initial + _INITIAL[after] if after else "su"
        self.illegal.append(self.illegal[-1] + (pair not in _LEGAL))

    @staticmethod
    def _insert(own: list[int], edit: list[int], state: int, then: int) -> None:
        n = then + INSERT
        if n < own[state] or n == own[state] and edit[state] > 73:        # I
            own[state], edit[state] = n, 73

    def _audit(self) -> str:
        out, state, k = bytearray(), 0, len(self.letters)
        while True:
            op = self.edit[4 * k + state]
            if op == 32:
                return out.decode()
            out.append(op)
            if op == 75:
                state = _KEEP[state][_INITIAL[self.letters[k - 1]]]
            elif op != 68:
                state = _NEXT[state]
            if op != 73:
                k -= 1


def _common(a: str, b: str) -> int:
    """The length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies, first, letter): equal rows once."""
    src = rows.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"),
                      F.coalesce(col(role).cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(col(text).cast("string"), F.lit(" ")).alias("text"))
    src = src.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = src.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"),
                        F.col("text").alias("t")).agg(F.min(at).alias("first"))
    on = src["conv"].eqNullSafe(first["c"]) & (src["role"] == first["r"]) & (src["text"] == first["t"])
    body = F.btrim("text", F.lit(WHITE))
    return src.join(first, on).select(
        "conv", "turn", "role", "text", "copies", (at == F.col("first")).alias("first"),
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1))
        .otherwise("x").alias("initial"))


_COUNTS = ["gaps", "blank", "duplicate", "truncated"]


def _signatures(prepared: DataFrame) -> DataFrame:
    """(conv, the counts of faults, gaps, signature): one row per conversation."""
    conv_type = prepared.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", conv_type)]
                          + [T.StructField(c, T.LongType()) for c in _COUNTS]
                          + [T.StructField("signature", T.StringType())])
    names = ["turn", "copies", "first", "blank", "cut", "initial"]

    def run(batches):
        key, open_ = None, False
        letters: list[str] = []
        low = high = None
        turns = blank = duplicate = truncated = 0

        def close():
            gaps = 0 if low is None else high - low + 1 - turns
            return [key, gaps, blank, duplicate, truncated, "".join(letters)]

        for b in batches:
            out = []
            at = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ["conv", *names]}
            for conv, turn, copies, first, empty, cut, initial in zip(at["conv"], *(at[n] for n in names)):
                if not open_ or conv != key:
                    if open_:
                        out.append(close())
                    key, open_, letters = conv, True, []
                    low = high = None
                    turns = blank = duplicate = truncated = 0
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                gone = copies
                if empty:
                    blank += copies
                elif not first:
                    duplicate += copies
                else:
                    gone -= 1
                    duplicate += gone
                    truncated += cut
                    letters.append(initial.upper() if cut else initial)
                letters.append(_GONE[initial] * gone)
            if out:
                yield _batch(out, schema)
        if open_:
            yield _batch([close()], schema)

    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    dealt = prepared.repartition("conv").sortWithinPartitions(*order)
    return dealt.select("conv", *names).mapInArrow(run, schema)


def _batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows],
                                      to_arrow_schema(schema))


def signature_audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit, illegal) of the different signatures."""
    schema = T.StructType([T.StructField("signature", T.StringType()),
                           T.StructField("cost", T.LongType()),
                           T.StructField("audit", T.StringType()),
                           T.StructField("illegal", T.LongType())])

    def run(batches):
        graph = SuffixGraph()
        for b in batches:
            if b.num_rows:
                out = []
                for s in b.column(0).to_pylist():
                    cost, audit, illegal = graph.add(s)
                    out.append([s, cost, audit, illegal])
                yield _batch(out, schema)

    back = F.reverse("signature")
    dealt = signatures.select("signature").distinct().repartitionByRange(back)
    return dealt.sortWithinPartitions(back).mapInArrow(run, schema)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows."""
    state = at = 0

    def inserts():
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            yield "I", _MADE[state], ""
            state, at = _NEXT[state], at + 1

    for role, text in rows:
        yield from inserts()
        op, at = audit[at], at + 1
        if op == "K":
            state = _KEEP[state][role[0]]
            yield op, role, text
        elif op == "R":
            yield op, _MADE[state], text
            state = _NEXT[state]
    yield from inserts()


def _plan(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Per conversation a row with its report (tag 0), then its rows (tag 1)."""
    ready = written(_prepared(rows, conv, turn, role, text), "conversation-ready")
    signed = written(_signatures(ready), "conversation-signatures")
    report = signed.join(signature_audits(signed), "signature").select(
        "conv", *_COUNTS, "illegal", "cost", "audit")
    tagged = report.withColumn("tag", F.lit(0)).unionByName(
        ready.select("conv", "turn", "role", "text", "copies").withColumn("tag", F.lit(1)),
        allowMissingColumns=True)
    order = ["conv", "tag", F.asc_nulls_first("turn"), "role", "text"]
    return tagged.repartition("conv").sortWithinPartitions(*order)


_REPORT = [*_COUNTS, "illegal", "cost"]


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``gaps`` (turn numbers missing between the
    first and the last), the counts ``blank``, ``duplicate``, ``truncated`` and
    ``illegal`` (neighbours that the grammar forbids), ``cost`` and ``audit`` of
    the cheapest edits, and ``repaired_sha256`` of the repaired ``role:text``
    lines."""
    plan = _plan(rows, conv_col, turn_col, role_col, text_col)
    schema = T.StructType([plan.schema["conv"]] + [T.StructField(c, T.LongType()) for c in _REPORT]
                          + [T.StructField("audit", T.StringType()),
                             T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        out = []
        for head, members in _conversations(batches):
            digest, some = hashlib.sha256(), False
            for _, role, text in edited(head["audit"], members):
                digest.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode())
                some = True
            out.append([head["conv"], *(head[c] for c in _REPORT), head["audit"],
                        digest.hexdigest()])
            if len(out) == 1024:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return plan.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of the repaired conversations: conversation, ``place`` (from 0),
    ``edit`` (K, R or I), role and text."""
    plan = _plan(rows, conv_col, turn_col, role_col, text_col)
    schema = T.StructType([plan.schema["conv"], T.StructField("place", T.LongType()),
                           T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType())])

    def run(batches):
        out = []
        for head, members in _conversations(batches):
            for place, (edit, role, text) in enumerate(edited(head["audit"], members)):
                out.append([head["conv"], place, edit, role, text])
                if len(out) == 1024:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return plan.mapInArrow(run, schema).withColumnsRenamed(
        {"conv": conv_col, "role": role_col, "text": text_col})


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator]]:
    """(report row, its rows one by one) in the order of the stream; the rows
    have to be read before the next conversation."""
    def flat():
        for b in batches:
            for s in range(0, b.num_rows, 512):
                yield from b.slice(s, 512).to_pylist()

    stream = flat()
    ahead = next(stream, None)

    def members():
        nonlocal ahead
        ahead = next(stream, None)
        while ahead is not None and ahead["tag"]:
            for _ in range(ahead["copies"]):
                yield ahead["role"], ahead["text"]
            ahead = next(stream, None)

    while ahead is not None:
        own = members()
        yield ahead, own
        for _ in own:
            pass


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` with known faults by the CRC-32 of ``conversation:turn`` mod 20 (null
    as one space): 0 drops a row, 1 empties the text, 2 removes its ``[.!?]``,
    3 repeats it, 4 makes the role user."""
    kind = fresh(rows, "__c_kind")
    def said(c: str):
        return F.coalesce(col(c).cast("string"), F.lit(" "))
    text = said(text_col)
    out = rows.withColumn(kind, F.crc32(F.concat(
        said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20)
    out = out.filter(col(kind) != 0)
    out = out.withColumn(role_col, F.when(col(kind) == 4, "user").otherwise(said(role_col)))
    out = out.withColumn(text_col, F.when(col(kind) == 1, "").when(
        col(kind) == 2, F.translate(text, ".!?", "")).otherwise(text))
    copies = F.when(col(kind) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn(kind, F.explode(copies)).drop(kind)
