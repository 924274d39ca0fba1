"""Secret scan: fixed patterns, and windows of high Shannon entropy.

Candidates are runs of 20 or more token characters, with a digit and a letter,
that lie in what the base patterns leave of the text.  A window slides over a
candidate; when a character enters and one leaves, only these two counts
change the entropy sum, so a step costs no recount.  The threshold depends on
the candidate's character class (the alphabet between its separators, and
whether letters and digits are mixed or stand apart as in names), and candidates on the allow list are passed
over.  All of it is built-in functions within one row: no user function and no
shuffle, and texts without a match skip the work.

Edge cases: a null or empty text has no spans.  Rows are scanned one by one,
so null ids, repeated rows and ties need no rule; positions count code points.
Spans of different kinds may overlap and are all reported.  Input columns
other than id and text are not read, so their names cannot clash.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

# The base patterns, in the order of their kinds.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"      # a run of 18 characters or more
HEX = r"[0-9a-f]{16,}"             # a maximal run of 16 characters or more
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGNED = 12

_RUN = r"[A-Za-z0-9+/_=-]"
CANDIDATE = (rf"(?<!{_RUN})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){_RUN}{{20,}}")

_SEP = "+/_=-"
#: Letters and digits mixed as in random characters: a letter after a digit, and
#: two changes between letters and digits or from lower to upper case.
_MIXED = (r"^(?=.*[0-9][A-Za-z])"
          r"(?=(?:.*?(?:[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z]))){2})")
#: Up to three short names, each with a separator, before the characters judged.
_PREFIX = rf"(?:[A-Za-z][A-Za-z0-9]{{0,7}}[{_SEP}]){{0,3}}"

#: Character class -> (pattern of the whole candidate, least entropy in bits of
#: a window), first match wins.  The first three are mixed characters of one
#: alphabet between separators; about one in a hundred windows of random
#: characters of that alphabet has less entropy.  (One in a hundred windows has
#: less than 2.90 bits of 16 symbols, 3.41 of 36, 3.65 of 62 or 64.)
CLASSES = (
    ("hex parts", rf"{_MIXED}{_PREFIX}(?:[0-9a-f{_SEP}]+|[0-9A-F{_SEP}]+)$", 2.9),
    ("one case", rf"{_MIXED}{_PREFIX}(?:[a-z0-9{_SEP}]+|[A-Z0-9{_SEP}]+)$", 3.4),
    ("two cases", rf"{_MIXED}", 3.6),
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^.+$", 3.9),
)
#: Candidates that match one of these are no secrets.
ALLOW = (
    r"(?i)example|sample|placeholder|xxxx|dummy",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]?[0-9]{1,4}$",
    r"^[0-9]+([-_/+][0-9]+)*[A-Za-z]?$",
)
WINDOW = 20
_UNIT = 1 << 20      # sums of c * log2(c) are kept as whole numbers of 2**-20


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _running_sums(a: Column, block: int = 512) -> Column:
    """Inclusive running sums of an array of ints; blocks keep very long
    arrays from costing the square of their length."""
    def within(i):
        return (i / block).cast("int")

    last = within(F.size(a) - 1)
    totals = F.transform(F.sequence(F.lit(0), last),
                         lambda b: _sum(F.slice(a, b * block + 1, F.lit(block))))
    before = _let(totals, lambda t: F.transform(
        F.sequence(F.lit(0), last), lambda b: _sum(F.slice(t, F.lit(1), b))))
    sums = _let(before, lambda p: F.transform(a, lambda _, i: F.get(p, within(i)) + _sum(
        F.slice(a, within(i) * block + 1, i % block + 1))))
    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(sums)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches: array of (start, end, hit), hit being the group."""
    def found(parts):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if group == 0:
            return _let(hits, lambda h: placed(parts, h, h))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return _let(hits, lambda h: _let(values, lambda v: placed(parts, h, v)))

    def placed(parts, hits, values):
        sizes = F.transform(hits, lambda h, i: F.length(F.get(parts, i)) + F.length(h))
        return _let(sizes, lambda z: _let(_running_sums(z), lambda ends: F.transform(
            hits, lambda h, i: F.struct(
                (F.get(ends, i) - F.length(h)).alias("start"),
                F.get(ends, i).alias("end"),
                F.get(values, i).alias("hit")))))

    return _let(F.split(text, pattern, -1), found)


def _gaps(text: Column, pattern: str) -> Column:
    """What lies between the matches: array of (start, part)."""
    def placed(parts, hits):
        sizes = F.transform(parts, lambda p, i: F.length(p) + F.coalesce(
            F.length(F.get(hits, i)), F.lit(0)))
        return _let(sizes, lambda z: _let(_running_sums(z), lambda ends: F.transform(
            parts, lambda p, i: F.struct(
                F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("start"), p.alias("part")))))

    return _let(F.split(text, pattern, -1), lambda parts: _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: placed(parts, hits)))


def _hot_window(text: Column, bits: Column, window: int) -> Column:
    """(first, last): from the first to the last window of ``window``
    characters of ``text`` with an entropy of ``bits`` or more; null if none."""
    weight = [0] + [round(c * math.log2(c) * _UNIT) for c in range(1, window + 1)]
    gain = F.array(*[F.lit(weight[c + 1] - weight[c]) for c in range(window)])
    limit = ((F.lit(math.log2(window)) - bits) * (window * _UNIT)).cast("long")

    def fold(chars, gains):
        def count(c, start, size):
            return F.size(F.filter(F.slice(chars, start + 1, size), lambda x: x == c))

        def step(s, i):
            start = F.greatest(i - window + 1, F.lit(0))
            # the characters that stay in the window while one leaves, one enters
            size = i - start
            into = F.get(gains, count(F.get(chars, i), start, size))
            out = F.when(i >= window, F.get(gains, count(
                F.get(chars, i - window), start, size))).otherwise(F.lit(0))
            total = s["total"] + into - out
            hot = (i >= window - 1) & (total <= limit)
            return F.struct(
                total.alias("total"),
                F.when(hot & s["first"].isNull(), start).otherwise(s["first"]).alias("first"),
                F.when(hot, i + 1).otherwise(s["last"]).alias("last"))

        zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("int").alias("first"),
                        F.lit(None).cast("int").alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), zero, step)

    return _let(F.split(text, "", -1), lambda chars: _let(
        gain.cast("array<bigint>"), lambda gains: fold(chars, gains)))


def _entropy_spans(text: Column, classes, allow, window: int) -> Column:
    def threshold(x):
        bits = F.lit(None).cast("double")
        for _, pattern, least in reversed(classes):
            bits = F.when(x.rlike(pattern), F.lit(float(least))).otherwise(bits)
        return bits

    def allowed(x):
        ok = F.lit(False)
        for pattern in allow:
            ok = ok | x.rlike(pattern)
        return ok

    def in_gap(g):
        found = F.filter(_matches(g["part"], CANDIDATE), lambda m: ~allowed(m["hit"]))
        scored = F.transform(found, lambda m: _let(
            _hot_window(m["hit"], threshold(m["hit"]), window),
            lambda w: F.struct((g["start"] + m["start"] + w["first"]).alias("start"),
                               (g["start"] + m["start"] + w["last"]).alias("end"))))
        return F.filter(scored, lambda s: s["start"].isNotNull())

    gaps = F.filter(_gaps(text, f"{ASSIGN}|{ACCESS}|{HEX}"),
                    lambda g: g["part"].rlike(CANDIDATE))
    return F.flatten(F.transform(gaps, in_gap))


_SPAN = "array<struct<start:int,ord:int,end:int>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 classes=CLASSES, allow=ALLOW, window: int = WINDOW) -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, ord, end)
    sorted by start, then kind (``ord`` indexes ``KINDS``)."""
    text = F.coalesce(col(text_col), F.lit(""))

    def kind(spans: Column, ord_: int, gate: str) -> Column:
        given = F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(ord_).alias("ord"), s["end"].alias("end")))
        return F.when(text.rlike(gate), given).otherwise(F.array()).cast(_SPAN)

    assigned = F.filter(_matches(text, ASSIGN, 1), lambda m: F.length(m["hit"]) >= MIN_ASSIGNED)
    spans = F.concat(kind(assigned, 0, ASSIGN), kind(_matches(text, ACCESS), 1, ACCESS),
                     kind(_matches(text, HEX), 2, HEX),
                     kind(_entropy_spans(text, classes, allow, window), 3, CANDIDATE))
    return docs.select(col(id_col), F.sort_array(spans).alias("spans"))


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["ord"]), s["start"], s["end"])), ",")
