"""Quality rules: a table of thresholds compiled into one projection.

Every measure is an expression of built-in functions over one row (no user
function, no shuffle), so the stage reads each document once and streams.
Repeated 3-word windows are found within the row: windows are hashed to 64
bits, and only texts whose hashes repeat sort them.

Edge cases: a null or blank text has no words, all measures zero, and fails
the base rule.  Stop words count in any case, and only where the document's
language (``lang_col``) has a list; without that column, in every document.
Rows are judged one by one, so null ids, repeated rows and
ties need no rule.  Extra columns pass through; a column that has the name of
a measure keeps its values in ``keep_documents`` and is replaced in
``quality_measures``.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, split_words

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is that for with as was by are be this on at have from it".split(),
    "fr": "le la les de des du et un une que qui dans en pour par sur est pas au aux".split(),
    "de": "der die das und ist von zu den mit im ein eine nicht auf für dem des sich als auch".split(),
    "es": "el la los las de que y en un una por con para es del se no al lo su".split(),
}


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within [low, high]; an absent bound is open, and a
    null measure passes."""
    measure: str
    low: float | None = None
    high: float | None = None


#: Base rules: too few words, or most words in repeated 3-word windows.
BASE_RULES = (Rule("n_words", low=50), Rule("repeat_ratio", high=0.5))

#: The method's table.
RULES = (
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbol_ratio", high=0.1),
    Rule("n_stop_words", low=2),
    Rule("dup_line_ratio", high=0.5),      # a text of three lines may repeat one
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def passes(rules, names: dict[str, str]) -> Column:
    """The rules as one boolean expression over the measures' columns."""
    ok = F.lit(True)
    for r in rules:
        m = col(names.get(r.measure, r.measure))
        if r.low is not None:
            ok = ok & F.coalesce(m >= F.lit(float(r.low)), F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(m <= F.lit(float(r.high)), F.lit(True))
    return ok


def _has_list(docs: DataFrame, lang_col: str, stop_words) -> Column:
    """Whether the document's language has a list of stop words; all have one
    if there is no such column."""
    if lang_col not in docs.columns:
        return F.lit(True)
    lang = F.lower(F.regexp_extract(F.coalesce(col(lang_col), F.lit("")), "^[A-Za-z]+", 0))
    return lang.isin(*[k.lower() for k in stop_words])


def _measured(docs: DataFrame, text_col: str, lang_col: str, stop_words) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measures under unused names; the map to these."""
    own: dict[str, str] = {}

    def put(df: DataFrame, **exprs) -> DataFrame:
        names = {k: own.setdefault(k, fresh(docs, f"__q_{k}")) for k in exprs}
        return df.withColumns({names[k]: e for k, e in exprs.items()})

    def at(k: str) -> Column:
        return col(own[k])

    text = F.coalesce(col(text_col), F.lit(""))
    stops = sorted({w for ws in stop_words.values() for w in ws})
    df = put(docs, words=split_words(col(text_col)),
             lines=F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
             n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    n = F.size(at("words"))
    df = put(
        df,
        n_words=n.cast("long"),
        word_chars=F.length(F.array_join(at("words"), "")).cast("long"),
        n_dup_lines=(F.size(at("lines")) - F.size(F.array_distinct(at("lines")))).cast("long"),
        n_lines=F.size(at("lines")).cast("long"),
        # different stop words that occur, in any case; null without a list
        n_stop_words=F.when(_has_list(docs, lang_col, stop_words), F.size(F.array_intersect(
            F.transform(at("words"), F.lower), F.array(*map(F.lit, stops)))).cast("long")),
        hashes=F.when(n >= 3, F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(at("words"), i), F.get(at("words"), i + 1),
                                 F.get(at("words"), i + 2)))
        ).otherwise(F.array().cast("array<bigint>")))
    df = df.drop(own["words"], own["lines"])
    # (hash, place) sorted: windows that occur again lie side by side
    repeats = F.size(F.array_distinct(at("hashes"))) < F.size(at("hashes"))
    df = put(df, sorted=F.when(repeats, F.sort_array(F.transform(
        at("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.drop(own["hashes"])
    s = at("sorted")

    def same(k: Column, j: Column) -> Column:
        return F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))

    df = put(df, places=F.when(s.isNotNull(), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
        lambda k: F.get(s, k)["i"]))))
    df = df.drop(own["sorted"])
    p = at("places")
    # a repeated window covers three words, less those its successor covers too
    df = put(df, n_repeat_words=F.when(p.isNotNull(), F.aggregate(
        F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"),
        lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3)))
    )).otherwise(F.lit(0).cast("long")))
    df = df.drop(own["places"])
    df = put(df, repeat_ratio=_ratio(at("n_repeat_words"), at("n_words")),
             mean_word_chars=_ratio(at("word_chars"), at("n_words")),
             symbol_ratio=_ratio(at("n_symbols"), at("n_words")),
             dup_line_ratio=_ratio(at("n_dup_lines"), at("n_lines")))
    live = {k: v for k, v in own.items() if v in df.columns}
    return df, live


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules=RULES, base_rules=BASE_RULES, stop_words=None,
                     lang_col: str = "lang") -> DataFrame:
    """One row per document: its id, all measures, ``base_failed``, ``kept``."""
    read = [c for c in dict.fromkeys((id_col, text_col, lang_col)) if c != lang_col or c in docs.columns]
    df, m = _measured(docs.select(*map(col, read)), text_col, lang_col, stop_words or STOP_WORDS)
    base = passes(base_rules, m)
    # generated columns, so that a caller's filter stays above the measures
    return df.select(col(id_col), F.inline(F.array(F.struct(
        *[col(v).alias(k) for k, v in m.items()], (~base).alias("base_failed"),
        (base & passes(rules, m)).alias("kept")))))


def keep_documents(docs: DataFrame, text_col: str = "text", rules=RULES,
                   base_rules=BASE_RULES, stop_words=None, lang_col: str = "lang") -> DataFrame:
    """The documents that pass all rules, with their own columns."""
    df, m = _measured(docs, text_col, lang_col, stop_words or STOP_WORDS)
    ok = fresh(docs, "__q_ok")
    # a generated column: the filter cannot be pushed below it, which would
    # write the measures' expressions out again for each of their uses
    df = df.select(*map(col, docs.columns), F.explode(F.array(
        passes(base_rules, m) & passes(rules, m))).alias(ok))
    return df.filter(F.col(ok)).select(*map(col, docs.columns))
