"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one generalised suffix automaton,
which each task streams document words through, tracking the longest match
that ends at each word.  A match that reaches the length limit (``window``
words, or a whole shorter item) marks its words as hit; hit spans are cut out
of the text, and documents with too large a share of hit words are dropped.

Words that the items do not use cannot be part of a match, nor can pairs of
words that no item has side by side, so only runs of known pairs that are long
enough enter the automaton; the run search is vectorised and loses no match.

The automaton is broadcast in arrays.  Its size is bounded by ``max_words`` item
words (some 40 bytes each, and about 700 while the driver builds it); a larger test
set is cut into groups of at most that many (long items with an overlap, so that no
window is lost).  The documents are then written once and read once per group, and
what the groups found is joined to them by row.  The item texts pass through the
driver, one group at a time.

Edge cases: a null or empty text has no words.  Items without words have no
window; item rows with a null id mark words but are not listed; repeated items
count once.  Rows are judged one by one, so null document ids, repeated rows
and ties need no rule; a very long text is read in segments.  Other columns
pass through whatever their names.  An empty item table hits nothing; an empty
table of documents gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, written

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SEGMENT = 1 << 20


def normal_words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of bounded size."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    start = 0
    while start < len(raw):
        end = start + _SEGMENT
        if end < len(raw):      # not within a word
            cut = raw.rfind(b" ", start, end)
            end = cut if cut > start else raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


class _Builder:
    """The states of the automaton while items are added."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def add(self, word_ids: list[int]) -> None:
        last = 0
        for w in word_ids:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, nxt: dict, length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1


class _Lists:
    """Lists of numbers by key, in three arrays."""

    def __init__(self, lists: dict[int, list[int]]):
        self.keys, self.first, self.values = array("i", sorted(lists)), array("i", [0]), array("i")
        for k in self.keys:
            self.values.extend(lists[k])
            self.first.append(len(self.values))

    def __contains__(self, key: int) -> bool:
        at = bisect_left(self.keys, key)
        return at < len(self.keys) and self.keys[at] == key

    def of(self, key: int) -> array:
        at = bisect_left(self.keys, key)
        if at == len(self.keys) or self.keys[at] != key:
            return self.values[:0]
        return self.values[self.first[at]:self.first[at + 1]]


class SuffixAutomaton:
    """Generalised suffix automaton over the words of test items.

    Once built it is held in arrays, the steps of a state side by side in the order
    of their words: some 40 bytes per item word, besides the different words."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes], bool]], window: int):
        """``items``: (id, words, whole); a part of a cut item is not whole."""
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [(name, array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
                 for name, words, _ in items if words]
        built = _Builder()
        for _, word_ids in coded:
            built.add(word_ids)
        self.link, self.length = built.link, built.length
        self.first, self.by, self.to = array("i", [0]), array("i"), array("i")
        for state, nxt in enumerate(built.next):
            for w in sorted(nxt):
                self.by.append(w)
                self.to.append(nxt[w])
            self.first.append(len(self.by))
            built.next[state] = None               # not held twice
        del built
        self.names: list[str | None] = list(dict.fromkeys(name for name, _ in coded))
        number = {name: k for k, name in enumerate(self.names)}
        windows: dict[int, list] = {}              # state of a full window -> items
        shorter: dict[int, list] = {}              # state of a short item -> words, item, words, ...
        self.least = window
        for name, word_ids in coded:
            state = 0
            for i, w in enumerate(word_ids):
                state = self._suffix(self.step(state, w), min(i + 1, window))
                if i + 1 >= window:
                    own = windows.setdefault(state, [])
                    if number[name] not in own[-1:]:
                        own.append(number[name])
            if len(word_ids) < window:
                shorter.setdefault(state, []).extend((len(word_ids), number[name]))
                self.least = min(self.least, len(word_ids))
        self.windows, self.shorter = _Lists(windows), _Lists(shorter)
        # the nearest state with short items on each state's suffix chain
        self.up = array("i", [-1]) * len(self.link)
        if shorter:
            for s in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.up[s] = s if s in shorter else self.up[self.link[s]] if s else -1
        self.size = len(self.vocab)
        pairs = {a * self.size + b for _, ids in coded for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def step(self, state: int, w: int) -> int:
        """The state after ``state`` and the word, -1 if there is none."""
        end = self.first[state + 1]
        at = bisect_left(self.by, w, self.first[state], end)
        return self.to[at] if at < end and self.by[at] == w else -1

    def _suffix(self, state: int, length: int) -> int:
        """The state that holds the last ``length`` words of ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words in which a match of ``least`` words can lie."""
        known = ids >= 0
        if self.least > 1:
            both = np.flatnonzero(known[:-1] & known[1:])
            codes = ids[both] * self.size + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            known = np.zeros(max(len(ids) - 1, 0), bool)
            known[both[self.pairs[at] == codes] if len(self.pairs) else both[:0]] = True
        edges = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        extra = 1 if self.least > 1 else 0
        long = ends - starts + extra >= self.least
        return list(zip(starts[long].tolist(), (ends[long] + extra).tolist()))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(words, hit spans [start, end) of words, items with occurring windows)."""
        get = self.vocab.get
        parts = [np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
                 for ws in normal_words(text)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        spans: list[tuple[int, int]] = []
        items: set = set()

        def hit(start, end):
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        step, link, length, window = self.step, self.link, self.length, self.window
        names = self.names
        for start, end in self.runs(ids):
            state = matched = 0
            for i, w in enumerate(ids[start:end].tolist(), start):
                to = step(state, w)
                while to < 0 and state:
                    state = link[state]
                    matched = length[state]
                    to = step(state, w)
                if to < 0:
                    continue
                state, matched = to, matched + 1
                if matched >= window:
                    items.update(names[k] for k in self.windows.of(self._suffix(state, window)))
                    hit(i + 1 - window, i + 1)
                s = self.up[state]
                while s >= 0:
                    own = self.shorter.of(s)
                    for n, k in zip(own[::2], own[1::2]):
                        if n <= matched:
                            items.add(names[k])
                            hit(i + 1 - n, i + 1)
                    s = self.up[link[s]]
        return len(ids), spans, items


def _item_groups(items: DataFrame, id_col: str, text_col: str, window: int,
                 max_words: int) -> Iterator[list]:
    """Items in groups of at most ``max_words`` words; the driver holds one group."""
    group, size = [], 0
    rows = items.select(col(id_col).cast("string").alias("i"), col(text_col).alias("t"))
    for name, text in rows.distinct().toLocalIterator():
        words = [w for part in normal_words(text) for w in part]
        step = max(max_words - window + 1, 1)
        cuts = range(0, len(words), step) if len(words) > max_words else [0]
        for c in cuts:
            part = words[c:c + step + window - 1] if len(words) > max_words else words
            if c and len(part) < window:
                continue
            if group and size + len(part) > max_words:
                yield group
                group, size = [], 0
            group.append((name, part, len(part) == len(words)))
            size += len(part)
    if group:
        yield group


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str,
             window: int, max_words: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the word count, hit spans and items under unused names."""
    names = {k: fresh(docs, f"__d_{k}") for k in ("words", "spans", "items")}
    groups = _item_groups(benchmark, item_id, item_text, window, max_words)
    group, ahead = next(groups, []), next(groups, None)
    if ahead is None:
        return _scan_group(docs, SuffixAutomaton(group, window), text_col, names), names
    # several groups: the documents are written once, numbered; each group gives the
    # rows with a hit (the first one all rows), and these are joined once
    row = fresh(docs, "__d_row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    found, first = [], True
    while group is not None:
        one = _scan_group(held.select(row, col(text_col)), SuffixAutomaton(group, window), text_col, names)
        one = one.select(row, *names.values())
        if not first:
            one = one.filter(F.size(names["spans"]) > 0)
        found.append(written(one, "decontaminate-hits"))
        group, ahead, first = ahead, next(groups, None), False
    every = reduce(DataFrame.unionByName, found).groupBy(row).agg(
        F.max(names["words"]).alias(names["words"]),
        F.sort_array(F.flatten(F.collect_list(names["spans"]))).alias(names["spans"]),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(names["items"])))).alias(names["items"]))
    none = F.array().cast(_SPANS)
    # ascending spans: one that touches the last is put together with it
    joined = F.aggregate(F.col(names["spans"]), none, lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
            F.element_at(out, -1)["start"].alias("start"),
            F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(out, F.array(s))))
    every = every.withColumn(names["spans"], F.when(F.size(names["spans"]) > 0, joined).otherwise(none))
    return held.join(every, row).drop(row), names


def _scan_group(df: DataFrame, automaton: SuffixAutomaton, text_col: str, names: dict) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(automaton)
    keep = df.columns
    schema = T.StructType([*(df.schema[c] for c in keep),
                           T.StructField(names["words"], T.LongType()),
                           T.StructField(names["spans"], _SPANS),
                           T.StructField(names["items"], T.ArrayType(T.StringType()))])

    def run(batches):
        for b in batches:
            words, spans, items = [], [], []
            for text in b.column(keep.index(text_col)).to_pylist():
                n, s, i = shared.value.scan(text)
                words.append(n)
                spans.append([{"start": x, "end": y} for x, y in s])
                items.append(sorted(x for x in i if x is not None))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(words, pa.int64()),
                 pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))],
                [*keep, *names.values()])

    return df.mapInArrow(run, schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = 10, max_words: int = 500_000) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``spans`` (hit words,
    start and exclusive end) and ``items`` (ids as sorted strings)."""
    src = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    df, n = _scanned(src, benchmark, "text", item_id, item_text, window, max_words)
    spans = F.col(n["spans"])
    return df.select(
        F.col("id").alias(id_col), F.col(n["words"]).alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]
                    ).alias("n_hit"),
        spans.alias("spans"), F.col(n["items"]).alias("items"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what separates them."""
    out, done, k = [], 0, 0
    start = None
    for i, m in enumerate(_WORD.finditer(text)):
        if k == len(spans):
            break
        if i == spans[k][0]:
            start = m.start()
        if i + 1 == spans[k][1]:
            out.append(text[done:start])
            done, k = m.end(), k + 1
    out.append(text[done:])
    return "".join(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  max_coverage: float = 0.5, max_words: int = 500_000) -> DataFrame:
    """``docs`` without hit spans; documents of which more than ``max_coverage``
    of the words are hit are dropped.  Texts without a hit stay as they are."""
    df, n = _scanned(docs, benchmark, text_col, item_id, item_text, window, max_words)
    spans = F.col(n["spans"])
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    df = df.filter(hit <= F.lit(float(max_coverage)) * F.col(n["words"]))
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for b in batches:
            texts = [cut_words(t, [(s["start"], s["end"]) for s in ss]) if ss else t
                     for t, ss in zip(b.column(place).to_pylist(), b.column(len(names)).to_pylist())]
            cols = b.columns[:len(names)]
            cols[place] = pa.array(texts, b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(*map(col, names), spans).mapInArrow(run, docs.schema)
