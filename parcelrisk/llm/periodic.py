"""Periodic runs of words: stretches that repeat themselves, found exactly.

A run is a stretch of consecutive words of which words ``period`` apart are
identical, that no neighbouring word extends, and whose smallest period it is.
Per text, runs of at least ``min_words`` words and ``min_exponent`` periods:

1. A suffix automaton of the words.  Its suffix links form a tree in which the
   path from the state of a prefix to the root holds all suffixes of it.
2. The words are appended once more, one by one.  Each one is an access, as in
   a link-cut tree: the path of its prefix is recoloured with the present end.
   The path falls into segments of one colour, the previous end of the suffixes
   there; the deepest of a segment is the longest such suffix.  As the tree
   stays as it is by now, the preferred paths are kept as stacks of coloured
   intervals on its heavy chains instead of splay trees; an access meets
   O(log n) chains, and each interval that it replaces is gone.
3. A distance between the present and the previous end within the length of a
   segment is a square.  It reaches as far left as the segment is long.  Where
   the next word does not go on with it, it is a whole run; each run is reported
   there, once, with its smallest period (a smaller one would have been a more
   recent end).

Before that, texts are cut where no run can be: each ``gram`` of words in a run
has an equal one at the distance of the period, so within the share
``1 / min_exponent`` of the words around it that can belong to a run.  That
costs one sort of hashes per slice of texts; equal hashes of different words
only leave more to the automaton, so no run is lost.

Edge cases: a null, empty or blank text has no words, no runs and an empty
collapsed text.  Rows with equal ids are judged one by one.  Input columns
other than id and text are not read.  An empty table gives an empty result.
Memory: one text at least is held whole, and one automaton of the longest
stretch that may hold a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, split_words

_SLICE = 4 << 20             # bytes of text taken at a time
_MIX = np.random.default_rng(12).integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def suffix_automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, prefix): of each state its longest word sequence and its
    suffix link; of each position the state of the prefix that ends there."""
    length, link, step = [0], [-1], [{}]
    prefix, last = [], 0
    for i, c in enumerate(codes):
        cur = len(length)
        length.append(i + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                split = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = split
                    p = link[p]
                link[q] = link[cur] = split
        prefix.append(cur)
        last = cur
    return length, link, prefix


def heavy_chains(length: list[int], link: list[int]) -> list[int]:
    """The top state of each state's heavy chain in the tree of links."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size = [1] * len(length)
    for v in reversed(order[1:]):
        size[link[v]] += size[v]
    heavy, most = [-1] * len(length), [0] * len(length)
    for v in order[1:]:
        p = link[v]
        if size[v] > most[p]:
            most[p], heavy[p] = size[v], v
    top = list(range(len(length)))
    for v in order[1:]:
        if heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def runs_of(codes: list[int], min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence, by start, then period."""
    n, more = len(codes), min_exponent - 1
    length, link, prefix = suffix_automaton(codes)
    top = heavy_chains(length, link)
    stacks: list[list[tuple[int, int]]] = [[] for _ in length]   # by top: (deepest, colour)
    found = []
    for i, v in enumerate(prefix):
        while v > 0:
            h = top[v]
            stack, deep, at = stacks[h], length[v], 0
            while stack:
                at, end = stack[-1]
                upto = at if at <= deep else deep       # the longest suffix of this colour
                d = i - end
                if upto >= more * d and upto + d >= min_words:
                    s = i - d - upto + 1
                    if (i + 1 == n or codes[i + 1] != codes[i + 1 - d]) and (
                            s == 0 or codes[s - 1] != codes[s - 1 + d]):
                        found.append((s, upto + d, d))
                if at > deep:
                    break
                stack.pop()
                if at == deep:
                    break
            stack.append((deep, i))
            v = link[h]
    return sorted(found)


def candidate_stretches(codes: np.ndarray, bounds: np.ndarray, gram: int, min_words: int,
                        min_exponent: int) -> list[tuple[int, int]]:
    """[from, to) of the stretches that can hold a run.  ``codes`` are the words
    of several texts, one after the other; text k is ``bounds[k]:bounds[k + 1]``."""
    n = len(codes)
    if n < max(gram, 2):
        return []
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    m = n - gram + 1
    c = codes.astype(np.uint64)
    mixed = text[:m].astype(np.uint64) * _MIX[0]
    for k in range(gram):
        mixed += (c[k:k + m] + np.uint64(1)) * _MIX[k + 1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX[-1]
    bits = int(m).bit_length()
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((mixed & ~low) | np.arange(m, dtype=np.uint64))
    at = (packed & low).astype(np.int64)
    gap = np.where((packed[1:] ^ packed[:-1]) <= low, np.diff(at), n)
    near = np.full(m, n, np.int64)
    near[at[1:]] = gap
    near[at[:-1]] = np.minimum(near[at[:-1]], gap)
    near[text[:m] != text[gram - 1:]] = n        # not within one text
    room = np.diff(bounds)[text[:m]]
    for _ in range(8):           # any number of rounds leaves all runs in
        ok = near * min_exponent <= room
        new = np.r_[True, (text[1:m] != text[:m - 1]) | ~ok[:-1]]
        starts = np.flatnonzero(ok & new)
        last = np.flatnonzero(ok & np.r_[new[1:] | ~ok[1:], True])
        grams = last - starts + 1
        keep = grams + gram - 1 >= min_words
        starts, grams = starts[keep], grams[keep]
        inside = np.repeat(starts - np.cumsum(grams) + grams, grams) + np.arange(int(grams.sum()))
        room = np.zeros(m, np.int64)
        room[inside] = np.repeat(grams + gram - 1, grams)
        if len(inside) == np.count_nonzero(near * min_exponent <= room):
            break
    return list(zip(starts.tolist(), (starts + grams + gram - 1).tolist()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // _SLICE
        cut = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, b.num_rows]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if e > s:
                yield b.slice(s, e - s)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per document: id, ``n_words``, ``runs`` (start, length, period;
    by start, then period) and ``collapsed``: the words joined by one space,
    without those that any run holds after its first period."""
    if min_exponent < 2:
        raise ValueError("min_exponent must be at least 2: a run holds a square")
    gram = 3 if min_exponent >= 3 and min_words >= 4 else 1
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("id", src.schema["id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    run_type = pa.struct([(f.name, pa.int64()) for f in RUN])

    def judged(b: pa.RecordBatch) -> pa.RecordBatch:
        bare = pc.ascii_trim_whitespace(pc.fill_null(b.column(1), "").cast(pa.large_string()))
        split = pc.ascii_split_whitespace(bare)
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        collapsed = pc.binary_join(split, pa.scalar(" ", pa.large_string()))
        runs: list[list] = [[] for _ in range(b.num_rows)]
        for lo, hi in candidate_stretches(codes, bounds, gram, min_words, min_exponent):
            k = int(np.searchsorted(bounds, lo, "right")) - 1
            base = lo - int(bounds[k])
            runs[k] += [(base + s, n, q)
                        for s, n, q in runs_of(codes[lo:hi].tolist(), min_words, min_exponent)]
        shorter = [k for k, r in enumerate(runs) if r]
        if shorter:
            texts = collapsed.to_pylist()
            names = words.dictionary
            for k in shorter:
                gone = np.zeros(int(bounds[k + 1] - bounds[k]), bool)
                for s, n, q in runs[k]:
                    gone[s + q:s + n] = True
                own = codes[bounds[k]:bounds[k + 1]][~gone]
                texts[k] = " ".join(names.take(pa.array(own)).to_pylist())
            collapsed = pa.array(texts, pa.string())
        empty = pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.where(empty, 0, np.diff(bounds))),
             pa.array([[dict(zip(RUN.names, r)) for r in rs] for rs in runs], pa.list_(run_type)),
             collapsed.cast(pa.string())], schema.names)

    def run(batches):
        for b in _slices(batches):
            yield judged(b)

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def rewritten_periodically(docs: DataFrame, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """``docs`` with a tenth of the texts made periodic from some word on, a known
    damage that the runs must show: with h the CRC-32 of the decimal id and
    g = h div 10, where h mod 10 = 0 each word i >= a becomes word
    a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    w, n, a, p = (fresh(docs, f"__p_{x}") for x in "wnap")
    made = docs.withColumn(w, F.when(h % 10 == 0, split_words(col(text_col).cast("string")))) \
        .withColumn(n, F.when(F.size(w) > 0, F.size(w))) \
        .withColumn(a, (g % col(n)).cast("int")) \
        .withColumn(p, (1 + F.floor((col(n) - col(a)) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(
        F.slice(w, col(a) + 1, col(p)), F.ceil((col(n) - col(a)) / col(p)).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), col(a)), tail), F.lit(1), col(n)), " ")
    return made.withColumn(text_col, F.when(col(n).isNotNull(), text).otherwise(col(text_col))) \
        .drop(w, n, a, p)
