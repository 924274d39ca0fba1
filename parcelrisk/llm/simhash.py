"""SimHash near-duplicates: links at a small bit distance, and their components.

1. Fingerprints: per document, the XXH64 of its word shingles vote on 64 bits
   (vectorised per document, texts are read once).
2. Copies collapse: one row per different fingerprint.
3. Embedding: a fingerprint is cut into segments of ``segment_bits`` and mapped
   to the vector of its per-segment bit counts.  The Manhattan distance of two
   such vectors is a lower bound of the bit distance.  The counts are written
   in unary, so that distance is the popcount of an xor.
4. Grid range-join: the segments are dealt into ``max_bits + 3`` blocks.  Two
   vectors within Manhattan distance ``max_bits`` agree on at least three
   blocks, so they share a cell of unit width in one of the projections onto
   three blocks.  Rows meet by cell; within a cell pairs below the Manhattan
   bound are verified by their exact bit distance.
5. A cell returns a spanning forest of its links, not its pairs.  Cells above
   ``cell_limit`` members aren't compared pairwise: they are split by a second
   projection, onto one part of the bits each (``_finer``).  What is above the limit
   even then meets by keys that ignore one bit and flip at most one other
   (``_meeting_keys``), the work of which is linear, and any two members of such a
   key are true links.
6. Components of the links: rounds of min-label contraction with checkpoints.

Edge cases: null and blank texts have fingerprint zero and link like any other
fingerprint.  ``component_id`` is the smallest non-null id that can be reached
(null if a component has none); rows of one id are judged one by one.  Exact
repeats share a fingerprint.  Input columns other than id and text are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, written
from .components import connected_components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text, as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    # votes: how often each byte value occurs at each of the eight places
    places = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _LANES
    seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    votes = (seen @ _BITS).ravel()
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The other columns of ``docs`` with ``fp``, the fingerprint of the text as
    a signed long, in place of the text; one row per input row."""
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(col(text_col), *map(col, rest))
    schema = src.select(*map(col, rest), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(0).to_pylist()),
                              np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps)], [*rest, "fp"])

    return src.mapInArrow(run, schema)


def embed(fps: np.ndarray, segment_bits: int) -> np.ndarray:
    """Per-segment bit counts in unary: the bits of each segment sorted, as one
    unsigned 64-bit number."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    bits = -np.sort(-bits.reshape(len(fps), 64 // segment_bits, segment_bits).astype(np.int8), axis=2)
    packed = np.packbits(bits.astype(np.uint8).reshape(len(fps), 64), axis=1)
    return packed.view(">u8").ravel().astype(np.uint64)


def projections(segment_bits: int, max_bits: int) -> np.ndarray:
    """The masks of all projections onto three of ``max_bits + 3`` blocks."""
    blocks = np.array_split(np.arange(64 // segment_bits), max_bits + 3)
    lane = (1 << segment_bits) - 1
    masks = [sum(lane << int(s) * segment_bits for s in b) for b in blocks]
    return np.array([sum(c) for c in combinations(masks, 3)], np.uint64)


def _cells(fps: DataFrame, segment_bits: int, max_bits: int) -> DataFrame:
    masks = projections(segment_bits, max_bits)

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            v = embed(fp, segment_bits)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(masks), dtype=np.int32), len(fp))),
                pa.array((v[None, :] & masks[:, None]).ravel().view(np.int64)),
                pa.array(np.tile(fp, len(masks)).view(np.int64))], ["grid", "cell", "fp"])

    return fps.select("fp").mapInArrow(run, "grid int, cell long, fp long")


def _forest(fp: np.ndarray, segment_bits: int, max_bits: int) -> tuple[list, list]:
    """Links of one cell that connect what its links connect: each row is
    compared with the later ones, Manhattan bound first; rows that already
    share a root add none."""
    v = embed(fp, segment_bits)
    root = np.arange(len(fp))
    a, b = [], []
    for i in range(len(fp) - 1):
        near = np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= max_bits) + i + 1
        if len(near):
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= max_bits]
        for j in near[np.unique(root[near], return_index=True)[1]] if len(near) else ():
            if root[j] != root[i]:
                a.append(fp[i])
                b.append(fp[j])
                root[root == root[j]] = root[i]
    return a, b


def _links_in_cells(cells: DataFrame, segment_bits: int, max_bits: int,
                    cell_limit: int) -> DataFrame:
    """(a, b, hot, grid, cell): links of the cells; members of cells above the limit
    are handed on as (member, null, true, grid, cell)."""
    def rows(a, b, at):
        n, hot = len(a), at is not None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(a, np.uint64).view(np.int64)),
             pa.nulls(n, pa.int64()) if hot else pa.array(np.array(b, np.uint64).view(np.int64)),
             pa.array(np.full(n, hot)),
             pa.array(np.full(n, at[0], np.int32)) if hot else pa.nulls(n, pa.int32()),
             pa.array(np.full(n, at[1], np.int64)) if hot else pa.nulls(n, pa.int64())],
            ["a", "b", "hot", "grid", "cell"])

    def run(batches):
        held, key, hot = np.empty(0, np.uint64), None, False

        def close():
            if hot:
                return rows(held, None, key)
            return rows(*_forest(held, segment_bits, max_bits), None)

        for batch in batches:
            if not batch.num_rows:
                continue
            g, c, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            f = f.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            ends = np.r_[starts[1:], len(f)]
            # the cell that the last batch left open
            if key == (g[0], c[0]):
                held = np.concatenate([held, f[:ends[0]]])
                starts, ends = starts[1:], ends[1:]
                if len(held) > cell_limit:
                    yield rows(held, None, key)
                    held, hot = held[:0], True
            if len(starts):
                if len(held) > 1 or hot:
                    yield close()
                sizes = ends[:-1] - starts[:-1]
                two = starts[:-1][sizes == 2]
                x, y = f[two], f[two + 1]
                near = (np.bitwise_count(embed(x, segment_bits) ^ embed(y, segment_bits))
                        <= max_bits) & (np.bitwise_count(x ^ y) <= max_bits)
                yield rows(x[near], y[near], None)
                for s, e in zip(starts[:-1][sizes > 2], ends[:-1][sizes > 2]):
                    if e - s > cell_limit:
                        yield rows(f[s:e], None, (g[s], c[s]))
                    else:
                        yield rows(*_forest(f[s:e], segment_bits, max_bits), None)
                held, hot = f[starts[-1]:ends[-1]], False
                key = (g[starts[-1]], c[starts[-1]])
                if len(held) > cell_limit:
                    yield rows(held, None, key)
                    held, hot = held[:0], True
        if len(held) > 1 or hot:
            yield close()

    met = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell")
    return met.mapInArrow(run, "a long, b long, hot boolean, grid int, cell long")


def _finer(members: DataFrame, max_bits: int) -> DataFrame:
    """(grid, cell, fp): the members of cells above the limit in cells within these.

    A second projection: of the bits in ``max_bits + 1`` parts, two members within
    ``max_bits`` bits have one in common, so they meet in it.  (A cell's number is a
    hash of what it stands for; cells that share one are compared in vain.)"""
    parts = [sum(1 << int(b) for b in p) for p in np.array_split(np.arange(64), max_bits + 1)]
    masks = np.array(parts, np.uint64).view(np.int64).tolist()
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                    for i, m in enumerate(masks)])
    at = members.select("grid", "cell", "fp", F.explode(own).alias("p"))
    return at.select((F.col("grid") * len(masks) + F.col("p.i")).cast("int").alias("grid"),
                     F.xxhash64("cell", "p.bits").alias("cell"), "fp")


def _meeting_keys(max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key of a fingerprint: the bits it ignores and those it flips.

    Two fingerprints share a key only if they differ in its ignored bits and in
    one flipped bit each at most, so within ``max_bits``; and any two within
    ``max_bits`` share one: of their differing bits in ascending order, ignore
    the first ``max_bits - 2``, let one flip the next and the other the last."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ignored, flipped = [], []
    for drop in combinations(range(64), max(0, max_bits - 2)):
        mask = np.bitwise_or.reduce(one[list(drop)]) if drop else np.uint64(0)
        flips = one[(drop[-1] + 1 if drop else 0):] if max_bits > 1 else one[:0]
        ignored.append(np.full(len(flips) + 1, mask))
        flipped.append(np.r_[np.uint64(0), flips])
    if max_bits == 1:      # ignore one bit, flip none
        return one, np.zeros(64, np.uint64)
    return np.concatenate(ignored), np.concatenate(flipped)


def _links_by_keys(members: DataFrame, max_bits: int) -> DataFrame:
    """Links among the members of cells above the limit, through the smallest
    fingerprint of each meeting key."""
    ignored, flipped = _meeting_keys(max_bits)

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(fp), 64):
                part = fp[s:s + 64]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ignored.view(np.int64), len(part))),
                    pa.array((((part[None, :] ^ flipped[:, None]) | ignored[:, None])
                              .ravel().view(np.int64))),
                    pa.array(np.tile(part, len(ignored)).view(np.int64))], ["m", "k", "fp"])

    keyed = members.mapInArrow(run, "m long, k long, fp long")
    least = keyed.groupBy("m", "k").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    least = least.filter(F.col("a") < F.col("z")).drop("z")
    return keyed.join(least, ["m", "k"]).filter(F.col("a") < F.col("fp")).select(
        "a", F.col("fp").alias("b")).distinct()


def fingerprint_links(fps: DataFrame, max_bits: int = 3, segment_bits: int = 2,
                      cell_limit: int = 8192) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``) that
    connect exactly what all pairs within ``max_bits`` bits connect."""
    if max_bits < 1:
        raise ValueError("max_bits must be at least 1; equal fingerprints need no links")
    cells = _cells(fps.select("fp").distinct(), segment_bits, max_bits)
    found = written(_links_in_cells(cells, segment_bits, max_bits, cell_limit), "simhash-links")
    links = found.filter("not hot").select("a", "b").distinct()
    dense = found.filter("hot").select("grid", "cell", F.col("a").alias("fp"))
    if dense.isEmpty():
        return links
    again = written(_links_in_cells(_finer(dense, max_bits), segment_bits, max_bits, cell_limit),
                    "simhash-dense")
    links = links.unionByName(again.filter("not hot").select("a", "b"))
    members = again.filter("hot").select(F.col("a").alias("fp")).distinct()
    if members.isEmpty():
        return links.distinct()
    return links.unionByName(_links_by_keys(members, max_bits)).distinct()


def _classes(fps: DataFrame, max_bits: int, segment_bits: int, cell_limit: int) -> DataFrame:
    """(fp, label): the component of every fingerprint."""
    labels = connected_components(fingerprint_links(fps, max_bits, segment_bits, cell_limit))
    nodes = fps.select("fp").distinct()
    return nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, max_bits: int = 3, segment_bits: int = 2,
                    cell_limit: int = 8192) -> DataFrame:
    """One row per document: id, ``fp`` (signed long) and ``component_id``, the
    smallest id that links of ``max_bits`` bits or fewer reach."""
    fps = written(fingerprints(
        docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "text", shingle),
        "simhash-fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    linked = least.join(_classes(fps, max_bits, segment_bits, cell_limit), "fp")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of = linked.join(ids, "label").select("fp", "component_id")
    return fps.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 5, max_bits: int = 3, segment_bits: int = 2,
                       cell_limit: int = 8192) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (rows
    without an id come last; among rows of one id, the smallest row hash).
    Of exactly repeated rows one stays."""
    r1, r2 = fresh(docs, "__s_row1"), fresh(docs, "__s_row2")
    plain = [col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    docs2 = docs.withColumns({r1: F.xxhash64(*plain), r2: F.xxhash64(F.lit(1), *plain)})
    fps = written(fingerprints(
        docs2.select(col(text_col).alias("text"), col(id_col).alias("id"),
                     col(r1).alias("r1"), col(r2).alias("r2")), "text", shingle),
        "simhash-rows")
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "r1", "r2"))
    first = fps.groupBy("fp").agg(least.alias("row")).join(
        _classes(fps, max_bits, segment_bits, cell_limit), "fp")
    kept = first.groupBy("label").agg(F.min("row").alias("row")).select(
        F.col("row.r1").alias(r1), F.col("row.r2").alias(r2))
    return docs2.join(kept, [r1, r2], "left_semi").dropDuplicates([r1, r2]).select(
        *map(col, docs.columns))
