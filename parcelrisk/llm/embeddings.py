"""Near-duplicate vectors: sorted projection passes, links above a cosine, components.

1. Hashes: in each pass a vector gets ``_BITS`` bits, the sides of as many random
   hyperplanes it lies on, as one number.
2. Passes: vectors of one label and length are ordered lexicographically by the
   concatenated bits of the pass, and each is compared with the next ``window``
   vectors by its cosine in double precision.  The order is cut into blocks of
   ``block`` rows, which also get the first rows of the block after them, so no
   pair of a window is lost at a cut.  Only numbers are sorted; the vectors are
   then dealt to their blocks once per pass.
3. The verified pairs of all passes are united: a block returns a spanning forest
   of its pairs, and rounds of min-label contraction give the components.
4. Links: as a window is bounded and a component is not, each component is then
   counted in full.  Up to ``small`` vectors are compared with one another at
   once.  In larger ones the vectors within half the permitted angle of the
   component's centre link with one another for certain and are only counted;
   the others are compared with all members in tiles of ``small`` by ``small``.
   So no partner is dropped, and copies or near copies of one vector, however
   many, cost one comparison each.

What remains approximate is whether two groups of linked vectors meet in any
window.  The number of passes is derived from the largest group so that a pair
exactly at the threshold meets with probability ``recall``; closer pairs and
pairs within clusters meet with a higher one.

Edge cases: rows with a null label, or a vector that is null, empty, zero or
holds null or non-finite components, link with nothing and are components of
their own.  Vectors of different lengths don't link.  Rows of one id are judged
one by one; ``component_id`` is the smallest id that is not null (null if there
is none), and ``kept`` holds where the row's id is that one.  Input columns
other than the three named are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.operators.ranking import row_numbers

from .common import col, written
from .components import connected_components

_BITS = 64
_MARGIN = 1e-6               # of angles, far above rounding


def passes_needed(rows: int, threshold: float, window: int, recall: float) -> int:
    """So many passes let a pair at the threshold meet with probability ``recall``
    among ``rows`` vectors: in one pass it does when the first bits agree that
    part them into groups of half a window."""
    bits = max(0.0, math.log2(max(rows, 1) / window) + 1)
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if one >= recall else math.ceil(math.log(1 - recall) / math.log(1 - one))


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """The vectors (of one length, each finite and not zero) at length 1, in
    double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit rows) of the vectors of each length."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, unit_rows(vectors.take(pa.array(at)))


def _codes(nodes: DataFrame, passes: int, seed: int) -> DataFrame:
    """(pass, grp, code, node): the hashes of each pass; codes sort like their bits."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in _by_length(b.column(2)):
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * _BITS))
                for s in range(0, len(at), 1024):
                    some = at[s:s + 1024]
                    sides = (x[s:s + 1024] @ planes[d] > 0).reshape(len(some), passes, _BITS)
                    code = np.packbits(sides, axis=2).view(">u8")[:, :, 0].astype(np.uint64)
                    rows = pa.array(np.repeat(some, passes))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(passes, dtype=np.int32), len(some))),
                        b.column(1).take(rows),
                        pa.array((code ^ np.uint64(1 << 63)).ravel().view(np.int64)),
                        b.column(0).take(rows)], ["pass", "grp", "code", "node"])

    return nodes.select("node", "grp", "v").mapInArrow(
        run, "pass int, grp string, code long, node long")


def _dealt(nodes: DataFrame, passes: int, seed: int, window: int, block: int) -> DataFrame:
    """(block, rn, grp, node, v): every pass's order, in blocks that overlap by a
    window; ``grp`` names the pass, the label and the length."""
    placed = row_numbers(_codes(nodes, passes, seed), ["pass", "grp", "code", "node"], "rn")
    own = F.floor(F.col("rn") / block).cast("long")
    both = F.when((F.col("rn") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    places = placed.groupBy("node").agg(F.collect_list(F.struct("pass", "rn", both.alias("blocks"))
                                                       ).alias("places"))
    at = nodes.join(places, "node").select("node", "grp", "v", F.explode("places").alias("p"))
    at = at.select(F.explode("p.blocks").alias("block"), F.col("p.rn").alias("rn"),
                   F.concat_ws(":", "p.pass", "grp").alias("grp"), "node", "v")
    return at.repartition("block").sortWithinPartitions("block", "rn")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for x in k:
            new[1:] |= x[1:] != x[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(cut[:-1], cut[1:]):
            own = tuple(x[s] for x in k)
            if held and own != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    root = np.arange(n)
    while True:
        was = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            return root


def _links_in_blocks(dealt: DataFrame, threshold: float, window: int, block: int) -> DataFrame:
    """(a, b): a spanning forest of the verified pairs of each block."""
    def run(batches):
        for t in _grouped(batches, 1):
            of, rn = (t.column(i).to_numpy() for i in range(2))
            mark = t.column(2).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            node, vec = t.column(3).to_numpy(), t.column(4).combine_chunks()
            own = int((rn // block == of).sum())
            first, second = [], []
            cuts = np.r_[0, np.flatnonzero(mark[1:] != mark[:-1]) + 1, len(mark)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):    # one pass, label and length
                x = unit_rows(vec.slice(lo, hi - lo))
                for s in range(0, min(hi, own) - lo, window):
                    part = x[s:s + window]
                    near = part @ x[s:s + 2 * window].T >= threshold
                    i, j = np.nonzero(near)
                    ok = (j > i) & (j - i <= window) & (s + i + lo < own)
                    first.append(lo + s + i[ok])
                    second.append(lo + s + j[ok])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, second))
            root = _roots(len(mark), a, b)
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[tied]]), pa.array(node[tied])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _counted_whole(members: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links) in components that are compared at once."""
    def run(batches):
        for t in _grouped(batches, 1):
            x = unit_rows(t.column(2).combine_chunks())
            n = np.count_nonzero(x @ x.T >= threshold, axis=1) - 1
            yield pa.RecordBatch.from_arrays([t.column(1).combine_chunks(), pa.array(n)], ["node", "n_links"])

    dealt = members.select("comp", "node", "v").repartition("comp").sortWithinPartitions("comp")
    return dealt.mapInArrow(run, "node long, n_links long")


def _centres(members: DataFrame) -> DataFrame:
    """(comp, centre): the sums of the unit vectors, added up in the tasks first."""
    def run(batches):
        def rows(sums):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()),
                 pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["comp", "part"])

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            comp = b.column(0).to_numpy()
            for at, x in _by_length(b.column(1)):
                for c in np.unique(comp[at]):
                    s = x[comp[at] == c].sum(axis=0)
                    sums[int(c)] = sums[int(c)] + s if int(c) in sums else s
            if len(sums) >= 1024:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    parts = members.select("comp", "v").mapInArrow(run, "comp long, part array<double>")
    added = parts.select("comp", F.posexplode("part")).groupBy("comp", "pos").agg(F.sum("col").alias("x"))
    both = added.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("xs"))
    return both.select("comp", F.transform("xs", lambda p: p["x"]).alias("centre"))


def _counted_by_centre(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, n_links) in components of any size."""
    half = math.acos(threshold) / 2 - _MARGIN

    def judge(batches):
        for b in batches:
            core = np.zeros(b.num_rows, bool)
            for at, x in _by_length(b.column(2)):
                c = np.stack(b.column(3).take(pa.array(at)).to_pylist())
                length = np.sqrt((c * c).sum(axis=1))
                cos = (x * c).sum(axis=1) / np.where(length > 0, length, 1)
                core[at] = (length > 0) & (np.arccos(np.clip(cos, -1, 1)) <= half)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(core)], ["comp", "node", "v", "core"])

    v_type = members.schema["v"].dataType.simpleString()
    at = members.select("comp", "node", "v").join(_centres(members), "comp").select(
        "comp", "node", "v", "centre")
    at = written(at.mapInArrow(judge, f"comp long, node long, v {v_type}, core boolean"),
                 "embedding-centres")
    of = at.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("n_core"))
    at = at.join(of, "comp")
    certain = at.select("node", F.when(F.col("core"), F.col("n_core") - 1).otherwise(0).alias("n_links"))
    if at.filter("not core").isEmpty():
        return certain

    rows, cols = (F.ceil(n / tile).cast("int") for n in (F.col("n") - F.col("n_core"), F.col("n")))
    first = at.filter("not core").select(
        "comp", F.pmod(F.xxhash64("node", F.lit(1)), rows).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), cols - 1)).alias("j"), F.lit(0).alias("side"), "node", "core", "v")
    second = at.filter("n_core < n").select(
        "comp", F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"),
        F.pmod(F.xxhash64("node"), cols).cast("int").alias("j"), F.lit(1).alias("side"), "node", "core", "v")

    def run(batches):
        for t in _grouped(batches, 3):
            side, node = t.column(3).to_numpy(), t.column(4).to_numpy()
            core = t.column(5).to_numpy()
            x = unit_rows(t.column(6).combine_chunks())
            a, b = side == 0, side == 1
            near = (x[a] @ x[b].T >= threshold) & (node[a][:, None] != node[b][None, :])
            # pairs without a core vector are met from both sides, the others from one
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[node[a], node[b][core[b]]]),
                 pa.array(np.r_[near.sum(axis=1), near[:, core[b]].sum(axis=0)])], ["node", "n_links"])

    met = first.unionByName(second).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return certain.unionByName(met.mapInArrow(run, "node long, n_links long")).groupBy("node").agg(
        F.sum("n_links").alias("n_links"))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label", threshold: float = 0.93, window: int = 32,
                           recall: float = 0.999, block: int = 2048, small: int = 1024,
                           seed: int = 11) -> DataFrame:
    """One row per vector: id, ``n_links`` (other vectors with the same label and a
    cosine of ``threshold`` or more), ``component_id`` and ``kept``."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    v = col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(x - x == F.lit(0), F.lit(False)))
    usable = col(label_col).isNotNull() & v.isNotNull() & finite & F.exists(
        v, lambda x: F.coalesce(x != F.lit(0), F.lit(False)))
    rows = vectors.select(
        col(id_col).alias("id"), F.coalesce(usable, F.lit(False)).alias("usable"), v.alias("v"),
        F.concat_ws(":", F.size(v), col(label_col).cast("string")).alias("grp"))
    rows = written(rows.withColumn("node", F.monotonically_increasing_id()), "embedding-rows")
    nodes = rows.filter("usable").select("node", "grp", "v")
    most = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    dealt = _dealt(nodes, passes_needed(most, threshold, window, recall), seed, window, block)
    labels = connected_components(_links_in_blocks(dealt, threshold, window, block))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = written(nodes.join(labels, "node").join(sizes, "label").select(
        F.col("label").alias("comp"), "node", "v", "n"), "embedding-members")
    links = _counted_whole(members.filter(F.col("n") <= small), threshold)
    large = members.filter(F.col("n") > small)
    if not large.isEmpty():
        links = links.unionByName(_counted_by_centre(large, threshold, small))
    links = written(links, "embedding-links")
    of = rows.select("node", "id").join(labels, "node", "left").join(links, "node", "left").select(
        "id", F.coalesce("label", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = of.groupBy("comp").agg(F.min("id").alias("least"))
    return of.join(least, "comp").select(
        F.col("id").alias(id_col), "n_links", F.col("least").alias("component_id"),
        F.col("id").eqNullSafe(F.col("least")).alias("kept"))
