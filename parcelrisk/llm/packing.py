"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length.  Pieces are dealt
at random (by hash) into shards of about ``shard_pieces`` pieces; each shard is
packed by itself, so memory is bounded and a lost task repacks one shard only.
Within a shard, pieces are placed by falling length into the open bin that
they fill best.  Where none has room, the bin size of least cost per token it
can still get is opened.  That is tried with every permitted length as the
smallest to open; each bin is then downsized to the smallest length that holds
its contents, and the plan of least total cost is taken.

The plan depends on the ids and lengths only, not on how the table is partitioned.

Edge cases: documents of null or no length are returned unplaced (null bin).
Ties in length go by id, piece and the document's length, ties between bins to the fullest and
then the oldest, ties in cost to the smaller length.  Rows of one id or a null
id are placed each for itself.  Other input columns are not read.  An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, written
from .token_ids import token_counts

CAPACITIES = (512, 1024, 2048, 4096, 8192)
_ALIKE = 10_000              # rows of one id and length that are made at a time


def sequence_cost(capacity: int) -> float:
    """Cost of training on one sequence: a fixed part, a part in proportion,
    and attention, which grows with the square."""
    return 128 + capacity + capacity * capacity / 65536


def _pack(lengths: list[int], capacities: tuple[int, ...], costs: dict[int, float],
          least: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, room used of each bin); ``lengths`` fall."""
    left = sum(lengths)
    rooms: list[int] = []                    # the different amounts of free room, ascending
    by_room: dict[int, list[int]] = {}       # free room -> bins, the oldest on top
    where, used = [], []
    for n in lengths:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = heapq.heappop(by_room[room])
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room = min((c for c in capacities if c >= max(n, least)),
                       key=lambda c: (costs[c] / min(c, max(left, 1)), c))
            b = len(used)
            used.append(0)
        where.append(b)
        used[b] += n
        left -= n
        if room > n:
            if room - n not in by_room:
                insort(rooms, room - n)
                by_room[room - n] = []
            heapq.heappush(by_room[room - n], b)
    return where, used


def best_fit(lengths: list[int], capacities: tuple[int, ...],
             cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, used, final capacity of each bin) of the cheapest plan."""
    costs = {c: cost(c) for c in capacities}
    best = None
    for least in capacities:
        where, used = _pack(lengths, capacities, costs, least)
        final = [capacities[bisect_left(capacities, u)] for u in used]
        total = sum(costs[c] for c in final)
        if best is None or total < best[0]:
            best = total, where, used, final
    return best[1:]


def pack_lengths(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens",
                 capacities=CAPACITIES, cost: Callable[[int], float] = sequence_cost,
                 shard_pieces: int = 50_000) -> DataFrame:
    """One row per piece: id, ``piece`` (its number in the document), ``start``
    and ``length`` in tokens, ``bin_id``, ``bin_offset``, ``capacity`` (final)
    and ``bin_used``."""
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    src = written(lengths.select(
        col(id_col).alias("id"), F.coalesce(col(length_col), F.lit(0)).cast("long").alias("n")),
        "packing-lengths")
    # rows of one id and length are alike; they are numbered, however the table is
    # partitioned, and made again in groups that no task holds whole
    alike = src.filter("n > 0").groupBy("id", "n").agg(F.count(F.lit(1)).alias("rows"))
    tens = alike.select("id", "n", "rows", F.explode(F.sequence(
        F.lit(0), F.expr(f"(rows - 1) div {_ALIKE}"))).alias("ten"))
    cut = tens.select("id", "n", F.explode(F.sequence(
        F.col("ten") * _ALIKE, F.least(F.col("ten") * _ALIKE + _ALIKE, F.col("rows")) - 1)).alias("place"))
    cut = cut.select("id", "place", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {top}"))
                                                   ).alias("piece"))
    cut = cut.select("id", "place", "n", "piece", (F.col("piece") * top).alias("start"),
                     F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("length"))
    n_pieces = src.filter("n > 0").agg(F.sum(F.expr(f"(n - 1) div {top} + 1"))).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "n", "place"), F.lit(shards)))
    id_field = T.StructField("id", src.schema["id"].dataType)
    schema = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in (
        "piece", "start", "length", "bin_id", "bin_offset", "capacity", "bin_used"))])

    def pack(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[
            ("length", "descending"), ("id", "ascending"), ("piece", "ascending"),
            ("n", "ascending"), ("place", "ascending")])
        group = group.take(order)
        sizes = group["length"].to_pylist()
        where, used, final = best_fit(sizes, capacities, cost)
        filled = [0] * len(used)
        offsets = []
        for b, n in zip(where, sizes):
            offsets.append(filled[b])
            filled[b] += n
        at = np.array(where, np.int64)
        return pa.table({
            "id": group["id"], "piece": group["piece"], "start": group["start"],
            "length": group["length"], "bin_id": (group["shard"][0].as_py() << 32) + at,
            "bin_offset": np.array(offsets, np.int64), "capacity": np.array(final, np.int64)[at],
            "bin_used": np.array(used, np.int64)[at]})

    placed = dealt.select("shard", "id", "n", "place", F.col("piece").cast("long"), "start",
                          "length").groupBy("shard").applyInArrow(pack, schema)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    unplaced = src.filter("n <= 0").select(
        "id", zero.alias("piece"), zero.alias("start"), zero.alias("length"),
        none.alias("bin_id"), none.alias("bin_offset"), none.alias("capacity"),
        none.alias("bin_used"))
    return placed.union(unplaced).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", **params) -> DataFrame:
    """``pack_lengths`` of the token counts of whole texts, each with its end id."""
    counts = token_counts(docs.select(col(id_col).alias("id"), col(text_col).alias("text")),
                          tokenizer_path, "text", extra=1)
    return pack_lengths(counts, "id", "n_tokens", **params).withColumnRenamed("id", id_col)
