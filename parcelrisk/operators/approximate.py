"""Approximate matching of texts (old addresses with a slip in them) by edit
distance, without comparing all pairs.

Two texts within ``distance`` edits of each other become the same when each loses
what the other lacks and the characters that are exchanged are blotted out.  The
lengths say how many of either go together, so texts meet by the hash of what is left,
however alike they all are: numbers in a row share nearly every gram, but meet in this
way only where they are near.  That makes ``distance`` out of the length many rows of
a text, so longer texts meet by grams.

Two texts within ``distance`` edits of each other share nearly all ``q``-grams, at
places that differ by ``distance`` at most: an edit spoils ``q`` of them at most.
Sort the grams of each text in one common order.  The first that is common to
both, in place, is among the first ``q * distance + 1`` of either text, as what
stands before it was spoiled.  So a text meets others by these grams only.  The
order goes by rarity in the universe: a frequent gram makes a large block only
for texts that consist of such grams, and no block is cut off.  Two texts too
short for that to say anything (``q * (distance + 1) - 1`` characters or fewer)
always meet by what is left of them.  What meets is compared by its exact edit
distance, so the result is that of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.operators.match import _SALT, Normaliser, _left_keys, _norm
from parcelrisk.session import checkpoint_dir


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """(text, gram, place): the q-grams of each text."""
    return texts.where(F.length("text") >= q).select(
        "text", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text") - (q - 1)),
                                         lambda i: F.substring("text", i, F.lit(q)))).alias("place", "gram"))


def _rarest(grams: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """(text, gram, place) of the first ``n`` grams of each text, rare ones first."""
    ranked = grams.join(seen, "gram", "left").select(
        "text", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram", "place").alias("g"))
    # the grams of one text, so at most its length
    first = ranked.groupBy("text").agg(F.slice(F.sort_array(F.collect_list("g")), 1, n).alias("gs"))
    return first.select("text", F.explode("gs").alias("g")).select("text", "g.gram", "g.place")


def _brief(distance: int, q: int) -> int:
    """The length up to which texts meet by what is left of them: 2 ** 14 characters in
    all ways to choose ``distance`` places."""
    n = 1
    while (n + 1) * math.comb(n + 1, distance) <= 1 << 14:
        n += 1
    return max(n, q * (distance + 1) - 1)


def _losses(other: DataFrame, distance: int) -> DataFrame:
    """(size, longest, drop, blot): how many characters a text of a size loses, and has
    blotted out, to meet the texts of ``other`` with which the longer has the size
    ``longest``."""
    near = other.select(F.length("text").alias("o")).distinct().select(
        "o", F.explode(F.sequence(F.greatest(F.col("o") - distance, F.lit(0)), F.col("o") + distance)).alias("size"))
    apart, shorter = F.abs(F.col("o") - F.col("size")), F.least("o", "size")
    ways = near.withColumn("lost", F.explode(F.sequence(F.lit(0), F.least(
        shorter, F.floor((F.lit(distance) - apart) / 2).cast("int")))))          # by the shorter
    return ways.select(
        "size", F.greatest("o", "size").alias("longest"),
        (F.col("lost") + F.greatest(F.col("size") - F.col("o"), F.lit(0))).alias("drop"),
        F.least(F.lit(distance) - apart - 2 * F.col("lost"), shorter - F.col("lost")).alias("blot")).distinct()


def _left_over(texts: DataFrame, other: DataFrame, distance: int, name: str) -> DataFrame:
    """(``name``, rest): the hash of what is left of each text, in all ways in which it
    may meet a text of ``other``."""
    # few bytes of text make many rows: they are dealt anew, and not coalesced by their size
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(tasks, F.xxhash64("text")).withColumn("size", F.length("text"))
    rows = dealt.join(F.broadcast(_losses(other, distance)), "size").select(
        F.col("text").alias(name), "longest", "drop", "blot", F.col("blot").alias("blots"),
        F.col("text").alias("rest"), F.lit(0).alias("at"))
    for _ in range(distance):
        drops, blots = F.col("drop") > 0, (F.col("drop") == 0) & (F.col("blot") > 0)
        to = F.when(drops, F.length("rest") - F.col("drop")) \
            .when(blots, F.length("rest") - F.col("blot")).otherwise(F.col("at"))
        # places ascend, and of the characters of a run the first ones are lost
        rows = rows.withColumn("i", F.explode(F.sequence("at", to))).where(~drops | (F.col("i") == F.col("at")) | (
            F.substring("rest", F.col("i"), F.lit(1)) != F.substring("rest", F.col("i") + 1, F.lit(1))))
        before, after = (F.substring("rest", F.lit(1), F.col("i")),
                         F.substring("rest", F.col("i") + 2, F.length("rest")))
        rows = rows.select(
            name, "longest", "blots", F.greatest(F.col("drop") - 1, F.lit(0)).alias("drop"),
            F.when(blots, F.col("blot") - 1).otherwise(F.col("blot")).alias("blot"),
            F.when(drops, F.concat(before, after)).when(blots, F.concat(before, F.lit("\0"), after))
            .otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("drop") > 1, F.col("i")).when(drops, F.lit(0)).otherwise(F.col("i") + 1).alias("at"))
    return rows.select(name, F.xxhash64("rest", "longest", "blots").alias("rest"))


def _near_pairs(left: DataFrame, right: DataFrame, distance: int, q: int) -> DataFrame:
    """The pairs of ``near_texts``, some of them repeated."""
    if distance < 0 or q < 1:
        raise ValueError("distance must be 0 or more, q 1 or more")
    a, b = left.select("text").distinct(), right.select("text").distinct()
    n, brief = q * distance + 1, _brief(distance, q)
    la, lb = (d.where(F.length("text") > brief - distance) for d in (a, b))
    ga, gb = _grams(la, q), _grams(lb, q)
    seen = gb.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))
    pa = _rarest(ga, seen, n).select(F.col("text").alias("left_text"), "gram",
                                     F.col("place").alias("left_place"))
    pb = _rarest(gb, seen, n).select(F.col("text").alias("right_text"), "gram",
                                     F.col("place").alias("right_place"))
    sizes = F.length("left_text"), F.length("right_text")
    met = pa.join(pb, "gram").where(
        (F.abs(F.col("left_place") - F.col("right_place")) <= distance)
        & (F.abs(sizes[0] - sizes[1]) <= distance) & (F.greatest(*sizes) > brief)).select("left_text", "right_text")
    sa, sb = (d.where(F.length("text") <= brief) for d in (a, b))
    few = _left_over(sa, sb, distance, "left_text").join(
        _left_over(sb, sa, distance, "right_text"), "rest").select("left_text", "right_text")
    # the distance first: fewer pairs are left to make distinct
    return met.unionByName(few).withColumn(
        "distance", F.levenshtein("left_text", "right_text", distance)).where("distance >= 0")


def near_texts(left: DataFrame, right: DataFrame, distance: int, q: int = 2) -> DataFrame:
    """(left_text, right_text, distance): all pairs of the distinct texts (column
    ``text``, not null) within ``distance`` edits."""
    return _near_pairs(left, right, distance, q).distinct()


def _nearest(texts: DataFrame, known: DataFrame, distance: int, q: int) -> DataFrame:
    """(text, distance, right_text): the nearest known text of each text that has one."""
    if distance == 0:
        same = known.select(F.col("text").alias("right_text"))
        return texts.join(same, F.col("text") == F.col("right_text")).select(
            "text", F.lit(0).alias("distance"), "right_text")
    best = _near_pairs(texts, known, distance, q).groupBy("left_text").agg(
        F.min(F.struct("distance", "right_text")).alias("best"))
    return best.select(F.col("left_text").alias("text"), "best.distance", "best.right_text")


def nearest_text(df: DataFrame, universe: DataFrame, left_on: str, right_on: str, value: str,
                 distances: Sequence[int], normalise: Normaliser = F.lower, q: int = 2,
                 out: str | None = None) -> DataFrame:
    """Add ``out`` (default the name of ``value``): the value of the universe's row
    whose text is nearest to that of a row; ``<out>_distance``, the edits between
    them; and ``<out>_stage``, the 1-based first of the ascending ``distances`` that
    is enough.  All three are null where no text is within the last distance.  Of
    equally near texts the smallest counts, of its values the smallest; the row
    count is unchanged.

    Each stage takes the texts that the stages before it have left over, so the
    wide search is made only for those that need it."""
    out = out or value
    known = universe.select(_norm(F.col(right_on), normalise).alias("text"), F.col(value).alias("_pr_v")) \
        .where("text is not null").groupBy("text").agg(F.min("_pr_v").alias("_pr_v"))
    checkpoint_dir(df.sparkSession)
    left = df.select(_norm(F.col(left_on), normalise).alias("text")).where("text is not null").distinct()
    found = None
    for stage, distance in enumerate(sorted(distances), start=1):
        one = _nearest(left, known, distance, q).withColumn("stage", F.lit(stage)).checkpoint()
        found = one if found is None else found.unionByName(one)
        left = left.join(one.select("text"), "text", "left_anti")
    hits = found.join(known.withColumnRenamed("text", "right_text"), "right_text").select(
        F.col("text").alias("_pr_t"), F.col("_pr_v").alias(out),
        F.col("distance").alias(f"{out}_distance"), F.col("stage").alias(f"{out}_stage"),
        F.lit(0).alias(_SALT))
    rows, (key, salt) = _left_keys(df, [left_on], normalise)
    return rows.join(hits, (rows[key] == hits["_pr_t"]) & (rows[salt] == hits[_SALT]), "left") \
        .select(*[rows[c] for c in df.columns], out, f"{out}_distance", f"{out}_stage")
