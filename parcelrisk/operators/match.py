"""Joins and membership: label by existence, semi / anti matching, staged
matching over several universes, batch lookups.

Key columns are normalised (lower case by default) on both sides.  The key
side is reduced to its distinct normalised keys before the join, so a hot key
costs one row after the map-side partial aggregation, the join never fans
out, and AQE can broadcast the key side when its measured size is small or
split skewed partitions of the entity side when it is not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Normaliser = Callable[[Column], Column] | None


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _norm(c: Column, normalise: Normaliser) -> Column:
    return normalise(c) if normalise is not None else c


def _key_names(n: int) -> list[str]:
    return [f"_pr_k{i}" for i in range(n)]


def _with_keys(df: DataFrame, on: Sequence[str], normalise: Normaliser) -> DataFrame:
    return df.withColumns({k: _norm(F.col(c), normalise) for k, c in zip(_key_names(len(on)), on)})


_SALT = "_pr_salt"


def _left_keys(df: DataFrame, on: Sequence[str], normalise: Normaliser) -> tuple[DataFrame, list[str]]:
    """``df`` with its join keys.  A row without a key matches nothing; the
    salt, 0 on the other side, spreads such rows over the join's tasks."""
    ks = _key_names(len(on))
    plain = [F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    df = _with_keys(df, on, normalise)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ks])
    spread = F.pmod(F.xxhash64(*plain), F.lit(4096)).cast("int") + 1
    return df.withColumn(_SALT, F.when(known, F.lit(0)).otherwise(spread)), [*ks, _SALT]


def _distinct_keys(keys_df: DataFrame, on: Sequence[str], normalise: Normaliser) -> DataFrame:
    ks = _key_names(len(on))
    return keys_df.select(*[_norm(F.col(c), normalise).alias(k) for k, c in zip(ks, on)]) \
        .where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ks])) \
        .distinct()


def join_on(left: DataFrame, right: DataFrame, left_on, right_on, how: str = "inner") -> DataFrame:
    """Equi-join on columns with different names (``merge(left_on, right_on)``)."""
    lo, ro = _cols(left_on), _cols(right_on)
    cond = [left[a] == right[b] for a, b in zip(lo, ro)]
    return left.join(right, on=cond, how=how)


def flag_membership(df: DataFrame, keys_df: DataFrame, left_on, right_on=None,
                    normalise: Normaliser = F.lower, out: str = "TARGET") -> DataFrame:
    """Add ``out`` = 1 when the (normalised) key of a row appears in
    ``keys_df``, else 0 (null key -> 0).  Row count is unchanged."""
    lo = _cols(left_on)
    ro = _cols(right_on) if right_on is not None else lo
    keys = _distinct_keys(keys_df, ro, normalise).withColumns({"_pr_hit": F.lit(1), _SALT: F.lit(0)})
    left, ks = _left_keys(df, lo, normalise)
    joined = left.join(keys, on=ks, how="left")
    return joined.withColumn(out, F.coalesce(F.col("_pr_hit"), F.lit(0))).drop("_pr_hit", *ks)


def matched(df: DataFrame, keys_df: DataFrame, left_on, right_on=None,
            normalise: Normaliser = F.lower) -> DataFrame:
    """Rows of ``df`` whose key is found in ``keys_df`` (left semi join;
    duplicates on the left are kept)."""
    lo = _cols(left_on)
    ro = _cols(right_on) if right_on is not None else lo
    ks = _key_names(len(lo))
    return _with_keys(df, lo, normalise) \
        .join(_distinct_keys(keys_df, ro, normalise), on=ks, how="left_semi").drop(*ks)


def unmatched(df: DataFrame, keys_df: DataFrame, left_on, right_on=None,
              normalise: Normaliser = F.lower) -> DataFrame:
    """Rows of ``df`` whose key is not found (left anti join; a null key is
    never found, unlike ``NOT IN``)."""
    lo = _cols(left_on)
    ro = _cols(right_on) if right_on is not None else lo
    left, ks = _left_keys(df, lo, normalise)
    keys = _distinct_keys(keys_df, ro, normalise).withColumn(_SALT, F.lit(0))
    return left.join(keys, on=ks, how="left_anti").drop(*ks)


def staged_match(df: DataFrame, universes: Sequence[DataFrame], left_on, right_on=None,
                 normalise: Normaliser = F.lower, out: str = "stage") -> DataFrame:
    """Try each row against universe 1, then the unmatched against universe
    2, and so on; ``out`` is the 1-based first stage that matched, or null.

    All universes are reduced to (key, first stage) in one aggregation, then
    joined once; the row count of ``df`` is unchanged."""
    lo = _cols(left_on)
    ro = _cols(right_on) if right_on is not None else lo
    ks = _key_names(len(lo))
    staged = None
    for i, u in enumerate(universes, start=1):
        part = _distinct_keys(u, ro, normalise).withColumn("_pr_stage", F.lit(i))
        staged = part if staged is None else staged.unionByName(part)
    first = staged.groupBy(*ks).agg(F.min("_pr_stage").alias(out)).withColumn(_SALT, F.lit(0))
    left, ks = _left_keys(df, lo, normalise)
    return left.join(first, on=ks, how="left").drop(*ks)


def attach(df: DataFrame, universe: DataFrame, left_on, right_on, value: str,
           normalise: Normaliser = F.lower, out: str | None = None) -> DataFrame:
    """Add the ``value`` (say, the area id) that ``universe`` has for a row's
    key; null without a match.  Of several values the smallest is taken, so
    the row count is unchanged."""
    lo, ro = _cols(left_on), _cols(right_on)
    ks = _key_names(len(lo))
    out = out or value
    pairs = universe.select(*[_norm(F.col(c), normalise).alias(k) for k, c in zip(ks, ro)],
                            F.col(value).alias(out))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ks])
    one = pairs.where(known).groupBy(*ks).agg(F.min(out).alias(out)).withColumn(_SALT, F.lit(0))
    left, ks = _left_keys(df, lo, normalise)
    return left.join(one, on=ks, how="left").drop(*ks)


def later_outcome(scores: DataFrame, events: DataFrame, score_key: str, event_key: str,
                  scored_at, event_time: str, normalise: Normaliser = F.lower,
                  out: str = "outcome") -> DataFrame:
    """Stored scores with what happened after them: ``out`` = 1 when the key
    has an event later than ``scored_at`` (a column of ``scores`` or a
    literal), else 0."""
    last = events.where(F.col(event_key).isNotNull()).groupBy(
        _norm(F.col(event_key), normalise).alias("_pr_k0")).agg(F.max(event_time).alias("_pr_last"))
    left, ks = _left_keys(scores, [score_key], normalise)
    at = F.col(scored_at) if scored_at in scores.columns else F.lit(scored_at)
    joined = left.join(last.withColumn(_SALT, F.lit(0)), on=ks, how="left")
    hit = F.coalesce(F.col("_pr_last") > at, F.lit(False))
    return joined.withColumn(out, hit.cast("int")).drop("_pr_last", *ks)


def match_report(staged: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Rows per stage (null = never matched)."""
    return staged.groupBy(stage_col).agg(F.count(F.lit(1)).alias("n_rows"))


def match_summary(staged: DataFrame, n_stages: int, stage_col: str = "stage") -> DataFrame:
    """For each stage 1..n: rows matched at that stage and rows still
    unmatched after it (the counts printed after each matching pass).  One
    aggregate of the staged rows; the output has ``n_stages`` rows."""
    s = F.col(stage_col)
    aggs = []
    for i in range(1, n_stages + 1):
        aggs += [F.sum((s == i).cast("int")).cast("bigint").alias(f"m{i}"),
                 F.sum((s.isNull() | (s > i)).cast("int")).cast("bigint").alias(f"u{i}")]
    one = staged.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("matched"),
                              F.coalesce(F.col(f"u{i}"), F.lit(0)).alias("unmatched_after"))
                     for i in range(1, n_stages + 1)])
    return one.select(F.inline(rows))


def batch_lookup(keys_df: DataFrame, df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows of ``df`` (projected to ``key`` + ``cols``) for every key in
    ``keys_df``: one semi join instead of one point lookup per key."""
    return df.select(key, *cols).join(keys_df.select(key).distinct(), on=key, how="left_semi")
