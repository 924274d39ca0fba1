"""Profiles that add up: counts, distinct counts and quantiles of groups, stored as
sketches and merged when asked for.

A profile is taken once per stored group (say, year and area) with Spark's
HyperLogLog and KLL sketches, a few KB per group and column whatever the number
of rows.  Any coarser question (per year, per area, all) merges the sketches of
its groups and never reads the rows again.

Stated errors: a distinct count is within ``distinct_error(lg_k)`` (three standard
errors of the union of HLL sketches, 3 * 0.833 / sqrt(2 ** lg_k)) of the exact one; a
quantile is a value whose rank is within ``rank_error(k)`` of the one asked for,
with 99 % confidence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.functions.scalars import nan_to_null
from parcelrisk.sources.sinks import write_partitions


def distinct_error(lg_k: int = 12) -> float:
    return 3 * 0.833 / math.sqrt(2 ** lg_k)


def rank_error(k: int = 200) -> float:
    """The published normalised rank error of KLL for one quantile, with a margin
    for merges."""
    return 2 * 2.296 / k ** 0.9021


def sketch_profile(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (),
                   quantiles: Sequence[str] = (), lg_k: int = 12, k: int = 200) -> DataFrame:
    """One row per group: ``n_rows``; for each column of ``distinct`` ``<c>_hll``; for each
    of ``quantiles`` ``<c>_kll`` (null without a value; null and NaN don't count)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in distinct:
        aggs.append(F.hll_sketch_agg(F.col(c), F.lit(lg_k)).alias(f"{c}_hll"))
    for c in quantiles:
        v = nan_to_null(F.col(c).cast("double"))
        aggs.append(F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, F.lit(k))).alias(f"{c}_kll"))
    return df.groupBy(*by).agg(*aggs)


def store_profile(profile: DataFrame, path: str, by: Sequence[str] = ("year",)) -> str:
    """Write profiles in one folder per value of ``by``; a recomputed value replaces its
    folder only."""
    return write_partitions(profile, path, by)


def merge_profiles(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profiles of the coarser groups ``by`` (none: of all rows)."""
    aggs = [F.sum("n_rows").alias("n_rows")]
    for c in profile.columns:
        if c.endswith("_hll"):
            aggs.append(F.hll_union_agg(c).alias(c))
        elif c.endswith("_kll"):
            aggs.append(F.when(F.count(c) > 0, F.kll_merge_agg_double(c)).alias(c))
    return profile.groupBy(*by).agg(*aggs)


def read_profile(profile: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The numbers of a profile: ``<c>_distinct``, and ``<c>_q25`` and so on."""
    out = []
    for c in profile.columns:
        if c.endswith("_hll"):
            out.append(F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(f"{c[:-4]}_distinct"))
        elif c.endswith("_kll"):
            out += [F.kll_sketch_get_quantile_double(c, F.lit(p)).alias(f"{c[:-4]}_q{round(p * 100)}")
                    for p in probs]
        else:
            out.append(F.col(c))
    return profile.select(*out)
