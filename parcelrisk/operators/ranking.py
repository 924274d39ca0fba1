"""Distributed running sums in a global order, and exact quantiles.

A global cumulative sum written as ``Window.orderBy(x)`` moves every row to
one partition.  ``prefix_sums`` instead range-partitions the rows by (group,
order value) -- Spark samples the bounds -- and checkpoints them with the
number of their range, so that a recomputed partition cannot land in a
different one.  One total per (group, range) is prefix-summed (at most groups
+ ranges rows, partitioned by group) and joined back, and a window by (group,
range) adds the running sum within the range.  No side is marked for
broadcast: AQE decides by measured size.

``row_numbers`` gives every row its position in a total order in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelrisk.functions.scalars import nan_to_null
from parcelrisk.session import checkpoint_dir

_B = "_pr_range"


def null_safe(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition that lets null keys meet."""
    return reduce(lambda x, y: x & y, [a[l].eqNullSafe(b[r]) for l, r in pairs])


def prefix_sums(df: DataFrame, order_col: str, weights: Sequence[str],
                group_cols: Sequence[str] = (), descending: bool = False,
                next_of: Sequence[str] = ()) -> DataFrame:
    """Add ``_cum_<w>`` (inclusive running sum of ``w`` in the order of
    ``order_col`` within ``group_cols``), ``_tot_<w>`` (group total), and for
    the columns ``next_of`` ``_next_<c>``, the value in the row that follows.

    Rows must be unique per (group_cols, order_col), e.g. an aggregate by
    distinct value.  Null groups are groups like others; infinite order values
    are sorted as numbers.
    """
    group_cols = list(group_cols)
    checkpoint_dir(df.sparkSession)
    tagged = df.repartitionByRange(*group_cols, order_col) \
        .withColumn(_B, F.spark_partition_id()).checkpoint(eager=True)

    first = (F.max_by if descending else F.min_by)
    totals = tagged.groupBy(*group_cols, _B).agg(
        *[F.sum(w).alias(f"_bt_{w}") for w in weights],
        *[first(F.struct(c), order_col).alias(f"_bf_{c}") for c in next_of])
    by_group = Window.partitionBy(*group_cols)
    in_order = by_group.orderBy(F.col(_B).desc() if descending else F.col(_B).asc())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_og{i}") for i, c in enumerate(group_cols)],
        F.col(_B).alias("_ob"),
        *[F.coalesce(F.sum(f"_bt_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weights],
        *[F.sum(f"_bt_{w}").over(by_group).alias(f"_tot_{w}") for w in weights],
        *[F.lead(f"_bf_{c}").over(in_order).alias(f"_nf_{c}") for c in next_of])
    on = null_safe(tagged, offsets, [(c, f"_og{i}") for i, c in enumerate(group_cols)]
                   + [(_B, "_ob")])
    out = tagged.join(offsets, on, "inner")

    ocol = F.col(order_col).desc() if descending else F.col(order_col).asc()
    within = Window.partitionBy(*group_cols, _B).orderBy(ocol)
    run = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns(
        {f"_cum_{w}": F.sum(w).over(run) + F.col(f"_off_{w}") for w in weights}
        | {f"_next_{c}": F.coalesce(F.lead(F.struct(c)).over(within), F.col(f"_nf_{c}"))[c]
           for c in next_of})
    return out.drop("_ob", _B, *[f"_og{i}" for i in range(len(group_cols))],
                    *[f"_off_{w}" for w in weights], *[f"_nf_{c}" for c in next_of])


def value_sums(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """The distinct values ``_v`` of each group with their multiplicity ``_w``
    and running sums.  Null and NaN are one null value of weight 0, so that
    groups without values stay."""
    v = nan_to_null(F.col(col).cast("double"))
    vals = df.groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_v", F.when(F.col("_v").isNull(), F.lit(0)).otherwise(F.col("_n"))
        .cast("bigint").alias("_w"))
    vals = vals.withColumn("_wv", F.coalesce(F.col("_v") * F.col("_w"), F.lit(0.0)))
    return prefix_sums(vals, "_v", ["_w", "_wv"], by)


def quantile_aggregates(probs: Sequence[float], names: Sequence[str]):
    """(aggregates over ``value_sums``, columns of their results): quantiles
    with linear interpolation."""
    first = F.col("_cum__w") - F.col("_w")          # 0-based first rank held by the row
    aggs, cols = [], []
    for p, name in zip(probs, names):
        h = (F.col("_tot__w") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.max(F.when((lo >= first) & (lo < F.col("_cum__w")), F.col("_v"))).alias(f"_lo_{name}"),
                 F.max(F.when((hi >= first) & (hi < F.col("_cum__w")), F.col("_v"))).alias(f"_hi_{name}"),
                 F.max(h - lo).alias(f"_fr_{name}")]
        step = F.when(F.col(f"_hi_{name}") == F.col(f"_lo_{name}"), F.lit(0.0)).otherwise(
            (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_fr_{name}"))
        cols.append((F.col(f"_lo_{name}") + step).alias(name))
    return aggs, cols


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy 'linear', SQL
    ``percentile_cont``), one row per group, columns ``names``.

    Works on the distinct values of each group with their multiplicity, so a
    hot group costs its number of distinct values, spread over the ranges,
    never one task holding the group.  Nulls and NaN are ignored; a group
    without other values has null quantiles.
    """
    by = list(by)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    aggs, cols = quantile_aggregates(probs, names)
    return value_sums(df, col, by).groupBy(*by).agg(*aggs).select(*by, *cols)


def row_numbers(df: DataFrame, order: Sequence, out: str = "row_number") -> DataFrame:
    """Add ``out``: the 0-based position of each row in ``order`` (columns
    or sort expressions; rows tied on all of them get distinct positions in
    an arbitrary but fixed order, so pass a key for a reproducible result).

    The sort range-partitions the rows over all tasks, so a value shared by
    a third of the rows is spread over many ranges.  The sorted rows are
    tagged with their partition and position and checkpointed to the shared
    checkpoint folder: the range bounds come from a sample, and without the
    checkpoint a re-run partition (lost executor, second read) could fall
    into different ranges.  The per-partition counts -- one row per sorted
    partition, bounded by the shuffle partition count -- are prefix-summed
    and joined back.
    """
    checkpoint_dir(df.sparkSession)
    tagged = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_pr_pid"),
        F.monotonically_increasing_id().alias("_pr_mid")).checkpoint(eager=True)
    per = tagged.groupBy("_pr_pid").agg(F.count(F.lit(1)).alias("_pr_n"),
                                        F.min("_pr_mid").alias("_pr_first"))
    before = Window.orderBy("_pr_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pr_pid", "_pr_first",
                         F.coalesce(F.sum("_pr_n").over(before), F.lit(0)).alias("_pr_off"))
    pos = F.col("_pr_off") + F.col("_pr_mid") - F.col("_pr_first")
    return tagged.join(offsets, on="_pr_pid", how="inner") \
        .withColumn(out, pos.cast("bigint")) \
        .drop("_pr_pid", "_pr_mid", "_pr_first", "_pr_off")
