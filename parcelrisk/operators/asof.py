"""As-of joins: the attributes that were valid at a time, and a table per year.

Both sides are put in one order of (key, time) by ranges, so a key with a third
of all rows lies in many ranges.  Within a range a window per key carries the
last attributes on; a range begins with what the ranges before it know of its
first key, which takes one row per range (the totals of ``ranking.prefix_sums``
in another guise).  Rows meet no pairs, and nothing is broadcast by a hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelrisk.operators.ranking import null_safe
from parcelrisk.session import checkpoint_dir

_R, _K, _T, _S, _V, _C = "_pr_range", "_pr_key", "_pr_time", "_pr_side", "_pr_values", "_pr_carry"


def asof_join(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str,
              right_time: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """``left`` with the columns ``values`` of the latest row of ``right`` with its
    key and a time up to its own (before it if ``strict``); null without one.

    Of several right rows of one time the one with the greatest values (in the
    order given) counts.  Rows of ``left`` without a key or a time stay, without
    values.  The row count is that of ``left``; its columns may not be named
    like ``values``."""
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    checkpoint_dir(left.sparkSession)
    own = F.struct(*[F.col(c) for c in left.columns])
    # null keys and times sort first, where no right row is
    a = left.select(F.col(left_key).alias(_K), F.col(left_time).alias(_T),
                    F.lit(0 if strict else 1).alias(_S), own.alias("_pr_row"))
    b = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(right_key).alias(_K), F.col(right_time).alias(_T), F.lit(1 if strict else 0).alias(_S),
        F.struct(*[F.col(c) for c in values]).alias(_V))
    order = [_K, _T, _S, _V]
    both = a.unionByName(b, allowMissingColumns=True).repartitionByRange(*order) \
        .withColumn(_R, F.spark_partition_id()).checkpoint(eager=True)

    # one row per range: its first key, its last key, and the last values of that
    last_key = F.max(_K)
    ends = both.groupBy(_R).agg(F.min(_K).alias("_first"), last_key.alias("_last"))
    at_end = both.where(F.col(_V).isNotNull()).groupBy(_R).agg(
        F.max(F.struct(_K, _T, _V)).alias("_m")).select(
        F.col(_R).alias("_from"), F.col("_m")[_K].alias("_of"), F.col("_m")[_V].alias(_C))
    # a range hands on the values of its last key only: later ranges begin with it
    begins = ends.select(_R, "_first").join(at_end, (F.col("_first") == F.col("_of")) & (F.col("_from") < F.col(_R)))
    carry = begins.groupBy(_R, "_first").agg(F.max_by(_C, "_from").alias(_C)).select(
        F.col(_R).alias("_cr"), F.col("_first").alias("_ck"), _C)

    w = Window.partitionBy(_R, _K).orderBy(F.asc(_T), F.asc(_S), F.asc(_V)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumn(_V, F.last(_V, ignorenulls=True).over(w)).where("_pr_row is not null")
    out = run.join(carry, null_safe(run, carry, [(_R, "_cr"), (_K, "_ck")]), "left")
    known = F.col(_T).isNotNull()
    got = F.when(known, F.coalesce(F.col(_V), F.col(_C)))
    return out.select(*[F.col("_pr_row")[c].alias(c) for c in left.columns],
                      *[got[c].alias(c) for c in values])


def year_grid(entities: DataFrame, key: str, first_year: str, last_year: int) -> DataFrame:
    """(key, year, ``as_of``): each entity in each year from its first to
    ``last_year``; ``as_of`` is the first moment of the next year, so a strict as-of join
    gives the state at the end of the year."""
    g = entities.select(key, F.explode(F.sequence(F.col(first_year), F.lit(last_year))).alias("year"))
    return g.withColumn("as_of", F.make_timestamp_ntz(
        F.col("year") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def yearly_state(history: DataFrame, key: str, time: str, values: Sequence[str],
                 last_year: int) -> DataFrame:
    """(key, year, values): the state of each entity at the end of each year, from
    the year of its first record to ``last_year``."""
    first = history.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.year(time)).alias("_pr_first")).where(F.col("_pr_first") <= last_year)
    grid = year_grid(first, key, "_pr_first", last_year)
    h = history.withColumn(time, F.col(time).cast("timestamp_ntz"))
    return asof_join(grid, h, key, "as_of", key, time, values, strict=True).drop("as_of")
