"""Row filters, flag columns, lookups, ordering and union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.functions.scalars import bool_to_int, flag, nan_to_null
from parcelrisk.operators.ranking import null_safe
from parcelrisk.session import checkpoint_dir


def flag_columns(df: DataFrame, cols: Sequence[str], true_value="Y") -> DataFrame:
    """Y/N style columns -> 0/1 in one projection.  A name listed twice is
    converted once (applying the rule again would clear every flag)."""
    seen = list(dict.fromkeys(cols))
    return df.withColumns({c: flag(c, true_value) for c in seen})


def bool_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Boolean columns -> 0/1 with null -> 0."""
    return df.withColumns({c: bool_to_int(c) for c in dict.fromkeys(cols)})


def fill_null(df: DataFrame, values: dict) -> DataFrame:
    """Replace nulls per column with a literal (``fillna``)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows whose key equals ``value``; a Parquet scan prunes row groups by
    min/max statistics on the pushed equality."""
    return df.where(F.col(key) == F.lit(value))


def _order(cols: Sequence, ascending: bool) -> list[Column]:
    out = []
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        out.append(col.asc_nulls_last() if ascending else col.desc_nulls_last())
    return out


def sort_nulls_last(df: DataFrame, cols: Sequence[str], ascending: bool = True) -> DataFrame:
    """Sort with NaN and null last in both directions (pandas)."""
    fixed = df.withColumns({c: nan_to_null(c) for c in cols
                            if dict(df.dtypes)[c] in ("double", "float")})
    return fixed.orderBy(*_order(cols, ascending))


def top_k(df: DataFrame, col: str, k: int, tie_break: Sequence[str],
          ascending: bool = False) -> DataFrame:
    """The first ``k`` rows by ``col`` (NaN / null last), ties broken by
    ``tie_break`` so the result is a total order.  Plans to
    TakeOrderedAndProject: a bounded top-k per partition, then a merge."""
    d = dict(df.dtypes)
    fixed = df.withColumn(col, nan_to_null(col)) if d[col] in ("double", "float") else df
    return fixed.orderBy(*_order([col], ascending), *_order(tie_break, True)).limit(k)


def row_at(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """The row at 0-based position ``n`` of an order (``iloc[n]``; file order
    is not defined in Spark, so the order is explicit).  Ties are ordered by a
    hash of the whole row, so there is one row for every n below the row count.

    The order columns and the hash are dealt to ranges of the order and counted;
    only the range that holds position n is sorted, and the one key found there
    picks its row by a null-safe semi join."""
    order = _order(order_cols, True)
    plain = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f.name)
             for f in df.schema]
    h = {"_pr_h1": F.xxhash64(*plain), "_pr_h2": F.xxhash64(F.lit(1), *plain)}
    keys = [*order_cols, *h]
    tagged = df.withColumns(h)
    checkpoint_dir(df.sparkSession)
    # checkpointed: the bounds of the ranges come from a sample
    ranges = tagged.select(*dict.fromkeys(keys)).repartitionByRange(*order, *h) \
        .withColumn("_pr_range", F.spark_partition_id()).checkpoint(eager=True)
    before, holds = 0, -1
    for r in ranges.groupBy("_pr_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_pr_range").collect():
        if n < before + r["n"]:                                    # one row per range
            holds = r["_pr_range"]
            break
        before += r["n"]
    at = ranges.where(F.col("_pr_range") == F.lit(holds)).orderBy(*order, *h).offset(max(n - before, 0)).limit(1)
    at = at.select(*[F.col(c).alias(f"_pr_at{i}") for i, c in enumerate(keys)])
    on = null_safe(tagged, at, [(c, f"_pr_at{i}") for i, c in enumerate(keys)])
    # exact repeats of the row have the same key: one of them is the result
    return tagged.join(at, on, "left_semi").drop(*h).limit(1)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
