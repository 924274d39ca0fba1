"""Group summaries, pivots and record profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    ex = set(exclude)
    return [c for c, t in df.dtypes if c not in ex and (t in _NUMERIC or t.startswith("decimal"))]


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of every numeric column per group (``groupby(k).mean()``)."""
    cols = list(cols) if cols is not None else numeric_columns(df, keys)
    return df.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])


def group_nonnull(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Non-null count of every column per group (``groupby(k).count()``)."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in set(keys)]
    return df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])


def mean_group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows / number of groups; a group with a null key is not counted
    as a group, its rows are (pandas ``len(df) / len(groupby)``)."""
    ks = list(keys)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(*[F.col(k) for k in ks]).alias("n_groups")) \
        .withColumn("mean_group_size", F.col("n_rows") / F.col("n_groups"))


def pivot_by(df: DataFrame, index: Sequence[str] | str, columns: str, value: str,
             agg: str = "sum", values: Sequence | None = None,
             round_to: int | None = None) -> DataFrame:
    """Long -> wide: one row per ``index``, one column per value of
    ``columns`` holding ``agg`` (sum or mean) of ``value``.

    Pass ``values`` to skip the extra job Spark runs to find them; rounding
    is half-even (pandas ``round``)."""
    index = [index] if isinstance(index, str) else list(index)
    g = df.groupBy(*index)
    p = g.pivot(columns, list(values)) if values is not None else g.pivot(columns)
    fn = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max,
          "count": F.count}[agg]
    out = p.agg(fn(value))
    if round_to is not None:
        out = out.withColumns({c: F.bround(F.col(c), round_to)
                               for c in out.columns if c not in set(index)})
    return out


def unpivot_years(wide: DataFrame, index: Sequence[str] | str, value: str,
                  year: str = "year") -> DataFrame:
    """Wide -> long: one row per index and year that has a value; the other
    columns of ``wide`` are named by their year."""
    ids = [index] if isinstance(index, str) else list(index)
    cols = [c for c in wide.columns if c not in set(ids)]
    if not cols:
        return wide.select(*ids, F.lit(None).cast("int").alias(year),
                           F.lit(None).cast("double").alias(value)).where(F.lit(False))
    long = wide.unpivot(ids, cols, year, value).where(F.col(value).isNotNull())
    return long.withColumn(year, F.col(year).cast("int"))


def record_profile(df: DataFrame, key: str | None = None, value: str = "value") -> DataFrame:
    """Rows -> (column, value) pairs, every value as text; keeps ``key``."""
    ids = [key] if key else []
    cols = [c for c in df.columns if c not in set(ids)]
    casted = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return casted.unpivot(ids, cols, "column_name", value)
