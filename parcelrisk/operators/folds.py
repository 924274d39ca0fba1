"""Reproducible folds and splits from a hash of the key.

``fold = int(first 8 hex digits of md5(key || '#' || seed)) mod k``.  The
value depends only on the key and the seed, so it is the same after any
repartition, recompute after a lost executor, or rerun -- unlike ``rand()``
-- and any SQL engine with ``md5`` reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_unit(key, seed: int = 0) -> Column:
    """A number in [0, 2^32) from the key, as bigint; null counts as an empty key."""
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    h = F.md5(F.concat(k, F.lit(f"#{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def assign_folds(df: DataFrame, key: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Add ``out`` in 0..k-1, uniform over keys."""
    return df.withColumn(out, (hash_unit(key, seed) % F.lit(k)).cast("int"))


def hash_split(df: DataFrame, key: str, fraction: float, seed: int = 0,
               out: str = "is_train") -> DataFrame:
    """Add ``out`` = 1 for about ``fraction`` of the keys (train), else 0."""
    cut = int(round(fraction * 10000))
    return df.withColumn(out, ((hash_unit(key, seed) % F.lit(10000)) < F.lit(cut)).cast("int"))


def fold_train(df: DataFrame, i: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) != F.lit(i))


def fold_test(df: DataFrame, i: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) == F.lit(i))


def fold_balance(df: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """Rows, positives and positive rate per fold."""
    y = F.col(label).cast("double")
    return df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(y).cast("bigint").alias("n_pos"),
        F.avg(y).alias("pos_rate"))
