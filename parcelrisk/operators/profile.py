"""Profiling: value counts, distinct values, null profile, describe,
separation ratios, histograms and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.functions.scalars import epoch_seconds, nan_to_null
from parcelrisk.operators.ranking import null_safe, quantile_aggregates, value_sums


def nan_as_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN of the float columns (of ``cols``) as null: one policy for all
    statistics, which skip nulls."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")
              and (cols is None or c in cols)]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Count per value that is not null or NaN, most frequent first, ties by value."""
    df = nan_as_null(df, [col])
    return df.where(F.col(col).isNotNull()).groupBy(col) \
        .agg(F.count(F.lit(1)).alias(name)) \
        .orderBy(F.col(name).desc(), F.col(col).asc())


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values (null included, NaN as null), sorted."""
    return nan_as_null(df, [col]).select(col).distinct().orderBy(F.col(col).asc_nulls_last())


def distinct_count(df: DataFrame, col: str, approx: bool = False, name: str = "n_distinct") -> DataFrame:
    """Number of distinct values with null (and NaN) counted as one value."""
    df = nan_as_null(df, [col])
    has_null = F.coalesce(F.max(F.col(col).isNull().cast("int")), F.lit(0))
    if approx:
        n = F.approx_count_distinct(col)
    else:
        n = F.count_distinct(col)
    return df.agg((n + has_null).cast("bigint").alias(name))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: name, Spark type, null count (NaN is null) and non-null
    count, from a single aggregate over the table."""
    df = nan_as_null(df)
    aggs = []
    for c in df.columns:
        aggs += [F.count(F.lit(1)).alias(f"{c}__n"), F.count(F.col(c)).alias(f"{c}__nn")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"),
                 (F.col(f"{f.name}__n") - F.col(f"{f.name}__nn")).cast("bigint").alias("nulls"),
                 F.col(f"{f.name}__nn").cast("bigint").alias("non_nulls"))
        for f in df.schema.fields])
    return one.select(F.inline(rows))


def describe_by(df: DataFrame, col: str, by: Sequence[str] = (), approx: bool = False,
                accuracy: int = 10000) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation) and
    max of ``col``, overall or per group (pandas ``describe``).

    All of it comes from one table of distinct values with their multiplicity:
    the data are scanned once.  Null and NaN are skipped; the null group is a
    group, and a group without values has n = 0."""
    by = list(by)
    if approx:
        x = nan_to_null(F.col(col).cast("double"))
        q = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy)
        out = df.groupBy(*by).agg(
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), q.alias("_q"))
        return out.select(*by, "n", "mean", "std", "min", "max",
                          *[F.col("_q")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75"])])
    aggs, cols = quantile_aggregates([0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    v, w = F.col("_v"), F.col("_w")
    mean = F.col("_tot__wv") / F.nullif(F.col("_tot__w"), F.lit(0))
    out = value_sums(df, col, by).groupBy(*by).agg(
        F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("n"), F.max(mean).alias("mean"),
        F.sum(w * (v - mean) * (v - mean)).alias("_ss"), F.min(v).alias("min"),
        F.max(v).alias("max"), *aggs)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / F.nullif(F.col("n") - 1, F.lit(0))))
    return out.select(*by, "n", "mean", std.alias("std"), "min", "max", *cols)


def separation(df: DataFrame, score: str, label: str) -> DataFrame:
    """mean score of positives / negatives, their ratio, lift over the mean,
    base rate -- one aggregate.  Null and NaN scores are skipped; a ratio to a
    mean of zero is null."""
    s, y = nan_to_null(F.col(score).cast("double")), F.col(label)
    return df.agg(
        F.avg(F.when(y == 1, s)).alias("mean_pos"),
        F.avg(F.when(y == 0, s)).alias("mean_neg"),
        F.avg(s).alias("mean_all"),
        F.avg(y.cast("double")).alias("base_rate")) \
        .withColumn("ratio", F.col("mean_pos") / F.nullif(F.col("mean_neg"), F.lit(0.0))) \
        .withColumn("lift", F.col("mean_pos") / F.nullif(F.col("mean_all"), F.lit(0.0)))


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None,
              hi: float | None = None, by: Sequence[str] = (), density: bool = False) -> DataFrame:
    """Equal-width histogram with every bin present (``numpy.histogram``):
    bins [lo + i w, lo + (i+1) w), the last bin closed; values outside
    [lo, hi] are not counted.  ``lo``/``hi`` default to the data range (one
    aggregate, two numbers to the driver; infinite values don't widen it).
    ``density`` adds count / (n * width) with n the in-range count of the
    group.  Null and NaN are skipped; without values the
    range is [0, 1], or of width 1 from the bound that is given."""
    by = list(by)
    x = nan_to_null(F.col(col).cast("double"))
    if lo is None or hi is None:
        finite = F.when(F.abs(x) < F.lit(float("inf")), x)
        r = df.agg(F.min(finite), F.max(finite)).first()
        lo = r[0] if lo is None else lo
        hi = r[1] if hi is None else hi
    if lo is None and hi is None:
        lo, hi = 0.0, 1.0
    elif lo is None or hi is None:              # no values: a given bound stays
        lo, hi = (hi - 1.0, hi) if lo is None else (lo, lo + 1.0)
    lo, hi = float(lo), float(hi)
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    w = (hi - lo) / bins
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    counts = df.where((x >= lo) & (x <= hi)).groupBy(*by, b.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("count"))
    # every bin appears: fold each group's counts (at most ``bins`` entries,
    # a parameter) into a map, then expand 0..bins-1 -- no join, no rescan
    per = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_m"),
        F.sum("count").alias("_n"))
    out = per.select(*by, "_m", "_n",
                     F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = out.select(
        *by, "bin",
        (F.lit(lo) + F.col("bin") * F.lit(w)).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("bin_hi"),
        F.coalesce(F.element_at("_m", F.col("bin")), F.lit(0)).cast("bigint").alias("count"),
        "_n")
    if density:
        out = out.withColumn("density", F.col("count") / F.nullif(F.col("_n") * F.lit(w), F.lit(0.0)))
    return out.drop("_n")


def date_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Histogram of a timestamp column over its range (nulls dropped); bin
    edges in epoch seconds are also returned as timestamps."""
    ntz = dict(df.dtypes)[col] == "timestamp_ntz"
    t = df.where(F.col(col).isNotNull()).withColumn("_pr_t", epoch_seconds(col, ntz))
    h = histogram(t, "_pr_t", bins)
    return h.withColumns({"bin_lo": F.timestamp_seconds("bin_lo"),
                          "bin_hi": F.timestamp_seconds("bin_hi")})


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), whis: float = 1.5) -> DataFrame:
    """Box-plot statistics: quartiles, whiskers at the furthest data point
    within ``whis`` x IQR of the box, and the number of outliers.  Whiskers and
    outliers come from the table of distinct values the quartiles come from.
    Null and NaN are skipped; the null group is a group."""
    by = list(by)
    names = ["q1", "median", "q3"]
    aggs, cols = quantile_aggregates([0.25, 0.5, 0.75], names)
    vals = value_sums(df, col, by)
    q = vals.groupBy(*by).agg(*aggs).select(
        *[F.col(c).alias(f"_qg{i}") for i, c in enumerate(by)], *cols)
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"_lim_lo": F.col("q1") - F.lit(whis) * iqr,
                       "_lim_hi": F.col("q3") + F.lit(whis) * iqr})
    if by:
        j = vals.join(q, null_safe(vals, q, [(c, f"_qg{i}") for i, c in enumerate(by)]), "inner")
    else:                                   # one row of five numbers
        r = q.first()
        j = vals.withColumns({c: F.lit(r[c]).cast("double") for c in [*names, "_lim_lo", "_lim_hi"]})
    v = F.col("_v")
    return j.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in names],
        F.min(F.when(v >= F.col("_lim_lo"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("_lim_hi"), v)).alias("whisker_hi"),
        F.coalesce(F.sum(F.when((v < F.col("_lim_lo")) | (v > F.col("_lim_hi")), F.col("_w"))),
                   F.lit(0)).cast("bigint").alias("n_outliers"))
