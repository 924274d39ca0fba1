"""Feature vectors: scaled numerics, one-hot categoricals, binary flags.

One multi-column ``StringIndexer`` and one ``OneHotEncoder`` replace a fit
per column; fitting is a distributed frequency count and a standard
deviation, and the fitted model is applied row by row in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.operators.ranking import row_numbers
from parcelrisk.operators.schema import ColumnRoles
from parcelrisk.session import checkpoint_dir


NULL_LEVEL = "NaN"      # the level that a null categorical becomes
_ROW = "_pr_row"


def spread_for_fitting(df: DataFrame) -> DataFrame:
    """``df`` checkpointed for the fit passes that read it again and again.  A
    source of fewer partitions than the session's default parallelism is
    repartitioned round robin first."""
    checkpoint_dir(df.sparkSession)
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        df = df.repartition(want)
    return df.checkpoint(eager=True)


def feature_pipeline(roles: ColumnRoles, out: str = "features", keep_raw: bool = False,
                     handle_invalid: str = "error", scale: bool = True) -> Pipeline:
    """Assemble numerics (scaled by sample std, not centred), index and
    one-hot the categoricals (most frequent level first, ties alphabetical,
    the rarest level is the all-zero one), pass binary flags, and put all in
    one vector ``out``.  Categoricals must be strings without nulls (cast
    before).  ``handle_invalid="keep"`` is for rows with levels unseen in the
    fit: every level gets a slot then, and an unseen one the slot after them."""
    stages = []
    parts: list[str] = []
    if roles.numeric:
        stages.append(VectorAssembler(inputCols=list(roles.numeric), outputCol="_num",
                                      handleInvalid="error"))
        if scale:
            stages.append(StandardScaler(inputCol="_num", outputCol="_num_std",
                                         withMean=False, withStd=True))
            parts.append("_num_std")
            if keep_raw:
                parts.append("_num")
        else:
            parts.append("_num")
    if roles.categorical:
        idx = [f"{c}_index" for c in roles.categorical]
        vec = [f"{c}_vec" for c in roles.categorical]
        stages.append(StringIndexer(inputCols=list(roles.categorical), outputCols=idx,
                                    handleInvalid=handle_invalid,
                                    stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True,
                                    handleInvalid="keep" if handle_invalid == "keep" else "error"))
        parts += vec
    parts += list(roles.binary)
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return Pipeline(stages=stages)


def prepare(df: DataFrame, roles: ColumnRoles, fill_numeric: float | None = None) -> DataFrame:
    """The role columns cast for ``feature_pipeline``."""
    cast = {c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL)) for c in roles.categorical}
    if fill_numeric is None:
        cast.update({c: F.col(c).cast("double") for c in roles.numeric})
    else:
        # null, NaN and infinite numerics (e.g. ratios over a zero) -> the fill value
        cast.update({c: F.when(F.col(c).cast("double").isin(float("inf"), float("-inf"))
                               | F.isnan(F.col(c).cast("double")), F.lit(fill_numeric))
                     .otherwise(F.coalesce(F.col(c).cast("double"), F.lit(fill_numeric)))
                     for c in roles.numeric})
    cast.update({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in roles.binary})
    return df.withColumns(cast)


def _without_constants(df: DataFrame, roles: ColumnRoles) -> ColumnRoles:
    """The roles without categoricals of one level: that level is the rarest,
    so it has no slot, and the encoder rejects such a column."""
    if not roles.categorical:
        return roles
    ends = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in roles.categorical]).first()
    return replace(roles, categorical=tuple(c for c in roles.categorical if not ends[c]))


def build_features(df: DataFrame, roles: ColumnRoles, out: str = "features",
                   keep_raw: bool = False, fit_on: DataFrame | None = None,
                   handle_invalid: str = "error", persist: bool = True,
                   fill_numeric: float | None = None) -> tuple[DataFrame, PipelineModel]:
    """Fit the feature pipeline (on ``fit_on`` or all rows) and return the
    table reduced to key, identity, label, fold, passthrough and ``out``.

    With ``persist`` the input, projected to the role columns, is checkpointed
    so that the fit passes (level counts, standard deviations) and the
    transform read it once from the source.  ``fill_numeric`` replaces null /
    NaN / infinite numerics (the assembler rejects them); without it such a
    value is an error.  A null categorical is a level of its own."""
    roles.validate(df)
    named = [roles.key, *roles.identity, *roles.passthrough, *roles.numeric,
             *roles.categorical, *roles.binary] + [c for c in (roles.label, roles.fold) if c]
    prepared = prepare(df.select(*dict.fromkeys(named)), roles, fill_numeric)
    if persist:
        prepared = spread_for_fitting(prepared)
    train = prepare(fit_on, roles, fill_numeric) if fit_on is not None else prepared
    fitted = roles if handle_invalid == "keep" else _without_constants(train, roles)
    model = feature_pipeline(fitted, out, keep_raw, handle_invalid).fit(train)
    keep = [roles.key, *roles.identity, *roles.passthrough]
    keep += [c for c in (roles.label, roles.fold) if c]
    return model.transform(prepared).select(*dict.fromkeys(keep), out), model


def combine_vectors(df: DataFrame, cols: Sequence[str], out: str, drop: bool = True) -> DataFrame:
    """Concatenate vector (or numeric) columns into one vector."""
    res = VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)
    return res.drop(*cols) if drop else res


def one_hot_levels(df: DataFrame, col: str) -> DataFrame:
    """What ``feature_pipeline`` does by default: the index a ``StringIndexer`` gives each level (frequency desc, ties
    alphabetical), its count, and whether one-hot encodes it as all zeros
    (the last index, ``dropLast``) -- computed as a plain aggregate.  The
    level order is numbered by a distributed sort (``row_numbers``), so a
    high-cardinality column never meets a single-partition window."""
    counts = df.where(F.col(col).isNotNull()) \
        .groupBy(F.col(col).cast("string").alias("level")) \
        .agg(F.count(F.lit(1)).alias("n"))
    ranked = row_numbers(counts, [F.col("n").desc(), F.col("level").asc()], "level_index")
    last = ranked.agg(F.max("level_index")).first()[0]      # one number
    return ranked.select("level", "n", F.col("level_index").cast("int").alias("level_index"),
                         (F.col("level_index") == F.lit(last)).cast("int").alias("all_zero"))


def level_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level, n, level_index): the levels of several columns, each column's
    numbered as by ``one_hot_levels`` (frequency desc, ties alphabetical), all in one
    distributed sort.  Null is the level ``NULL_LEVEL``."""
    pairs = _level_pairs(df, cols, [])
    counts = pairs.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    ranked = row_numbers(counts, ["column", F.col("n").desc(), "level"], "_pr_at")
    first = ranked.groupBy("column").agg(F.min("_pr_at").alias("_pr_first"))       # one row per column
    return ranked.join(first, "column").select(
        "column", "level", "n", (F.col("_pr_at") - F.col("_pr_first")).alias("level_index"))


def _level_pairs(df: DataFrame, cols: Sequence[str], ids: Sequence[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(
        F.col(c).cast("string"), F.lit(NULL_LEVEL)).alias("level")) for c in cols])
    return df.select(*ids, F.explode(each).alias("_pr_p")).select(*ids, "_pr_p.column", "_pr_p.level")


def sparse_features(df: DataFrame, key: Sequence[str] | str, numeric: Sequence[str] = (),
                    categorical: Sequence[str] = (), binary: Sequence[str] = (),
                    out: str = "features") -> DataFrame:
    """The key and ``out``, a sparse vector (a struct of ``size``, ``indices`` and ``values``)
    with the slots of ``feature_pipeline``: scaled numerics, one-hot levels without the
    last of each column, binaries.

    For categoricals of any number of levels: ``feature_pipeline``'s indexer holds all
    levels on the driver and in every task; here levels are numbered by a distributed sort
    and joined by shuffle, one join for all columns, and only one number per column (its
    slots) reaches the driver.  Returns the columns ``key`` and ``out``, one row per row."""
    ids = [key] if isinstance(key, str) else list(key)
    checkpoint_dir(df.sparkSession)
    named = list(dict.fromkeys([*ids, *numeric, *categorical, *binary]))
    # rows are numbered as they are written, so that keys needn't be unique
    data = df.select(*named).withColumn(_ROW, F.monotonically_increasing_id()).checkpoint()
    scale = {}
    if numeric:
        r = data.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in numeric]).first()   # one per column
        scale = {c: r[c] for c in numeric}
    n = len(numeric)
    slots = [F.struct(F.lit(i).cast("long").alias("i"),
                      (F.col(c).cast("double") / F.lit(scale[c])).alias("v") if scale[c] else F.lit(0.0).alias("v"))
             for i, c in enumerate(numeric)]
    first = {}
    if categorical:
        levels = level_numbers(data, categorical).checkpoint()
        sizes = {r["column"]: r["n"] - 1 for r in levels.groupBy("column").agg(
            F.count(F.lit(1)).alias("n")).collect()}                               # one row per column
        for c in categorical:
            first[c] = n
            n += sizes.get(c, 0)
    slots += [F.struct(F.lit(n + i).cast("long").alias("i"), F.coalesce(
        F.col(c).cast("double"), F.lit(0.0)).alias("v")) for i, c in enumerate(binary)]
    n += len(binary)
    plain = data.select(_ROW, *ids, F.array(*slots).alias("_pr_s") if slots else
                        F.array().cast("array<struct<i:bigint,v:double>>").alias("_pr_s"))
    if categorical:
        offset = F.create_map(*[x for c in categorical for x in (F.lit(c), F.lit(first[c]).cast("long"))])
        count = F.create_map(*[x for c in categorical for x in (F.lit(c), F.lit(sizes.get(c, 0)).cast("long"))])
        at = _level_pairs(data, categorical, [_ROW]).join(levels.drop("n"), ["column", "level"]) \
            .where(F.col("level_index") < count[F.col("column")])
        hot = at.groupBy(_ROW).agg(F.collect_list(F.struct(
            (offset[F.col("column")] + F.col("level_index")).alias("i"), F.lit(1.0).alias("v"))).alias("_pr_h"))
        plain = plain.join(hot, _ROW, "left").withColumn("_pr_s", F.concat(
            "_pr_s", F.coalesce("_pr_h", F.array().cast("array<struct<i:bigint,v:double>>"))))
    kept = F.array_sort(F.filter("_pr_s", lambda s: s["v"] != 0))
    return plain.select(*ids, kept.alias("_pr_k")).select(*ids, F.struct(
        F.lit(n).cast("long").alias("size"),
        F.transform("_pr_k", lambda s: s["i"]).alias("indices"),
        F.transform("_pr_k", lambda s: s["v"]).alias("values")).alias(out))


def as_ml_vectors(df: DataFrame, col: str, path: str) -> DataFrame:
    """``sparse_features`` as MLlib vectors: written to the new folder ``path`` in the layout
    that MLlib's vectors have on disk and read back as such, without a row leaving
    the JVM."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    layout = F.struct(F.lit(0).cast("byte").alias("type"), F.col(col)["size"].cast("int").alias("size"),
                      F.col(col)["indices"].cast("array<int>").alias("indices"), F.col(col)["values"].alias("values"))
    df.withColumn(col, layout).write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT()) if f.name == col else f for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
