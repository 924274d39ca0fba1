"""Out-of-fold and holdout scoring with MLlib estimators.

``oof_score`` fits one model per fold on the other folds and scores the
held-out fold, so every row gets exactly one score from a model that never
saw it.  The feature table is checkpointed once, fits run concurrently from a small
thread pool (each fit is itself a distributed job), and the k scored folds
are a union of k filtered scans of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.operators.clean import union_all
from parcelrisk.operators.features import spread_for_fitting
from parcelrisk.operators.folds import fold_test, fold_train


def split_probability(df: DataFrame, col: str = "probability",
                      names: Sequence[str] = ("prob0", "prob1")) -> DataFrame:
    """Vector elements -> double columns, JVM-side (no Python UDF)."""
    arr = vector_to_array(F.col(col))
    return df.withColumns({n: arr[i] for i, n in enumerate(names)})


def default_forest(features: str, label: str, seed: int = 42, **params) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=features, labelCol=label,
                                  predictionCol="prediction", seed=seed, **params)


def _fits(df: DataFrame, parallelism: int | None, n: int) -> int:
    return max(1, min(parallelism or df.sparkSession.sparkContext.defaultParallelism, n))


def oof_score(df: DataFrame, features: str, label: str, fold: str, k: int,
              estimator: Estimator | None = None, keep: Sequence[str] = (),
              parallelism: int | None = None, seed: int = 42) -> DataFrame:
    """Score every row out of fold; ``parallelism`` fits run at a time (by
    default as many as the session has cores).

    Returns ``keep`` + label + fold + ``prediction``, ``prob0``, ``prob1``.
    ``estimator`` defaults to a seeded random forest; a ``Pipeline`` that
    includes the feature stages fits them on the training folds only.
    """
    est = estimator if estimator is not None else default_forest(features, label, seed)
    # a Pipeline that builds ``features`` itself needs the raw columns
    cols = [*keep, label, fold, features] if features in df.columns else df.columns
    data = spread_for_fitting(df.select(*dict.fromkeys(cols))
                              .withColumn(label, F.col(label).cast("double")))

    def fit(i: int):
        return est.fit(fold_train(data, i, fold))

    with ThreadPoolExecutor(max_workers=_fits(df, parallelism, k)) as pool:
        models = list(pool.map(fit, range(k)))

    scored = [m.transform(fold_test(data, i, fold)) for i, m in enumerate(models)]
    out = split_probability(union_all(scored))
    return out.select(*dict.fromkeys([*keep, label, fold]), F.col("prediction").cast("double"),
                      "prob0", "prob1")


def holdout_score(df: DataFrame, features: str, label: str, split_col: str,
                  estimator: Estimator | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Fit on rows with ``split_col`` = 1, score rows with 0 (a 70/30 split
    from ``hash_split``).  Defaults to logistic regression (MLlib defaults:
    100 iterations, no regularisation)."""
    est = estimator if estimator is not None else LogisticRegression(
        featuresCol=features, labelCol=label, predictionCol="prediction")
    data = df.withColumn(label, F.col(label).cast("double"))
    model = est.fit(data.where(F.col(split_col) == 1))
    scored = model.transform(data.where(F.col(split_col) == 0))
    return split_probability(scored).select(
        *dict.fromkeys([*keep, label]), F.col("prediction").cast("double"), "prob0", "prob1")


def walk_forward_score(df: DataFrame, features: str, label: str, period: str,
                       periods: Sequence | None = None, estimator: Estimator | None = None,
                       keep: Sequence[str] = (), parallelism: int | None = None) -> DataFrame:
    """For each period p, fit on the rows of earlier periods and score the
    rows of p (train on the past, score the next period).

    ``periods`` defaults to all periods of the data but the first, which has
    no past (one row per period to the driver); rows of a null period have no
    past either.  Without a period that has a past there are no rows.  A ``Pipeline`` that includes the feature stages fits them on
    the past only; give it ``handle_invalid="keep"`` for new levels."""
    est = estimator if estimator is not None else LogisticRegression(
        featuresCol=features, labelCol=label, predictionCol="prediction")
    cols = [*keep, label, period, features] if features in df.columns else df.columns
    data = spread_for_fitting(df.select(*dict.fromkeys(cols))
                              .withColumn(label, F.col(label).cast("double")))
    if periods is None:
        found = data.select(period).distinct().where(F.col(period).isNotNull())
        periods = [r[0] for r in found.orderBy(period).collect()][1:]
    if not periods:                  # no period has a past: no rows, the same columns
        none = data.where(F.lit(False)).select(*dict.fromkeys([*keep, label, period]))
        return none.withColumns({c: F.lit(None).cast("double") for c in ("prediction", "prob0", "prob1")})

    def fit(p):
        return est.fit(data.where(F.col(period) < F.lit(p)))

    with ThreadPoolExecutor(max_workers=_fits(df, parallelism, len(periods))) as pool:
        models = list(pool.map(fit, periods))
    scored = [m.transform(data.where(F.col(period) == F.lit(p))) for p, m in zip(periods, models)]
    return split_probability(union_all(scored)).select(
        *dict.fromkeys([*keep, label, period]), F.col("prediction").cast("double"), "prob0", "prob1")
