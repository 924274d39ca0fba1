"""Fold models that are kept: fitted once, saved, loaded later to score new rows.

A saved set holds one ``PipelineModel`` per fold, with its feature stages, so the
order of levels and the scaling are those of the fit, and a description (key,
label, fold column, number of folds, seed of the folds, the feature roles).  A row
whose key was in the fit gets the score of the model of its fold, which never saw
it; a row of a new key the mean of all models.  A level that the fit did not see
falls into the slot after the known ones, as null levels and values do by
``features.prepare``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelrisk.operators.clean import union_all
from parcelrisk.operators.features import feature_pipeline, prepare, spread_for_fitting
from parcelrisk.operators.folds import assign_folds, fold_test, fold_train
from parcelrisk.operators.model import _fits, default_forest, split_probability
from parcelrisk.operators.schema import ColumnRoles
from parcelrisk.session import checkpoint_dir

FEATURES = "features"


@dataclass(frozen=True)
class FoldModels:
    """One fitted pipeline per fold, and how it was made."""
    models: tuple[PipelineModel, ...]
    roles: ColumnRoles
    seed: int
    fill_numeric: float

    @property
    def k(self) -> int:
        return len(self.models)


def _table(df: DataFrame, roles: ColumnRoles, fill_numeric: float, label: bool) -> DataFrame:
    named = [roles.key, *roles.identity, *roles.numeric, *roles.categorical, *roles.binary]
    named += [roles.label] if label else []
    return prepare(df.select(*dict.fromkeys(named)), roles, fill_numeric)


def fit_fold_models(df: DataFrame, roles: ColumnRoles, k: int, seed: int = 0,
                    estimator: Estimator | None = None, fill_numeric: float = 0.0,
                    parallelism: int | None = None) -> FoldModels:
    """Fit one model per fold on the rows of the other folds, features included.  Folds are
    by hash of the key, so a later session finds the same ones."""
    est = estimator if estimator is not None else default_forest(FEATURES, roles.label, seed)
    data = assign_folds(_table(df, roles, fill_numeric, True), roles.key, k, seed, "_fold")
    data = spread_for_fitting(data.withColumn(roles.label, F.col(roles.label).cast("double")))
    stages = feature_pipeline(roles, out=FEATURES, handle_invalid="keep").getStages()

    def fit(i: int) -> PipelineModel:
        return Pipeline(stages=[*stages, est]).fit(fold_train(data, i, "_fold"))

    with ThreadPoolExecutor(max_workers=_fits(df, parallelism, k)) as pool:
        return FoldModels(tuple(pool.map(fit, range(k))), roles, seed, fill_numeric)


def save_fold_models(fitted: FoldModels, path: str) -> str:
    """Write the models and their description below the new folder ``path``; the
    description comes last, so a set that lacks it is not whole."""
    for i, m in enumerate(fitted.models):
        m.write().save(f"{path}/fold={i}")
    said = json.dumps({"k": fitted.k, "seed": fitted.seed, "fill_numeric": fitted.fill_numeric,
                       "roles": asdict(fitted.roles)})
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{path}/description")
    return path


def load_fold_models(spark: SparkSession, path: str) -> FoldModels:
    d = json.loads(spark.read.text(f"{path}/description").first()[0])
    roles = {n: tuple(v) if isinstance(v, list) else v for n, v in d["roles"].items()}
    models = tuple(PipelineModel.load(f"{path}/fold={i}") for i in range(d["k"]))
    return FoldModels(models, ColumnRoles(**roles), d["seed"], d["fill_numeric"])


def score_known(fitted: FoldModels, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose keys were in the fit: each scored by the model of its fold.  ``df`` is
    written once and read by every model: a union of as many copies of its plan may
    run in the same tasks, with the memory of all of them."""
    checkpoint_dir(df.sparkSession)
    data = assign_folds(_table(df, fitted.roles, fitted.fill_numeric, False), fitted.roles.key,
                        fitted.k, fitted.seed, "_fold").checkpoint()
    scored = [split_probability(m.transform(fold_test(data, i, "_fold"))) for i, m in enumerate(fitted.models)]
    return union_all([s.select(*dict.fromkeys([fitted.roles.key, *keep]), F.col("_fold").alias("fold"),
                               "prob0", "prob1") for s in scored])


def score_new(fitted: FoldModels, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of new keys: the mean of all models, and ``spread``, the difference between
    the highest and the lowest ``prob1``."""
    out = _table(df, fitted.roles, fitted.fill_numeric, False)
    base, probs = out.columns, []
    for i, m in enumerate(fitted.models):
        scored = split_probability(m.transform(out), names=(f"_p0_{i}", f"_p1_{i}"))
        probs.append(f"_p1_{i}")
        out = scored.select(*base, *probs)
    p = [F.col(c) for c in probs]
    mean = reduce(lambda a, b: a + b, p) / F.lit(float(fitted.k))
    spread = F.array_max(F.array(*p)) - F.array_min(F.array(*p))
    return out.select(*dict.fromkeys([fitted.roles.key, *keep]), (1 - mean).alias("prob0"),
                      mean.alias("prob1"), spread.alias("spread"))
