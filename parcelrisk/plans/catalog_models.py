"""Queries that fit models: feature vectors, out-of-fold forest (the
flagship), holdout logistic regression, holdout forest on binary flags,
walk-forward scoring.  Scores depend on the learner, so these have no SQL
equivalent except ``one_hot_levels``; tests check their invariants."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.functions.scalars import safe_ratio
from parcelrisk.operators import features as feat
from parcelrisk.operators import folds, model
from parcelrisk.operators.schema import ColumnRoles
from parcelrisk.plans.catalog import labels
from parcelrisk.plans.registry import query, t

OOF_FOLDS = 10        # the method scores every entity with a 10-fold out-of-fold forest
CUSTOMER_ROLES = ColumnRoles(
    key="c_custkey", identity=("c_name",), label="TARGET", fold="fold",
    numeric=("c_acctbal", "n_orders", "avg_price", "max_price", "acct_over_spend"),
    categorical=("c_mktsegment", "c_nationkey"))


def customer_table(spark, sf) -> DataFrame:
    """Customers with their label, order aggregates, a ratio and a fold."""
    o = t(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"), F.max("o_totalprice").alias("max_price"),
        F.sum("o_totalprice").alias("_spend"))
    c = labels(spark, sf).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.withColumn("acct_over_spend", safe_ratio("c_acctbal", "_spend")) \
        .fillna(0.0, subset=["n_orders", "avg_price", "max_price", "acct_over_spend"]) \
        .drop("o_custkey", "_spend")
    return folds.assign_folds(c, "c_custkey", OOF_FOLDS, seed=42)


def customer_features(spark, sf) -> DataFrame:
    data, _ = feat.build_features(customer_table(spark, sf), CUSTOMER_ROLES)
    return data


@query("features_vector")
def q_features_vector(spark, sf):
    return customer_features(spark, sf).select(
        "c_custkey", "TARGET", "fold", vector_to_array("features").alias("features"))


@query("one_hot_levels", """
WITH c AS (SELECT CAST(c_mktsegment AS VARCHAR) AS level, count(*) AS n FROM customer
           WHERE c_mktsegment IS NOT NULL GROUP BY 1),
r AS (SELECT level, n, CAST(row_number() OVER (ORDER BY n DESC, level) - 1 AS INTEGER) AS level_index
      FROM c)
SELECT level, n, level_index, CAST(level_index = max(level_index) OVER () AS INTEGER) AS all_zero
FROM r""")
def q_one_hot_levels(spark, sf):
    return feat.one_hot_levels(t(spark, sf, "customer"), "c_mktsegment")


@query("one_hot_levels_wide", """
WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS level, count(*) AS n FROM lineitem
           WHERE l_partkey IS NOT NULL GROUP BY 1),
r AS (SELECT level, n, CAST(row_number() OVER (ORDER BY n DESC, level) - 1 AS INTEGER) AS level_index
      FROM c)
SELECT level, n, level_index, CAST(level_index = max(level_index) OVER () AS INTEGER) AS all_zero
FROM r""")
def q_one_hot_levels_wide(spark, sf):
    """Level indexes of a high-cardinality code (one level per part)."""
    return feat.one_hot_levels(t(spark, sf, "lineitem"), "l_partkey")


@query("oof_forest")
def q_oof_forest(spark, sf):
    """Every customer scored once by a forest that did not see it."""
    data = customer_features(spark, sf)
    return model.oof_score(data, "features", "TARGET", "fold", OOF_FOLDS,
                           keep=["c_custkey", "c_name"], seed=42)


def document_table(spark, sf) -> DataFrame:
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "inner")
    return d.select(
        "doc_id", "quality", "lang", "source",
        F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
        F.log1p(F.size(F.split(F.col("text"), r"\s+")).cast("double")).alias("log_words"),
        F.size(F.split(F.col("text"), "\n")).cast("double").alias("n_lines"),
        safe_ratio(F.length(F.regexp_replace("text", "[^0-9]", "")), F.length("text"))
        .alias("digit_share"))


@query("holdout_logistic")
def q_holdout_logistic(spark, sf):
    """70/30 hash split of labelled documents, logistic regression."""
    roles = ColumnRoles(key="doc_id", label="quality",
                        numeric=("log_chars", "log_words", "n_lines", "digit_share"),
                        categorical=("lang", "source"))
    docs = document_table(spark, sf).fillna(0.0, subset=["digit_share"])
    data, _ = feat.build_features(docs, roles)
    data = folds.hash_split(data, "doc_id", 0.7, seed=7)
    return model.holdout_score(data, "features", "quality", "is_train", keep=["doc_id"])


def flag_exprs() -> dict:
    return {
        "big_qty": F.col("l_quantity") > 25, "big_disc": F.col("l_discount") > 0.05,
        "big_tax": F.col("l_tax") > 0.04, "finished": F.col("l_linestatus") == "F",
        "late": F.year("l_shipdate") >= 1999, "pricey": F.col("l_extendedprice") > 50000,
    }


@query("holdout_forest")
def q_holdout_forest(spark, sf):
    """A forest on binary flags, trained on 70 % of the lines, scored on
    the rest, probabilities as columns."""
    li = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        *[e.cast("int").alias(n) for n, e in flag_exprs().items()])
    roles = ColumnRoles(key="line_id", identity=("l_orderkey", "l_linenumber"), label="label",
                        binary=tuple(flag_exprs()))
    data, _ = feat.build_features(li, roles)
    data = folds.hash_split(data, "line_id", 0.7, seed=3)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=42)
    return model.holdout_score(data, "features", "label", "is_train", estimator=rf,
                               keep=["l_orderkey", "l_linenumber"])


@query("walk_forward")
def q_walk_forward(spark, sf):
    """Orders of each year scored by a model fit on the earlier years."""
    o = t(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority",
        F.log1p("o_totalprice").alias("log_price"),
        (F.col("o_orderstatus") == "F").cast("int").alias("closed"))
    roles = ColumnRoles(key="o_orderkey", passthrough=("year",), label="closed",
                        numeric=("log_price",), categorical=("o_orderpriority",))
    # feature stages and learner are fitted on the past of each year
    pipe = Pipeline(stages=[*feat.feature_pipeline(roles, handle_invalid="keep").getStages(),
                            LogisticRegression(featuresCol="features", labelCol="closed")])
    return model.walk_forward_score(feat.prepare(o, roles), "features", "closed", "year",
                                    estimator=pipe, keep=["o_orderkey"])


# What every score table keeps, whatever the learner; see catalog_features.
_SPLIT = ("CAST(('0x' || substr(md5(concat({k}, '#{s}')), 1, 8)) AS BIGINT) % 10000 >= 7000")
QUERIES_WITH_SCORES = {
    "oof_forest": {"group": ["fold"], "key": ["c_custkey"], "sql": """
SELECT CAST(CAST(('0x' || substr(md5(concat(c_custkey, '#42')), 1, 8)) AS BIGINT) % 10 AS INTEGER) AS fold,
       count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, CAST(0 AS BIGINT) AS n_bad_sums, CAST(0 AS BIGINT) AS n_bad_predictions
FROM customer GROUP BY 1"""},
    "holdout_logistic": {"group": [], "key": ["doc_id"], "sql": f"""
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, CAST(0 AS BIGINT) AS n_bad_sums, CAST(0 AS BIGINT) AS n_bad_predictions
FROM documents JOIN labels USING (doc_id) WHERE {_SPLIT.format(k="doc_id", s=7)}"""},
    "holdout_forest": {"group": [], "key": ["l_orderkey", "l_linenumber"], "sql": f"""
SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, CAST(0 AS BIGINT) AS n_bad_sums,
       CAST(0 AS BIGINT) AS n_bad_predictions FROM lineitem
WHERE {_SPLIT.format(k="concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", s=3)}"""},
    "walk_forward": {"group": ["year"], "key": ["o_orderkey"], "sql": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_rows,
       count(DISTINCT o_orderkey) AS n_keys, CAST(0 AS BIGINT) AS n_bad_sums, CAST(0 AS BIGINT) AS n_bad_predictions
FROM orders WHERE year(o_orderdate) > (SELECT min(year(o_orderdate)) FROM orders) GROUP BY 1"""},
}
