"""What is kept and used again: archives of many members, rejected records, profiles
as sketches, wide sparse features, and models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parcelrisk.operators import features as feat
from parcelrisk.operators import folds, model_store, sketches
from parcelrisk.operators.schema import ColumnRoles, other_columns
from parcelrisk.plans.catalog import LABELS_SQL, _w
from parcelrisk.plans.catalog_io import CUSTOMER_SCHEMA
from parcelrisk.plans.catalog_models import CUSTOMER_ROLES, customer_table
from parcelrisk.plans.registry import query, t
from parcelrisk.session import scratch_dir
from parcelrisk.sources.archives import read_zip_members
from parcelrisk.sources.rejects import read_with_rejects
from parcelrisk.sources.sinks import write_delimited, write_run, write_zipped_delimited


# ---------------------------------------------------------------- sources

@query("zip_members", "SELECT * FROM customer")
def q_zip_members(spark, sf):
    """Customers in archives of many members, read one task per member."""
    path = scratch_dir(spark, "zip")
    write_zipped_delimited(t(spark, sf, "customer"), path, member_rows=200).collect()   # one row per archive
    return read_zip_members(spark, path, CUSTOMER_SCHEMA)


_RECORDS_SQL = """
records AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS status,
         CASE WHEN o_orderkey % 11 = 0 THEN 'x' || o_custkey WHEN o_orderkey % 11 = 1 THEN 'NA'
              ELSE CAST(o_custkey AS VARCHAR) END AS said,
         o_orderkey % 13 = 0 AS longer
  FROM orders)"""


def _records(spark, sf, kind: str):
    """A file of orders in which some keys are no numbers or missing, and some lines
    have a column too many; its rows or its rejects."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    said = F.when(k % 11 == 0, F.concat(F.lit("x"), c)).when(k % 11 == 1, "NA").otherwise(c)
    line = F.concat_ws(",", k.cast("string"), said, "o_orderstatus")
    line = F.when(k % 13 == 0, F.concat(line, F.lit(",more"))).otherwise(line)
    path = scratch_dir(spark, "rejects")
    lines = t(spark, sf, "orders").select(line.alias("o_orderkey,o_custkey,status"))
    # the lines as they are, below one header line per file
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(f"{path}/in")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("o_orderkey", T.LongType(), False),
                           T.StructField("o_custkey", T.LongType(), False),
                           T.StructField("status", T.StringType())])
    return getattr(read_with_rejects(spark, f"{path}/in", schema, f"{path}/out"), kind)


@query("typed_rows", _w(_RECORDS_SQL, """
SELECT o_orderkey, o_custkey, status FROM records WHERE o_orderkey % 11 > 1 AND NOT longer"""))
def q_typed_rows(spark, sf):
    """The good records of a file with bad ones."""
    return _records(spark, sf, "rows")


@query("rejected_rows", _w(_RECORDS_SQL, """
SELECT CASE WHEN longer THEN 'number of columns' WHEN o_orderkey % 11 = 0 THEN 'o_custkey: not of type bigint'
            ELSE 'o_custkey: no value' END AS reason,
       o_orderkey || ',' || said || ',' || status || CASE WHEN longer THEN ',more' ELSE '' END AS line
FROM records WHERE o_orderkey % 11 <= 1 OR longer"""))
def q_rejected_rows(spark, sf):
    """The bad records: why, and the line as it is."""
    return _records(spark, sf, "rejects").select("reason", "line")


@query("limited_rows", "SELECT least(count(*), 100) AS n_rows, 3 AS n_columns, 0 AS n_header_only FROM customer")
def q_limited_rows(spark, sf):
    """The first rows of a file only, and its header only: how many there are."""
    from parcelrisk.sources.readers import read_delimited
    path = scratch_dir(spark, "csv") + "/customer.csv"
    write_delimited(t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    some, none = read_delimited(spark, path, limit=100), read_delimited(spark, path, limit=0)
    n = some.agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select("n_rows", F.lit(len(none.columns)).alias("n_columns"),
                    F.lit(none.count()).cast("int").alias("n_header_only"))


@query("extract_tables", """
SELECT 'units' AS extract, CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS v FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'buildings', o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1""")
def q_extract_tables(spark, sf):
    """The unit and the building extract as they are, one zipped and one plain."""
    from parcelrisk.plans.recipes import residential_buildings, units_table
    base = scratch_dir(spark, "extracts")
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    # a folder may be named like an archive: both readers take folders
    write_zipped_delimited(o.where("k % 2 = 0"), f"{base}/units.zip").collect()         # one row per archive
    write_delimited(o.where("k % 2 = 1"), f"{base}/buildings.csv")
    units = units_table(spark, f"{base}/units.zip", "k bigint, v bigint")
    buildings = residential_buildings(spark, f"{base}/buildings.csv", "k bigint, v bigint")
    return units.select(F.lit("units").alias("extract"), "k", "v").unionByName(
        buildings.select(F.lit("buildings").alias("extract"), "k", "v"))


@query("run_overwritten", "SELECT o_orderkey, o_totalprice FROM orders")
def q_run_overwritten(spark, sf):
    """A feature table written twice under one run id, the second time in place of the first."""
    base = scratch_dir(spark, "runs")
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    write_run(o.where("o_orderkey % 2 = 0"), base, run_id="features")
    return spark.read.parquet(write_run(o, base, run_id="features", mode="overwrite"))


# ---------------------------------------------------------------- profiles

@query("merged_profiles", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_rows, TRUE AS distinct_ok, TRUE AS median_ok
FROM orders GROUP BY 1""")
def q_merged_profiles(spark, sf):
    """Profiles stored per year and priority, merged per year: the distinct customers and the
    rank of the median price are within the stated errors of the exact ones."""
    o = t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    path = sketches.store_profile(sketches.sketch_profile(
        o, ["year", "o_orderpriority"], ["o_custkey"], ["o_totalprice"]), scratch_dir(spark, "profiles"))
    merged = sketches.read_profile(sketches.merge_profiles(spark.read.parquet(path), ["year"]), [0.5])
    exact = o.join(merged.select("year", "o_totalprice_q50"), "year").groupBy("year").agg(
        F.count_distinct("o_custkey").alias("n"),
        F.avg((F.col("o_totalprice") <= F.col("o_totalprice_q50")).cast("double")).alias("upto"),
        F.avg((F.col("o_totalprice") < F.col("o_totalprice_q50")).cast("double")).alias("below"))
    near = F.abs(F.col("o_custkey_distinct") - F.col("n")) <= F.greatest(
        F.lit(1.0), F.col("n") * sketches.distinct_error())
    e = sketches.rank_error()
    return merged.join(exact, "year").select(
        "year", "n_rows", near.alias("distinct_ok"),
        ((F.col("below") <= 0.5 + e) & (F.col("upto") >= 0.5 - e)).alias("median_ok"))


# ---------------------------------------------------------------- features

def _level_sql(c: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS i, count(*) OVER () - 1 AS slots
  FROM (SELECT coalesce(CAST({c} AS VARCHAR), 'NaN') AS level, count(*) AS n FROM lineitem GROUP BY 1))"""


@query("features_sparse_wide", "WITH " + ",".join(
    _level_sql(c, n).lstrip() for c, n in (("l_partkey", "p"), ("l_suppkey", "s"), ("l_returnflag", "f"))) + """,
d AS (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_extendedprice) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, 3 + p.slots + s.slots + f.slots AS size,
       concat_ws(',', '0', '1', CASE WHEN p.i < p.slots THEN CAST(2 + p.i AS VARCHAR) END,
                 CASE WHEN s.i < s.slots THEN CAST(2 + p.slots + s.i AS VARCHAR) END,
                 CASE WHEN f.i < f.slots THEN CAST(2 + p.slots + s.slots + f.i AS VARCHAR) END,
                 CASE WHEN l_linestatus = 'O' THEN CAST(2 + p.slots + s.slots + f.slots AS VARCHAR) END) AS slots,
       round(l_quantity / d.q, 6) AS quantity, round(l_extendedprice / d.e, 6) AS price
FROM lineitem JOIN p ON CAST(l_partkey AS VARCHAR) = p.level JOIN s ON CAST(l_suppkey AS VARCHAR) = s.level
JOIN f ON l_returnflag = f.level, d""")
def q_features_sparse_wide(spark, sf):
    """Lines as sparse vectors with a slot per part and per supplier, whose levels never
    meet on the driver."""
    li = t(spark, sf, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    v = feat.sparse_features(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"],
                             ["l_partkey", "l_suppkey", "l_returnflag"], ["open"], out="v")
    return v.select("l_orderkey", "l_linenumber", F.col("v.size").alias("size"),
                    F.array_join(F.col("v.indices").cast("array<string>"), ",").alias("slots"),
                    F.round(F.col("v.values")[0], 6).alias("quantity"),
                    F.round(F.col("v.values")[1], 6).alias("price"))


@query("other_columns_vector", """
WITH d AS (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_discount) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / d.q, 6) AS quantity,
       round(l_discount / d.e, 6) AS discount, round(l_extendedprice, 6) AS price, round(l_tax, 6) AS tax
FROM lineitem, d""")
def q_other_columns_vector(spark, sf):
    """A side vector of all columns that are not named (scaled), joined with the vector of the
    named ones (as they are) into one."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = t(spark, sf, "lineitem").select(*ids, "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    rest = other_columns(li, [*ids, "l_extendedprice", "l_tax"])
    roles = ColumnRoles(key=ids[0], identity=tuple(ids[1:]), numeric=tuple(rest),
                        passthrough=("l_extendedprice", "l_tax"))
    side, _ = feat.build_features(li, roles, out="side")
    both = feat.combine_vectors(feat.combine_vectors(side, ["l_extendedprice", "l_tax"], "named"),
                                ["side", "named"], "v")
    v = vector_to_array("v")
    return both.select(*ids, *[F.round(v[i], 6).alias(n) for i, n in enumerate(
        ("quantity", "discount", "price", "tax"))])


# ---------------------------------------------------------------- models

def _small_forest(label: str, seed: int = 7) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=model_store.FEATURES, labelCol=label, seed=seed,
                                  numTrees=5, maxDepth=3)


@query("stored_models", _w(LABELS_SQL, """
SELECT c_custkey, TRUE AS same, TRUE AS between FROM labelled"""))
def q_stored_models(spark, sf):
    """Fold models saved and loaded again: every customer gets the same score from the
    loaded models, and as a new key, with a level never seen, one between the
    lowest and the highest."""
    c = customer_table(spark, sf)
    fitted = model_store.fit_fold_models(c, CUSTOMER_ROLES, 3, estimator=_small_forest("TARGET"))
    path = model_store.save_fold_models(fitted, scratch_dir(spark, "models"))
    loaded = model_store.load_fold_models(spark, path)
    a = model_store.score_known(fitted, c).select("c_custkey", F.col("prob1").alias("a"))
    b = model_store.score_known(loaded, c).select("c_custkey", F.col("prob1").alias("b"))
    new = model_store.score_new(loaded, c.withColumn("c_mktsegment", F.lit("UNSEEN"))).select(
        "c_custkey", ((F.col("prob1") >= 0) & (F.col("prob1") <= 1) & (F.col("spread") >= 0)).alias("between"))
    return a.join(b, "c_custkey").join(new, "c_custkey").select(
        "c_custkey", (F.col("a") == F.col("b")).alias("same"), "between")


@query("oof_leakage_contract", _w(LABELS_SQL, """
, f AS (SELECT CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '#0'), 1, 8))::BIGINT % 3 AS INTEGER) AS fold
        FROM labelled)
SELECT fold, count(*) AS n_rows, TRUE AS blind, bool_or(fold > 0) AS moved FROM f GROUP BY fold"""))
def q_oof_leakage(spark, sf):
    """No model sees its own fold: with all labels of fold 0 turned round, the scores of
    fold 0 stay as they are (up to the order of sums), those of the other folds move."""
    c = customer_table(spark, sf)
    turned = folds.assign_folds(c, "c_custkey", 3, 0, "_f").withColumn(
        "TARGET", F.when(F.col("_f") == 0, 1 - F.col("TARGET")).otherwise(F.col("TARGET"))).drop("_f")
    plain = LogisticRegression(featuresCol=model_store.FEATURES, labelCol="TARGET", regParam=0.1, tol=1e-10)
    scores = []
    for table, name in ((c, "a"), (turned, "b")):
        fitted = model_store.fit_fold_models(table, CUSTOMER_ROLES, 3, estimator=plain)
        scores.append(model_store.score_known(fitted, table).select("c_custkey", "fold", F.col("prob1").alias(name)))
    both = scores[0].join(scores[1].drop("fold"), "c_custkey")
    same = F.abs(F.col("a") - F.col("b")) < 1e-6
    return both.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and((F.col("fold") > 0) | same).alias("blind"), F.bool_or(~same).alias("moved"))
