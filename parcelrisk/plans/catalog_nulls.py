"""Profiles over columns with nulls, NaN and infinities: NaN counts as null,
statistics skip it, and the null group is a group.  The values are put into
given tables by key, the same in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelrisk.operators import evaluate, folds, profile
from parcelrisk.plans.registry import query, t

_NAN, _INF = float("nan"), float("inf")


def holed(spark, sf):
    """Orders: every 7th price null, every 11th NaN; priority ``2-HIGH`` null,
    and priority ``3-MEDIUM`` without any price."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return t(spark, sf, "orders").select(
        "o_orderkey", F.nullif(p, F.lit("2-HIGH")).alias("priority"),
        F.when((k % 7 == 0) | (p == "3-MEDIUM"), F.lit(None)).when(k % 11 == 0, _NAN)
        .otherwise(F.col("o_totalprice")).alias("price"))


HOLED = """
WITH holed AS (
  SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS priority,
         CASE WHEN o_orderkey % 7 = 0 OR o_orderpriority = '3-MEDIUM' OR o_orderkey % 11 = 0
              THEN NULL ELSE o_totalprice END AS price
  FROM orders)"""


@query("describe_nulls", HOLED + """
SELECT priority, count(price) AS n, round(avg(price), 6) AS mean,
       round(stddev_samp(price), 6) AS std, min(price) AS min,
       round(quantile_cont(price, 0.25), 6) AS q25, round(quantile_cont(price, 0.5), 6) AS q50,
       round(quantile_cont(price, 0.75), 6) AS q75, max(price) AS max
FROM holed GROUP BY priority""")
def q_describe_nulls(spark, sf):
    d = profile.describe_by(holed(spark, sf), "price", ["priority"])
    return d.select("priority", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                    "min", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "max")


@query("box_nulls", HOLED + """,
q AS (SELECT priority, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
             quantile_cont(price, 0.75) AS q3 FROM holed GROUP BY priority),
l AS (SELECT *, q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM q)
SELECT h.priority, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3, min(CASE WHEN price >= lo THEN price END) AS whisker_lo,
       max(CASE WHEN price <= hi THEN price END) AS whisker_hi,
       CAST(count(CASE WHEN price < lo OR price > hi THEN 1 END) AS BIGINT) AS n_outliers
FROM holed h JOIN l ON h.priority IS NOT DISTINCT FROM l.priority GROUP BY h.priority""")
def q_box_nulls(spark, sf):
    b = profile.box_stats(holed(spark, sf), "price", ["priority"], whis=0.5)
    return b.select("priority", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")],
                    "whisker_lo", "whisker_hi", "n_outliers")


@query("histogram_nan", HOLED + """,
r AS (SELECT min(price) AS lo, max(price) AS hi, (max(price) - min(price)) / 20 AS w FROM holed),
h AS (SELECT CAST(least(floor((price - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n
      FROM holed, r WHERE price IS NOT NULL GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM range(20) b LEFT JOIN h ON b.range = h.bin""")
def q_histogram_nan(spark, sf):
    """Null, NaN and (in every 13th order) infinite prices are not counted."""
    df = holed(spark, sf).withColumn("price", F.when(
        (F.col("o_orderkey") % 13 == 0) & F.col("price").isNull(), _INF).otherwise(F.col("price")))
    return profile.histogram(df, "price", 20).select("bin", "count")


@query("value_counts_nan", HOLED + """
SELECT floor(price / 10000) AS band, count(*) AS count FROM holed
WHERE price IS NOT NULL GROUP BY 1""")
def q_value_counts_nan(spark, sf):
    df = holed(spark, sf).select(F.when(F.isnan("price"), _NAN).otherwise(
        F.floor(F.col("price") / 10000).cast("double")).alias("band"))
    return profile.value_counts(df, "band")


@query("log_loss_nulls", """
WITH s AS (SELECT l_discount * 10 AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label,
                  l_linenumber AS k FROM lineitem)
SELECT round(avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15))
             + (1.0 - label) * ln(1.0 - least(greatest(score, 1e-15), 1 - 1e-15)))), 9) AS log_loss
FROM s WHERE k NOT IN (1, 2, 3, 4)""")
def q_log_loss_nulls(spark, sf):
    """Rows of line 1 have a null score, of 2 NaN, of 3 infinity, of 4 no label."""
    k = F.col("l_linenumber")
    s = t(spark, sf, "lineitem").select(
        F.when(k == 1, F.lit(None)).when(k == 2, _NAN).when(k == 3, _INF)
        .otherwise(F.col("l_discount") * 10).alias("score"),
        F.when(k != 4, (F.col("l_returnflag") == "R").cast("int")).alias("label"))
    return evaluate.log_loss(s, "score", "label").select(F.round("log_loss", 9).alias("log_loss"))


@query("roc_infinite", """
WITH s AS (SELECT CASE WHEN l_linenumber = 1 THEN 'infinity'::DOUBLE
                       WHEN l_linenumber = 2 THEN '-infinity'::DOUBLE
                       ELSE floor(l_extendedprice / 1000) END AS score,
                  CAST(l_returnflag = 'R' AS BIGINT) AS y FROM lineitem),
c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
r AS (SELECT *, sum(pos) OVER w AS tps FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(neg * (2 * tps - pos)) / (2.0 * sum(pos) * sum(neg)), 9) AS auc FROM r""")
def q_roc_infinite(spark, sf):
    """Infinite scores are ordered as numbers."""
    k = F.col("l_linenumber")
    s = t(spark, sf, "lineitem").select(
        F.when(k == 1, _INF).when(k == 2, -_INF).otherwise(
            F.floor(F.col("l_extendedprice") / 1000).cast("double")).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return evaluate.auc(s, "score", "label").select(F.round("auc", 9).alias("auc"))


@query("fold_null_key", """
WITH k AS (SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS priority FROM orders)
SELECT o_orderkey, CAST(CAST(('0x' || substr(md5(coalesce(priority, '') || '#5'), 1, 8)) AS BIGINT) % 10
                        AS INTEGER) AS fold FROM k""")
def q_fold_null_key(spark, sf):
    """Rows without a key have a fold too, the same for all of them."""
    k = t(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH")).alias("priority"))
    return folds.assign_folds(k, "priority", 10, 5).select("o_orderkey", "fold")
