"""Queries over the benchmark tables, one per operator, each with an
equivalent SQL text for an independent engine.

Role mapping (the tables have no parcels or permits, so they play them):

* entity  = ``customer``; its address is ``c_name``.
* events ("permits") = ``orders``: class = ``o_totalprice < 100000``
  ('Residential'), type = ``o_orderpriority`` with a coarser mapped type in
  which '2-HIGH' counts as '1-URGENT', status = ``o_orderstatus`` with 'P'
  unknown (null), address = 'CUSTOMER#' || key padded to 9 digits (null for
  key 0).  Pending = class Residential, type '1-URGENT', status not 'F'.
* scored rows = ``lineitem`` with score ``floor(l_extendedprice / 105) /
  1000`` and label ``l_returnflag = 'R'``.
* value history = ``orders`` / ``lineitem`` by year.

Every query reads whole tables.  Names of computed columns are identical in
the Spark result and in the SQL text; types are cast alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelrisk.functions.scalars import (
    bool_to_int, composite_key, numeric_key_to_string, safe_ratio,
)
from parcelrisk.operators import clean, evaluate, folds, grid, match, profile, reshape, schema
from parcelrisk.plans.recipes import pending_permits
from parcelrisk.plans.registry import query, t

# --------------------------------------------------------------------- roles

def permits(orders: DataFrame) -> DataFrame:
    """Orders in the shape of a permit table."""
    addr = F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_totalprice") < 100000, F.lit("Residential"))
         .otherwise(F.lit("Commercial")).alias("permit_class"),
        F.col("o_orderpriority").alias("type_desc"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("1-URGENT"))
         .otherwise(F.col("o_orderpriority")).alias("type_mapped"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.nullif(addr, F.lit("CUSTOMER#000000000")).alias("address"))


PERMITS_SQL = """
permits AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
         CASE WHEN o_totalprice < 100000 THEN 'Residential' ELSE 'Commercial' END AS permit_class,
         o_orderpriority AS type_desc,
         CASE WHEN o_orderpriority = '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END AS type_mapped,
         nullif(o_orderstatus, 'P') AS status,
         nullif('CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), 'CUSTOMER#000000000') AS address
  FROM orders)"""

PENDING_COLS = ["o_orderkey", "o_custkey", "address", "status", "o_orderpriority", "o_totalprice"]


def pending(orders: DataFrame) -> DataFrame:
    return pending_permits(permits(orders), class_col="permit_class", class_value="Residential",
                           type_cols=["type_desc", "type_mapped"], type_value="1-URGENT",
                           status_col="status", closed_values=["F"], address_col="address",
                           keep=PENDING_COLS)


PENDING_SQL = PERMITS_SQL + """,
pending AS (
  SELECT o_orderkey, o_custkey, address, status, o_orderpriority, o_totalprice FROM permits
  WHERE permit_class = 'Residential'
    AND (coalesce(type_desc = '1-URGENT', false) OR coalesce(type_mapped = '1-URGENT', false))
    AND status IS DISTINCT FROM 'F'
    AND address IS NOT NULL)"""


def labels(spark, sf):
    return match.flag_membership(t(spark, sf, "customer"), pending(t(spark, sf, "orders")),
                                 "c_name", "address", out="TARGET")


LABELS_SQL = PENDING_SQL + """,
pkeys AS (SELECT DISTINCT lower(address) AS k FROM pending WHERE address IS NOT NULL),
labelled AS (
  SELECT c.*, CAST(CASE WHEN p.k IS NULL THEN 0 ELSE 1 END AS INTEGER) AS TARGET
  FROM customer c LEFT JOIN pkeys p ON lower(c.c_name) = p.k)"""


def scored(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag",
                     (F.floor(F.col("l_extendedprice") / 105) / 1000).alias("score"),
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))


SCORED_SQL = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag,
         floor(l_extendedprice / 105) / 1000 AS score,
         CAST(l_returnflag = 'R' AS INTEGER) AS label
  FROM lineitem)"""


def _w(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


# ------------------------------------------------------------ filters, label

@query("pending_filter", _w(PENDING_SQL, "SELECT * FROM pending"))
def q_pending_filter(spark, sf):
    return pending(t(spark, sf, "orders"))


@query("label_membership", _w(LABELS_SQL, "SELECT c_custkey, c_name, TARGET FROM labelled"))
def q_label_membership(spark, sf):
    return labels(spark, sf).select("c_custkey", "c_name", "TARGET")


@query("base_rate_by_segment", _w(LABELS_SQL, """
SELECT c_mktsegment, count(*) AS n_rows, CAST(sum(TARGET) AS BIGINT) AS n_pos,
       CAST(sum(TARGET) AS DOUBLE) / count(*) AS base_rate,
       round(avg(c_acctbal), 6) AS mean_acctbal, min(c_acctbal) AS min_acctbal,
       max(c_acctbal) AS max_acctbal
FROM labelled GROUP BY c_mktsegment"""))
def q_base_rate_by_segment(spark, sf):
    return labels(spark, sf).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("TARGET").cast("bigint").alias("n_pos"),
        (F.sum("TARGET").cast("double") / F.count(F.lit(1))).alias("base_rate"),
        F.round(F.avg("c_acctbal"), 6).alias("mean_acctbal"),
        F.min("c_acctbal").alias("min_acctbal"), F.max("c_acctbal").alias("max_acctbal"))


# -------------------------------------------------------------------- joins

@query("inner_join_features", """
WITH p AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS sum_price
           FROM orders GROUP BY o_custkey)
SELECT g.c_custkey, g.c_name, g.c_mktsegment, p.n_orders, p.sum_price
FROM customer g JOIN p ON g.c_custkey = p.o_custkey""")
def q_inner_join_features(spark, sf):
    g = t(spark, sf, "customer").alias("g")
    p = t(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("sum_price")).alias("p")
    return g.join(p, F.col("g.c_custkey") == F.col("p.o_custkey"), "inner") \
        .select("g.c_custkey", "g.c_name", "g.c_mktsegment", "p.n_orders", "p.sum_price")


@query("join_two_keys", """
SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderstatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus""")
def q_join_two_keys(spark, sf):
    j = match.join_on(t(spark, sf, "lineitem"), t(spark, sf, "orders"),
                      ["l_orderkey", "l_linestatus"], ["o_orderkey", "o_orderstatus"])
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_orderstatus")


UNIVERSE_SQL = """,
u1 AS (SELECT DISTINCT lower(c_name) AS k FROM customer WHERE c_mktsegment = 'BUILDING'),
u2 AS (SELECT DISTINCT lower(c_name) AS k FROM customer WHERE c_nationkey < 12)"""


def _universes(spark, sf):
    c = t(spark, sf, "customer")
    return [c.where(F.col("c_mktsegment") == "BUILDING"), c.where(F.col("c_nationkey") < 12)]


@query("match_semi", _w(PENDING_SQL + UNIVERSE_SQL, """
SELECT o_orderkey, address FROM pending WHERE lower(address) IN (SELECT k FROM u1)"""))
def q_match_semi(spark, sf):
    return match.matched(pending(t(spark, sf, "orders")), _universes(spark, sf)[0],
                         "address", "c_name").select("o_orderkey", "address")


@query("match_anti", _w(PENDING_SQL + UNIVERSE_SQL, """
SELECT o_orderkey, address FROM pending p
WHERE NOT EXISTS (SELECT 1 FROM u1 WHERE u1.k = lower(p.address))"""))
def q_match_anti(spark, sf):
    return match.unmatched(pending(t(spark, sf, "orders")), _universes(spark, sf)[0],
                           "address", "c_name").select("o_orderkey", "address")


STAGED_SQL = PENDING_SQL + UNIVERSE_SQL + """,
firsts AS (SELECT k, min(s) AS stage FROM (SELECT k, 1 AS s FROM u1 UNION ALL SELECT k, 2 AS s FROM u2)
           GROUP BY k),
staged AS (SELECT p.o_orderkey, p.address, CAST(f.stage AS INTEGER) AS stage
           FROM pending p LEFT JOIN firsts f ON lower(p.address) = f.k)"""


def _staged(spark, sf):
    return match.staged_match(pending(t(spark, sf, "orders")), _universes(spark, sf),
                              "address", "c_name").select("o_orderkey", "address", "stage")


@query("staged_match", _w(STAGED_SQL, "SELECT * FROM staged"))
def q_staged_match(spark, sf):
    return _staged(spark, sf)


@query("staged_match_report", _w(STAGED_SQL,
                                 "SELECT stage, count(*) AS n_rows FROM staged GROUP BY stage"))
def q_staged_match_report(spark, sf):
    return match.match_report(_staged(spark, sf), "stage")


@query("staged_match_summary", _w(STAGED_SQL, """
SELECT s.stage, CAST(count(CASE WHEN st.stage = s.stage THEN 1 END) AS BIGINT) AS matched,
       CAST(count(CASE WHEN st.stage IS NULL OR st.stage > s.stage THEN 1 END) AS BIGINT) AS unmatched_after
FROM (SELECT 1 AS stage UNION ALL SELECT 2) s CROSS JOIN staged st GROUP BY s.stage"""))
def q_staged_match_summary(spark, sf):
    return match.match_summary(_staged(spark, sf), 2)


@query("lookup_retyped_key", """
SELECT o.o_orderkey, CAST(CAST(CAST(o.o_custkey AS DOUBLE) AS BIGINT) AS VARCHAR) AS cust_key,
       c.c_name
FROM orders o JOIN customer c
  ON CAST(CAST(CAST(o.o_custkey AS DOUBLE) AS BIGINT) AS VARCHAR) = CAST(c.c_custkey AS VARCHAR)""")
def q_lookup_retyped_key(spark, sf):
    o = t(spark, sf, "orders").select(
        "o_orderkey", numeric_key_to_string(F.col("o_custkey").cast("double")).alias("cust_key"))
    c = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cust_key"), "c_name")
    return o.join(c, on="cust_key", how="inner").select("o_orderkey", "cust_key", "c_name")


@query("batch_lookup", _w(LABELS_SQL, """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT c_custkey FROM labelled WHERE TARGET = 1)"""))
def q_batch_lookup(spark, sf):
    pos = labels(spark, sf).where(F.col("TARGET") == 1).select("c_custkey")
    return match.batch_lookup(pos, t(spark, sf, "customer"), "c_custkey",
                              ["c_name", "c_acctbal", "c_mktsegment"])


# ------------------------------------------------------------------ scalars

@query("composite_pin", """
SELECT l_orderkey, l_linenumber,
  (CASE WHEN length(CAST(l_orderkey AS VARCHAR)) >= 6 THEN CAST(l_orderkey AS VARCHAR)
        ELSE lpad(CAST(l_orderkey AS VARCHAR), 6, '0') END) ||
  (CASE WHEN length(CAST(l_linenumber AS VARCHAR)) >= 4 THEN CAST(l_linenumber AS VARCHAR)
        ELSE lpad(CAST(l_linenumber AS VARCHAR), 4, '0') END) AS pin
FROM lineitem""")
def q_composite_pin(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     composite_key(["l_orderkey", "l_linenumber"], [6, 4]).alias("pin"))


@query("safe_ratios", """
SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS total_value,
       l_extendedprice / nullif(l_quantity, 0) AS value_per_unit,
       l_tax / nullif(l_discount, 0) AS tax_over_discount,
       l_tax / nullif(l_tax + l_discount, 0) AS tax_share
FROM lineitem""")
def q_safe_ratios(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_extendedprice") + F.col("l_tax")).alias("total_value"),
                     safe_ratio("l_extendedprice", "l_quantity").alias("value_per_unit"),
                     safe_ratio("l_tax", "l_discount").alias("tax_over_discount"),
                     safe_ratio(F.col("l_tax"), F.col("l_tax") + F.col("l_discount")).alias("tax_share"))


@query("flag_columns", """
WITH yn AS (
  SELECT l_orderkey, l_linenumber, l_discount,
         CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'N' THEN NULL ELSE 'N' END AS returned,
         CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'y' END AS finished
  FROM lineitem)
SELECT l_orderkey, l_linenumber,
       CAST(coalesce(returned = 'Y', false) AS INTEGER) AS returned,
       CAST(coalesce(finished = 'Y', false) AS INTEGER) AS finished,
       CAST(coalesce(CASE WHEN l_discount = 0 THEN NULL ELSE l_discount > 0.05 END, false) AS INTEGER)
         AS big_discount
FROM yn""")
def q_flag_columns(spark, sf):
    li = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "N", None)
         .otherwise("N").alias("returned"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("y").alias("finished"),
        F.when(F.col("l_discount") == 0, None).otherwise(F.col("l_discount") > 0.05)
         .alias("big_discount"))
    out = clean.flag_columns(li, ["returned", "finished", "returned"])
    return out.withColumn("big_discount", bool_to_int("big_discount"))


@query("fill_null", """
SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'NaN') AS c_mktsegment FROM customer""")
def q_fill_null(spark, sf):
    c = t(spark, sf, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("c_mktsegment"))
    return clean.fill_null(c, {"c_mktsegment": "NaN"})


@query("round_half_even", """
SELECT o_orderkey, round_even(o_totalprice / 1000, 0) AS price_k FROM orders""")
def q_round_half_even(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", F.bround(F.col("o_totalprice") / 1000, 0).alias("price_k"))


# ------------------------------------------------------- reshape, profiling

@query("pivot_sum_year", """
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ALL""")
def q_pivot_sum_year(spark, sf):
    """One column per year that the orders have, returned year by year (so that
    no year is written down anywhere and none can be missing)."""
    o = t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    p = reshape.pivot_by(o, "o_custkey", "year", "o_totalprice", "sum")
    long = reshape.unpivot_years(p, "o_custkey", "total")
    return long.withColumn("total", F.round("total", 2))


@query("pivot_mean_year", """
SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, round_even(avg(l_quantity), 0) AS mean_quantity
FROM lineitem GROUP BY ALL""")
def q_pivot_mean_year(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    wide = reshape.pivot_by(li, "l_suppkey", "year", "l_quantity", "mean", round_to=0)
    return reshape.unpivot_years(wide, "l_suppkey", "mean_quantity")


@query("group_mean", """
SELECT l_returnflag,
  round(avg(l_orderkey), 6) AS l_orderkey, round(avg(l_partkey), 6) AS l_partkey,
  round(avg(l_suppkey), 6) AS l_suppkey, round(avg(l_linenumber), 6) AS l_linenumber,
  round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
  round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax
FROM lineitem GROUP BY l_returnflag""")
def q_group_mean(spark, sf):
    g = reshape.group_mean(t(spark, sf, "lineitem"), ["l_returnflag"])
    return g.select("l_returnflag", *[F.round(c, 6).alias(c) for c in g.columns[1:]])


@query("group_nonnull", """
SELECT l_returnflag, count(l_orderkey) AS l_orderkey, count(nullif(l_linestatus, 'O')) AS l_linestatus,
       count(CASE WHEN l_discount > 0 THEN l_discount END) AS l_discount
FROM lineitem GROUP BY l_returnflag""")
def q_group_nonnull(spark, sf):
    li = t(spark, sf, "lineitem").select(
        "l_returnflag", "l_orderkey", F.nullif(F.col("l_linestatus"), F.lit("O")).alias("l_linestatus"),
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"))
    return reshape.group_nonnull(li, ["l_returnflag"])


@query("mean_group_size", """
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_groups,
       CAST(count(*) AS DOUBLE) / count(DISTINCT l_orderkey) AS mean_group_size
FROM lineitem""")
def q_mean_group_size(spark, sf):
    return reshape.mean_group_size(t(spark, sf, "lineitem"), ["l_orderkey"])


@query("value_counts", """
SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderstatus = 'P'
GROUP BY o_orderpriority ORDER BY count DESC, o_orderpriority""")
def q_value_counts(spark, sf):
    o = t(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    return profile.value_counts(o, "o_orderpriority")


@query("distinct_values", """
SELECT DISTINCT nullif(o_orderstatus, 'P') AS status FROM orders ORDER BY status NULLS LAST""")
def q_distinct_values(spark, sf):
    o = t(spark, sf, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return profile.distinct_values(o, "status")


@query("distinct_count", """
SELECT CAST(count(DISTINCT k) + max(CAST(k IS NULL AS INTEGER)) AS BIGINT) AS n_distinct
FROM (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey END AS k FROM lineitem)""")
def q_distinct_count(spark, sf):
    li = t(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_partkey")).alias("k"))
    return profile.distinct_count(li, "k")


_ORDERS_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                 ("o_orderpriority", "string")]


@query("null_profile", "WITH o AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS "
       "o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)\n" + "\nUNION ALL\n".join(
           f"SELECT '{c}' AS column_name, '{ty}' AS data_type, CAST(count(*) - count({c}) AS BIGINT) "
           f"AS nulls, CAST(count({c}) AS BIGINT) AS non_nulls FROM o" for c, ty in _ORDERS_TYPES))
def q_null_profile(spark, sf):
    o = t(spark, sf, "orders").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return profile.null_profile(o.select(*[c for c, _ in _ORDERS_TYPES]))


_CUSTOMER_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                   ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("schema_report", "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{ty}' AS data_type, count(*) AS n_rows FROM customer"
    for i, (c, ty) in enumerate(_CUSTOMER_TYPES)))
def q_schema_report(spark, sf):
    return schema.schema_report(t(spark, sf, "customer"))


@query("describe_by_class", """
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min,
       round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, max(l_extendedprice) AS max
FROM lineitem GROUP BY l_returnflag""")
def q_describe_by_class(spark, sf):
    d = profile.describe_by(t(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return d.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                    "min", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "max")


@query("separation_ratio", _w(SCORED_SQL, """
SELECT round(avg(CASE WHEN label = 1 THEN score END), 9) AS mean_pos,
       round(avg(CASE WHEN label = 0 THEN score END), 9) AS mean_neg,
       round(avg(score), 9) AS mean_all, round(avg(label), 9) AS base_rate,
       round(avg(CASE WHEN label = 1 THEN score END) / avg(CASE WHEN label = 0 THEN score END), 9) AS ratio,
       round(avg(CASE WHEN label = 1 THEN score END) / avg(score), 9) AS lift
FROM scored"""))
def q_separation_ratio(spark, sf):
    s = profile.separation(scored(spark, sf), "score", "label")
    return s.select(*[F.round(c, 9).alias(c) for c in
                      ("mean_pos", "mean_neg", "mean_all", "base_rate", "ratio", "lift")])


def _hist_sql(bins: int, by: bool, density: bool) -> str:
    grp = "label, " if by else ""
    dens = ", CAST(coalesce(h.count, 0) AS DOUBLE) / (n.n * r.w) AS density" if density else ""
    return _w(SCORED_SQL, f"""
, r AS (SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / {bins} AS w FROM scored),
g AS ({'SELECT DISTINCT label FROM scored' if by else 'SELECT 1 AS one'}),
grid AS (SELECT {'g.label, ' if by else ''}b.bin FROM g, (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) b),
h AS (SELECT {grp}CAST(least(floor((score - r.lo) / r.w), {bins - 1}) AS INTEGER) AS bin, count(*) AS count
      FROM scored, r WHERE score >= r.lo AND score <= r.hi GROUP BY ALL),
n AS (SELECT {'label, ' if by else ''}sum(count) AS n FROM h {'GROUP BY label' if by else ''})
SELECT {'grid.label, ' if by else ''}grid.bin, r.lo + grid.bin * r.w AS bin_lo,
       r.lo + (grid.bin + 1) * r.w AS bin_hi, CAST(coalesce(h.count, 0) AS BIGINT) AS count{dens}
FROM grid CROSS JOIN r
LEFT JOIN h ON grid.bin = h.bin {'AND grid.label = h.label' if by else ''}
{'LEFT JOIN n ON grid.label = n.label' if by else 'CROSS JOIN n'}""")


@query("histogram", _hist_sql(500, False, False))
def q_histogram(spark, sf):
    return profile.histogram(scored(spark, sf), "score", 500)


@query("histogram_density", _hist_sql(500, True, True))
def q_histogram_density(spark, sf):
    return profile.histogram(scored(spark, sf), "score", 500, by=["label"], density=True)


@query("date_histogram", """
WITH e AS (SELECT epoch(o_orderdate) AS x FROM orders),
r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS w FROM e),
h AS (SELECT CAST(least(floor((x - r.lo) / r.w), 9) AS INTEGER) AS bin, count(*) AS count
      FROM e, r GROUP BY ALL),
grid AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT grid.bin, CAST(coalesce(h.count, 0) AS BIGINT) AS count
FROM grid LEFT JOIN h ON grid.bin = h.bin""")
def q_date_histogram(spark, sf):
    return profile.date_histogram(t(spark, sf, "orders"), "o_orderdate", 10).select("bin", "count")


@query("box_stats", """
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
                  quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders GROUP BY o_orderpriority),
l AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lim_lo, q3 + 1.5 * (q3 - q1) AS lim_hi FROM q)
SELECT o.o_orderpriority, round(any_value(l.q1), 6) AS q1, round(any_value(l.median), 6) AS median,
       round(any_value(l.q3), 6) AS q3,
       min(CASE WHEN o_totalprice >= lim_lo THEN o_totalprice END) AS whisker_lo,
       max(CASE WHEN o_totalprice <= lim_hi THEN o_totalprice END) AS whisker_hi,
       CAST(sum(CAST(o_totalprice < lim_lo OR o_totalprice > lim_hi AS INTEGER)) AS BIGINT) AS n_outliers
FROM orders o JOIN l ON o.o_orderpriority = l.o_orderpriority GROUP BY o.o_orderpriority""")
def q_box_stats(spark, sf):
    b = profile.box_stats(t(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return b.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")],
                    "whisker_lo", "whisker_hi", "n_outliers")


# ------------------------------------------------------- order, lookups, SQL

@query("topk", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20""")
def q_topk(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return clean.top_k(o, "o_totalprice", 20, ["o_orderkey"])


@query("sorted_slice", """
SELECT o_orderkey, nullif(o_totalprice, 0) AS price FROM orders
WHERE o_orderstatus IS NOT NULL
ORDER BY price ASC NULLS LAST, o_orderkey LIMIT 50""")
def q_sorted_slice(spark, sf):
    o = t(spark, sf, "orders").na.drop(subset=["o_orderstatus"]) \
        .select("o_orderkey", F.nullif(F.col("o_totalprice"), F.lit(0.0)).alias("price"))
    return clean.sort_nulls_last(o, ["price", "o_orderkey"]).limit(50)


@query("row_at", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 4760""")
def q_row_at(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return clean.row_at(o, ["o_orderkey"], 4760)


@query("row_at_far", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
                  count(*) OVER () AS n
           FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM r WHERE pos = n * 2 // 3""")
def q_row_at_far(spark, sf):
    """The line two thirds of the way down a total order of the lines (the
    four key columns): a position far from the head, numbered by a
    distributed sort."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = t(spark, sf, "lineitem").select(*key, "l_quantity")
    n = li.count()                                       # one number
    return clean.row_at(li, key, n * 2 // 3)


@query("row_at_ties", """
SELECT nullif(o_orderstatus, 'P') AS status FROM orders ORDER BY status NULLS LAST
LIMIT 1 OFFSET (SELECT count(*) - 2 FROM orders)""")
def q_row_at_ties(spark, sf):
    """A position among ties: the order column has three values, one null."""
    o = t(spark, sf, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return clean.row_at(o, ["status"], o.count() - 2)


@query("column_slice", "SELECT l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def q_column_slice(spark, sf):
    return schema.column_slice(t(spark, sf, "lineitem"), 2, 6)


@query("record_profile", """
SELECT c_custkey, column_name, value FROM (
  SELECT c_custkey, 'c_name' AS column_name, c_name AS value FROM customer WHERE c_custkey = 42
  UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 42
  UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_custkey = 42
  UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey = 42)""")
def q_record_profile(spark, sf):
    rec = clean.lookup(t(spark, sf, "customer"), "c_custkey", 42)
    return reshape.record_profile(rec, "c_custkey")


@query("sql_point_lookup", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       o_orderpriority FROM orders WHERE o_orderkey = 4242""")
def q_sql_point_lookup(spark, sf):
    return spark.sql(
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) "
        "AS o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey = :key",
        args={"key": 4242}, orders=t(spark, sf, "orders"))


@query("sql_filter_and", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
  AND o_orderstatus = 'F'""")
def q_sql_filter_and(spark, sf):
    t(spark, sf, "orders").createOrReplaceTempView("pr_orders")
    return spark.sql(
        "SELECT o_orderkey, o_custkey, o_totalprice FROM pr_orders "
        "WHERE o_orderdate >= CAST(:lo AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:hi AS TIMESTAMP_NTZ) "
        "AND o_orderstatus = :status",
        args={"lo": "1998-01-01", "hi": "1999-01-01", "status": "F"})


# ------------------------------------------------------------ folds, splits

FOLD_SQL = "CAST(CAST(('0x' || substr(md5(CAST({k} AS VARCHAR) || '#{s}'), 1, 8)) AS BIGINT) % {n} AS INTEGER)"


@query("fold_assign", "SELECT c_custkey, " + FOLD_SQL.format(k="c_custkey", s=42, n=10)
       + " AS fold FROM customer")
def q_fold_assign(spark, sf):
    return folds.assign_folds(t(spark, sf, "customer").select("c_custkey"), "c_custkey", 10, 42)


@query("hash_split", "SELECT c_custkey, CAST(CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || "
       "'#7'), 1, 8)) AS BIGINT) % 10000 < 7000 AS INTEGER) AS is_train FROM customer")
def q_hash_split(spark, sf):
    return folds.hash_split(t(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.7, 7)


@query("fold_balance", _w(LABELS_SQL, """
SELECT fold, count(*) AS n_rows, CAST(sum(TARGET) AS BIGINT) AS n_pos,
       CAST(sum(TARGET) AS DOUBLE) / count(*) AS pos_rate
FROM (SELECT TARGET, """ + FOLD_SQL.format(k="c_custkey", s=42, n=10) + """ AS fold FROM labelled)
GROUP BY fold"""))
def q_fold_balance(spark, sf):
    lab = folds.assign_folds(labels(spark, sf), "c_custkey", 10, 42)
    return lab.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("TARGET").cast("bigint").alias("n_pos"),
        (F.sum("TARGET").cast("double") / F.count(F.lit(1))).alias("pos_rate"))


# --------------------------------------------------------------- evaluation

CURVE_SQL = SCORED_SQL + """,
c AS (SELECT score AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
      FROM scored GROUP BY score),
w AS (SELECT threshold, pos, neg,
        CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tps,
        CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fps,
        CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N
      FROM c),
pts AS (
  SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tps, CAST(0 AS BIGINT) AS fps,
         CAST(0.0 AS DOUBLE) AS tpr, CAST(0.0 AS DOUBLE) AS fpr
  UNION ALL
  SELECT threshold, tps, fps, CAST(tps AS DOUBLE) / P AS tpr, CAST(fps AS DOUBLE) / N AS fpr FROM w)"""


@query("roc_curve", _w(CURVE_SQL, "SELECT * FROM pts"))
def q_roc_curve(spark, sf):
    return evaluate.roc_points(scored(spark, sf), "score", "label")


@query("roc_curve_dropped", _w(CURVE_SQL, """
, flagged AS (SELECT *, lead(pos) OVER (ORDER BY threshold DESC) AS npos,
                     lead(neg) OVER (ORDER BY threshold DESC) AS nneg,
                     row_number() OVER (ORDER BY threshold DESC) AS rn FROM w)
SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tps, CAST(0 AS BIGINT) AS fps,
       CAST(0.0 AS DOUBLE) AS tpr, CAST(0.0 AS DOUBLE) AS fpr
UNION ALL
SELECT threshold, tps, fps, CAST(tps AS DOUBLE) / P, CAST(fps AS DOUBLE) / N FROM flagged
WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg"""))
def q_roc_curve_dropped(spark, sf):
    return evaluate.roc_points(scored(spark, sf), "score", "label", drop_intermediate=True)


@query("auc_trapezoid", _w(CURVE_SQL, """
SELECT CAST(sum(CAST(neg AS HUGEINT) * CAST(2 * tps - pos AS HUGEINT)) AS DOUBLE)
       / (2.0 * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS auc FROM w"""))
def q_auc_trapezoid(spark, sf):
    return evaluate.auc(scored(spark, sf), "score", "label", "trapezoid")


@query("auc_right", _w(CURVE_SQL, """
SELECT CAST(sum(CAST(neg AS HUGEINT) * CAST(tps AS HUGEINT)) AS DOUBLE)
       / (1.0 * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS auc FROM w"""))
def q_auc_right(spark, sf):
    return evaluate.auc(scored(spark, sf), "score", "label", "right")


KEPT_SQL = """
, flagged AS (SELECT *, lead(pos) OVER (ORDER BY threshold DESC) AS npos,
                     lead(neg) OVER (ORDER BY threshold DESC) AS nneg,
                     row_number() OVER (ORDER BY threshold DESC) AS rn FROM w),
kept AS (SELECT threshold, tps, fps, P, N FROM flagged
         WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg),
kept_pts AS (
  SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0.0 AS DOUBLE) AS tpr
  UNION ALL SELECT threshold, CAST(tps AS DOUBLE) / P FROM kept)"""


@query("auc_right_dropped", _w(CURVE_SQL, KEPT_SQL + """
, steps AS (SELECT tps, P, N, fps - coalesce(lag(fps) OVER (ORDER BY threshold DESC), 0) AS dfps FROM kept)
SELECT CAST(sum(CAST(dfps AS HUGEINT) * CAST(tps AS HUGEINT)) AS DOUBLE)
       / (1.0 * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)) AS auc FROM steps"""))
def q_auc_right_dropped(spark, sf):
    """The right-rectangle area on the reduced curve (the default curve of
    the evaluation notebooks)."""
    return evaluate.auc(scored(spark, sf), "score", "label", "right", drop_intermediate=True)


@query("curve_summary_dropped", _w(CURVE_SQL, KEPT_SQL + """
SELECT round(avg(tpr), 9) AS mean_tpr,
       round(sum(coalesce(tpr * threshold, 0.0)) / count(*), 9) AS mean_tpr_x_threshold,
       count(*) AS n_points FROM kept_pts"""))
def q_curve_summary_dropped(spark, sf):
    s = evaluate.curve_summary(evaluate.roc_points(scored(spark, sf), "score", "label",
                                                   drop_intermediate=True))
    return s.select(F.round("mean_tpr", 9).alias("mean_tpr"),
                    F.round("mean_tpr_x_threshold", 9).alias("mean_tpr_x_threshold"), "n_points")


@query("curve_summary", _w(CURVE_SQL, """
SELECT round(avg(tpr), 9) AS mean_tpr,
       round(sum(coalesce(tpr * threshold, 0.0)) / count(*), 9) AS mean_tpr_x_threshold,
       count(*) AS n_points FROM pts"""))
def q_curve_summary(spark, sf):
    s = evaluate.curve_summary(evaluate.roc_points(scored(spark, sf), "score", "label"))
    return s.select(F.round("mean_tpr", 9).alias("mean_tpr"),
                    F.round("mean_tpr_x_threshold", 9).alias("mean_tpr_x_threshold"), "n_points")


@query("log_loss", _w(SCORED_SQL, """
SELECT round(avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15))
             + (1.0 - label) * ln(1.0 - least(greatest(score, 1e-15), 1 - 1e-15)))), 9) AS log_loss
FROM scored"""))
def q_log_loss(spark, sf):
    return evaluate.log_loss(scored(spark, sf), "score", "label") \
        .select(F.round("log_loss", 9).alias("log_loss"))


@query("key_uniqueness", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_key_uniqueness(spark, sf):
    return schema.duplicate_keys(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("pending_filter_variant", _w(PERMITS_SQL, """
SELECT o_orderkey, o_custkey, address, status, o_orderpriority, o_totalprice FROM permits
WHERE permit_class = 'Residential' AND coalesce(type_desc = '1-URGENT', false)
  AND status IS DISTINCT FROM 'F' AND address IS NOT NULL"""))
def q_pending_filter_variant(spark, sf):
    """The variant that tests the detailed type only."""
    return pending_permits(permits(t(spark, sf, "orders")), class_col="permit_class",
                           class_value="Residential", type_cols=["type_desc"], type_value="1-URGENT",
                           status_col="status", closed_values=["F"], address_col="address",
                           keep=PENDING_COLS)


@query("auc_evaluator", _w(CURVE_SQL, """
SELECT round(CAST(sum(CAST(neg AS HUGEINT) * CAST(2 * tps - pos AS HUGEINT)) AS DOUBLE)
       / (2.0 * CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE)), 9) AS auc FROM w"""))
def q_auc_evaluator(spark, sf):
    """Area under ROC from MLlib's evaluator on the score column."""
    v = evaluate.auc_roc(scored(spark, sf), "score", "label")
    return spark.createDataFrame([(round(v, 9),)], "auc double")


@query("heat_map", """
WITH s AS (SELECT l_quantity, l_discount, floor(l_extendedprice / 105) / 1000 AS score FROM lineitem)
SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS cell_x, CAST(floor(l_discount / 0.02) AS BIGINT) AS cell_y,
       count(*) AS n_rows, round(avg(score), 9) AS mean_value, round(sum(score), 6) AS sum_value
FROM s GROUP BY ALL""")
def q_heat_map(spark, sf):
    li = t(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", (F.floor(F.col("l_extendedprice") / 105) / 1000).alias("score"))
    h = grid.heat_map(li, "l_quantity", "l_discount", 5, 0.02, "score")
    return h.select("cell_x", "cell_y", "n_rows", F.round("mean_value", 9).alias("mean_value"),
                    F.round("sum_value", 6).alias("sum_value"))


@query("neighbours", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
       sqrt(power(l_quantity - 25.0, 2) + power(l_discount * 100 - 5.0, 2)) AS distance
FROM lineitem
WHERE sqrt(power(l_quantity - 25.0, 2) + power(l_discount * 100 - 5.0, 2)) <= 1.5""")
def q_neighbours(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                         (F.col("l_discount") * 100).alias("_y"))
    return grid.neighbours(li, "l_quantity", "_y", 25.0, 5.0, 1.5).drop("_y")
