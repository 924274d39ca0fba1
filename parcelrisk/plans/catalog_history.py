"""What changes with time: labels that are withdrawn, attributes as of a year, and
the store of yearly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.operators.approximate import near_texts, nearest_text
from parcelrisk.operators.asof import asof_join, yearly_state
from parcelrisk.operators.clean import union_all
from parcelrisk.plans.catalog import PERMITS_SQL, _w, permits
from parcelrisk.plans.registry import query, t
from parcelrisk.session import scratch_dir
from parcelrisk.sources.sinks import write_partitions


def status_records(orders: DataFrame, wave: int) -> DataFrame:
    """Records (key, address, status, at) of permits that arrive in three waves:
    all of them open; half of the finished ones closed; the others closed, some
    of the first half open again, and older records of it once more."""
    p = permits(orders).where((F.col("permit_class") == "Residential") & (
        (F.col("type_desc") == "1-URGENT") | (F.col("type_mapped") == "1-URGENT")))
    k, done = F.col("o_orderkey"), F.coalesce(F.col("status") == "F", F.lit(False))
    at = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(wave * 30), F.lit(0), F.lit(0), (k % 1000).cast("decimal(18,6)"))
    rows = p.select("o_orderkey", "address", at.alias("at"), done.alias("done"))
    record = ["o_orderkey", "address", "status", "at"]
    if wave == 0:
        return rows.withColumn("status", F.lit("Issued")).select(*record)
    closed = rows.where("done").withColumn("status", F.lit("Closed"))
    if wave == 1:
        return closed.where(k % 2 == 0).select(*record)
    again = closed.where((k % 2 == 0) & (k % 5 == 0)).withColumn("status", F.lit("Reopened"))
    old = again.withColumns({"status": F.lit("Closed"), "at": F.col("at") - F.expr("INTERVAL 1 HOUR")})
    return union_all([closed.where(k % 2 == 1), again, old]).select(*record)


@query("label_withdrawal", _w(PERMITS_SQL, """
, p AS (SELECT o_orderkey AS k, lower(address) AS a, coalesce(status = 'F', false) AS done FROM permits
        WHERE permit_class = 'Residential' AND (type_desc = '1-URGENT' OR type_mapped = '1-URGENT')),
open AS (
  SELECT 0 AS wave, a FROM p
  UNION SELECT 1, a FROM p WHERE NOT (done AND k % 2 = 0)
  UNION SELECT 2, a FROM p WHERE NOT done OR (k % 2 = 0 AND k % 5 = 0))
SELECT CAST(wave AS INTEGER) AS wave, c_custkey FROM open JOIN customer ON a = lower(c_name)"""))
def q_label_withdrawal(spark, sf):
    """The customers labelled after each of three arrivals of permit records, in
    which permits close and open again."""
    from parcelrisk.streaming import label_withdrawal_stream, labelled_entities
    base = scratch_dir(spark, "withdrawal")
    customers = t(spark, sf, "customer").select("c_custkey", "c_name")
    after = []
    for wave in range(3):
        records = status_records(t(spark, sf, "orders"), wave)
        records.write.parquet(f"{base}/in/wave={wave}")
        q = label_withdrawal_stream(
            spark, f"{base}/in", records.schema, "o_orderkey", "address", "at",
            F.col("status") != "Closed", f"{base}/log", f"{base}/checkpoint", grouped=True)
        q.awaitTermination()
        as_of = q.lastProgress["batchId"]
        after.append(labelled_entities(customers, "c_name", f"{base}/log", as_of).where("TARGET = 1")
                     .select(F.lit(wave).alias("wave"), "c_custkey"))
    return union_all(after)


# ------------------------------------------------------- state as of a year

_HISTORY_SQL = """
history AS (
  SELECT o_custkey, o_orderdate, max(o_totalprice) AS price, max(o_orderpriority) AS priority
  FROM orders GROUP BY o_custkey, o_orderdate)"""


def _history(spark, sf) -> DataFrame:
    """One record of a customer and day: what its attributes are from then on."""
    return t(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(
        F.max("o_totalprice").alias("price"), F.max("o_orderpriority").alias("priority"))


_YEARLY_SQL = _HISTORY_SQL + """,
f AS (SELECT o_custkey, min(year(o_orderdate)) AS first_year FROM history GROUP BY o_custkey),
m AS (SELECT max(year(o_orderdate)) AS last_year FROM history),
grid AS (SELECT o_custkey, unnest(generate_series(first_year, last_year)) AS year FROM f, m),
yearly AS (
  SELECT g.o_custkey, CAST(g.year AS INTEGER) AS year, h.price, h.priority
  FROM (SELECT *, make_timestamp(year + 1, 1, 1, 0, 0, 0) AS as_of FROM grid) g
  ASOF LEFT JOIN history h ON g.o_custkey = h.o_custkey AND g.as_of > h.o_orderdate)"""


def _yearly(spark, sf) -> DataFrame:
    h = _history(spark, sf)
    last = h.agg(F.max(F.year("o_orderdate"))).first()[0]            # one number
    return yearly_state(h, "o_custkey", "o_orderdate", ["price", "priority"], last)


@query("yearly_state", _w(_YEARLY_SQL, "SELECT * FROM yearly"))
def q_yearly_state(spark, sf):
    """Every customer in every year since its first record, with the attributes
    that were valid at the end of that year."""
    return _yearly(spark, sf)


@query("asof_attributes", _w(_HISTORY_SQL, """
SELECT l.l_orderkey, l.l_linenumber, h.price, h.priority
FROM (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) l
ASOF LEFT JOIN history h ON l.o_custkey = h.o_custkey AND l.l_shipdate >= h.o_orderdate"""))
def q_asof_attributes(spark, sf):
    """Every line with the attributes that its customer had when it was shipped."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate") \
        .join(o, "l_orderkey", "left")
    return asof_join(lines, _history(spark, sf), "o_custkey", "l_shipdate", "o_custkey", "o_orderdate",
                     ["price", "priority"]).drop("o_custkey", "l_shipdate")


@query("yearly_store", _w(_YEARLY_SQL, """
SELECT o_custkey, CASE WHEN year = (SELECT max(year) FROM yearly) THEN price + 1 ELSE price END AS price,
       priority, year FROM yearly"""))
def q_yearly_store(spark, sf):
    """The yearly tables in a store by year; the last year is computed anew and
    replaces its folder only; all years are read back."""
    path = scratch_dir(spark, "yearly-store")
    write_partitions(_yearly(spark, sf), path, ["year"], files_per_value=4)
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("year")).first()[0]
    again = stored.where(F.col("year") == last).withColumn("price", F.col("price") + 1)
    # the rows replaced are those read, so they are written elsewhere first
    write_partitions(again.checkpoint(), path, ["year"], files_per_value=4)
    return spark.read.parquet(path)


@query("store_pruned_join", _w(_YEARLY_SQL, """
SELECT y.o_custkey, y.year, y.price, y.priority FROM yearly y
JOIN (SELECT DISTINCT year(o_orderdate) AS year FROM orders
      WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders)) d ON y.year = d.year"""))
def q_store_pruned_join(spark, sf):
    """The years of the dearest orders out of the store: the folders of other
    years are pruned by the join itself."""
    path = scratch_dir(spark, "yearly-store")
    write_partitions(_yearly(spark, sf), path, ["year"])
    o = t(spark, sf, "orders")
    top = o.agg(F.max("o_totalprice")).first()[0]
    years = o.where(F.col("o_totalprice") >= top).select(F.year("o_orderdate").alias("year")).distinct()
    return spark.read.parquet(path).join(years, "year").select("o_custkey", "year", "price", "priority")


# ------------------------------------------------------- approximate addresses

_SLIPS_SQL = PERMITS_SQL + """,
slips AS (
  SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN address
    WHEN 1 THEN substr(address, 1, 3) || substr(address, 5)
    WHEN 2 THEN substr(address, 1, 12) || 'x' || substr(address, 13)
    WHEN 3 THEN replace(address, 'OM', 'MO')
    ELSE 'Old ' || address END AS address
  FROM permits)"""


def _slips(spark, sf) -> DataFrame:
    """Old addresses of events as people write them: right, with a letter
    lost, added or changed places, or with a word more."""
    k, a = F.col("o_orderkey"), F.col("address")
    kind = k % 5
    slip = F.when(kind == 0, a).when(kind == 1, F.concat(F.substring(a, 1, 3), F.substring(a, 5, 99))) \
        .when(kind == 2, F.concat(F.substring(a, 1, 12), F.lit("x"), F.substring(a, 13, 99))) \
        .when(kind == 3, F.replace(a, F.lit("OM"), F.lit("MO"))).otherwise(F.concat(F.lit("Old "), a))
    return permits(t(spark, sf, "orders")).select("o_orderkey", slip.alias("address"))


@query("near_addresses", _w(_SLIPS_SQL, """
, a AS (SELECT DISTINCT lower(address) AS l FROM slips WHERE address IS NOT NULL),
b AS (SELECT DISTINCT lower(c_name) AS r FROM customer WHERE c_name IS NOT NULL)
SELECT l AS left_text, r AS right_text, CAST(levenshtein(l, r) AS INTEGER) AS distance
FROM a JOIN b ON abs(length(l) - length(r)) <= 1 AND levenshtein(l, r) <= 1"""))
def q_near_addresses(spark, sf):
    """All pairs of an event's address and a customer's within one edit."""
    left = _slips(spark, sf).select(F.lower("address").alias("text")).where("text is not null")
    right = t(spark, sf, "customer").select(F.lower("c_name").alias("text")).where("text is not null")
    return near_texts(left, right, 1)


@query("near_address_area", _w(_SLIPS_SQL, """
, a AS (SELECT DISTINCT lower(address) AS l FROM slips WHERE address IS NOT NULL),
b AS (SELECT lower(c_name) AS r, min(c_nationkey) AS area FROM customer WHERE c_name IS NOT NULL GROUP BY 1),
near AS (
  SELECT l, levenshtein(l, r) AS d, area, row_number() OVER (PARTITION BY l ORDER BY levenshtein(l, r), r) AS n
  FROM a JOIN b ON abs(length(l) - length(r)) <= 2 AND levenshtein(l, r) <= 2)
SELECT o_orderkey, area, CAST(d AS INTEGER) AS area_distance,
       CASE WHEN d = 0 THEN 1 WHEN d = 1 THEN 2 WHEN d = 2 THEN 3 END AS area_stage
FROM slips LEFT JOIN near ON lower(address) = l AND n = 1"""))
def q_near_address_area(spark, sf):
    """Every event with the area of the customer whose address is nearest, and the
    stage (0, 1 or 2 edits) at which it matched."""
    return nearest_text(_slips(spark, sf), t(spark, sf, "customer"), "address", "c_name",
                        "c_nationkey", [0, 1, 2], out="area").drop("address")
