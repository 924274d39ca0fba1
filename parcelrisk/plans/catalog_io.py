"""Queries that go through storage -- CSV, zipped CSV, catalog tables,
run-stamped Parquet -- and the roll-ups stated as next steps.  Files are
written below the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelrisk.functions.scalars import epoch_seconds, run_stamp
from parcelrisk.operators.clean import union_all
from parcelrisk.plans.catalog import LABELS_SQL, SCORED_SQL, _w, pending, scored
from parcelrisk.plans.registry import query, t
from parcelrisk.session import scratch_dir
from parcelrisk.sources.readers import read_delimited, read_table, read_zipped_delimited
from parcelrisk.sources.sinks import (
    register_directory, write_delimited, write_run, write_zipped_delimited,
)

ORDERS_CSV_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                     "o_totalprice double, o_orderdate date, o_orderpriority string")
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       o_orderpriority FROM orders""")
def q_csv_roundtrip(spark, sf):
    """Write orders as CSV with a header (one file per partition), read
    them back with an explicit schema."""
    o = t(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")) \
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority")
    path = scratch_dir(spark, "csv") + "/orders.csv"
    write_delimited(o, path)
    return read_delimited(spark, path, schema=ORDERS_CSV_SCHEMA)


@query("zip_scan", "SELECT * FROM customer")
def q_zip_scan(spark, sf):
    """Customers written as Latin-1 zipped CSV (one archive per
    partition), then read back by the zip source."""
    path = scratch_dir(spark, "zip")
    written = write_zipped_delimited(t(spark, sf, "customer"), path, encoding="ISO-8859-1")
    written.collect()                      # one row per archive
    return read_zipped_delimited(spark, path, CUSTOMER_SCHEMA, encoding="ISO-8859-1")


@query("register_tables", """
SELECT 'EXTR_Customer.csv' AS entry, 'customer' AS table_name, 'created' AS status,
       count(*) AS n_rows FROM customer
UNION ALL SELECT 'EXTR_Orders.csv', 'orders', 'created', count(*) FROM orders
UNION ALL SELECT 'EXTR_Nation.csv', 'nation', 'failed', 0
UNION ALL SELECT 'customer.csv', 'customer', 'clash', 0""")
def q_register_tables(spark, sf):
    """Extract-style files registered as one catalog table each in a fresh
    database, one of them broken and one of a name already taken: status and
    rows per entry."""
    base = scratch_dir(spark, "extracts")
    write_delimited(t(spark, sf, "customer"), f"{base}/files/EXTR_Customer.csv")
    write_delimited(t(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")),
                    f"{base}/files/EXTR_Orders.csv")
    # lacks columns of its schema, so it is reported and the others go on
    write_delimited(t(spark, sf, "nation").select(F.lit(1).alias("odd")), f"{base}/files/EXTR_Nation.csv")
    write_delimited(t(spark, sf, "customer").limit(1), f"{base}/files/customer.csv")
    db = f"pr_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    status = register_directory(
        spark, f"{base}/files", glob="*.csv", database=db,
        schema={"customer": CUSTOMER_SCHEMA, "orders": ORDERS_CSV_SCHEMA, "nation": "n_name string"})
    rows = status.collect()                                  # one row per entry
    counts = union_all([
        (spark.table(f"{db}.{r.table_name}") if r.status == "created" else spark.range(0))
        .agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(r.entry).alias("entry"), F.lit(r.table_name).alias("table_name"),
            F.lit(r.status.split(":")[0]).alias("status"), "n_rows") for r in rows])
    counts = counts.checkpoint()
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return counts


@query("run_stamped_write", _w(SCORED_SQL, "SELECT * FROM scored"))
def q_run_stamped_write(spark, sf):
    """Scores written below base/run_id=<yyyyMMdd-HHmmss>, read back."""
    base = scratch_dir(spark, "runs")
    stamp = spark.range(1).select(run_stamp()).first()[0]
    path = write_run(scored(spark, sf), base, run_id=stamp)
    return read_table(spark, path)


@query("area_rollup", _w(SCORED_SQL, """
SELECT l_suppkey, round(sum(score), 6) AS sum_score, count(*) AS n_rows,
       CAST(sum(label) AS BIGINT) AS n_pos FROM scored GROUP BY l_suppkey"""))
def q_area_rollup(spark, sf):
    """Expected number of events per area: sum of scores per group."""
    return scored(spark, sf).groupBy("l_suppkey").agg(
        F.round(F.sum("score"), 6).alias("sum_score"), F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").cast("bigint").alias("n_pos"))


@query("year_snapshot", """
WITH f AS (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year FROM orders
           GROUP BY o_custkey),
m AS (SELECT CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders)
SELECT o_custkey, CAST(unnest(generate_series(first_year, last_year)) AS INTEGER) AS year
FROM f, m""")
def q_year_snapshot(spark, sf):
    """One row per entity and year from its first year to the last year."""
    o = t(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    last = o.agg(F.max("y")).first()[0]          # one number
    first = o.groupBy("o_custkey").agg(F.min("y").alias("first_year"))
    return first.select("o_custkey",
                        F.explode(F.sequence(F.col("first_year"), F.lit(last))).alias("year"))


@query("label_refresh_stream", _w(LABELS_SQL, "SELECT c_custkey FROM labelled WHERE TARGET = 1"))
def q_label_refresh_stream(spark, sf):
    """Orders arriving as a file stream; customers that get a pending order
    are appended to a Parquet sink, each once; the sink is read back."""
    from parcelrisk.streaming import label_refresh_stream
    base = scratch_dir(spark, "stream")
    orders = t(spark, sf, "orders")
    q = label_refresh_stream(
        spark, sf, orders.schema, t(spark, sf, "customer"), pending, "address", "c_name",
        "c_custkey", f"{base}/sink", f"{base}/checkpoint", glob="orders.parquet")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink").select("c_custkey")


@query("label_refresh_bucketed", _w(LABELS_SQL, "SELECT c_custkey FROM labelled WHERE TARGET = 1"))
def q_label_refresh_bucketed(spark, sf):
    """The label refresh stream joined through a bucketed address index of
    the customers: each micro-batch shuffles only its new orders to the
    buckets, the index is read in place."""
    from parcelrisk.streaming import address_index, label_refresh_stream
    base = scratch_dir(spark, "stream-indexed")
    db = f"pr_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = address_index(t(spark, sf, "customer"), "c_name", "c_custkey", f"{db}.addresses", buckets)
    orders = t(spark, sf, "orders")
    q = label_refresh_stream(
        spark, sf, orders.schema, index, pending, "address", "c_name",
        "c_custkey", f"{base}/sink", f"{base}/checkpoint", glob="orders.parquet")
    q.awaitTermination()
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.read.parquet(f"{base}/sink").select("c_custkey")


@query("csv_reordered_header", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_csv_reordered_header(spark, sf):
    """A file whose columns stand in another order than the schema's and
    include one more: bound by header name."""
    path = scratch_dir(spark, "csv") + "/customer.csv"
    write_delimited(t(spark, sf, "customer").select("c_name", "c_nationkey", "c_acctbal", "c_custkey"), path)
    return read_delimited(spark, path, schema="c_custkey bigint, c_name string, c_acctbal double")


@query("csv_null_tokens", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders""")
def q_csv_null_tokens(spark, sf):
    """The usual texts for a missing value, in text and in number columns."""
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 4 == 0, "NA").when(k % 4 == 1, "#N/A N/A").otherwise(
            F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(k % 3 == 0, "<NA>").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    path = scratch_dir(spark, "csv") + "/orders.csv"
    write_delimited(o, path)
    return read_delimited(spark, path, schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string")


@query("csv_timestamps_by_position", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN epoch(o_orderdate) + 0.75 END AS seconds FROM orders""")
def q_csv_timestamps_by_position(spark, sf):
    """A date column given by position, with fractions of a second and some
    values that are no dates."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss'.75'")
    o = t(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 5 == 0, "unknown").otherwise(at).alias("at"))
    path = scratch_dir(spark, "csv") + "/orders.csv"
    write_delimited(o, path)
    back = read_delimited(spark, path, schema="o_orderkey bigint, at string", timestamp_cols=[1])
    return back.select("o_orderkey", epoch_seconds(F.col("at").cast("timestamp_ntz")).alias("seconds"))


@query("zip_latin1", """
SELECT c_custkey, c_name || chr(233) || chr(223) AS name,
       CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer""")
def q_zip_latin1(spark, sf):
    """Latin-1 text beyond ASCII through zipped CSV, columns in another order,
    written twice: the second write, in the table's own partitions, replaces
    the first, which has one more."""
    c = t(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"),
        F.concat("c_name", F.lit("\u00e9\u00df")).alias("name"), "c_custkey")
    path = scratch_dir(spark, "zip")
    more = c.rdd.getNumPartitions() + 1
    write_zipped_delimited(c.repartition(more), path, encoding="ISO-8859-1").collect()
    write_zipped_delimited(c, path, encoding="ISO-8859-1", mode="overwrite").collect()
    return read_zipped_delimited(spark, path, "c_custkey bigint, name string, segment string",
                                 encoding="ISO-8859-1")
