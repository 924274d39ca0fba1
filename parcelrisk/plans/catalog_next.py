"""What the method names as next steps: areas of events, stored scores against
later events, neighbours of many locations, value history by reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelrisk.operators import evaluate, grid, match
from parcelrisk.operators.reshape import unpivot_years
from parcelrisk.plans.catalog import PENDING_SQL, _w, pending
from parcelrisk.plans.recipes import value_history_wide
from parcelrisk.plans.registry import query, t


@query("event_area", _w(PENDING_SQL, """
SELECT o_orderkey, c_nationkey AS area FROM pending
LEFT JOIN (SELECT lower(c_name) AS k, min(c_nationkey) AS c_nationkey FROM customer GROUP BY 1)
  ON lower(address) = k"""))
def q_event_area(spark, sf):
    """Pending events with the area id of the entity at their address."""
    return match.attach(pending(t(spark, sf, "orders")), t(spark, sf, "customer"), "address",
                        "c_name", "c_nationkey", out="area").select("o_orderkey", "area")


_SCORED_AT = "1998-01-01 00:00:00"


@query("later_events", _w(PENDING_SQL, f"""
, last AS (SELECT lower(address) AS k, max(o_orderdate) AS d FROM pending JOIN orders USING (o_orderkey)
           GROUP BY 1),
s AS (SELECT floor(c_acctbal / 100) AS score, CAST(coalesce(d > TIMESTAMP '{_SCORED_AT}', false) AS BIGINT) AS y
      FROM customer LEFT JOIN last ON lower(c_name) = k),
c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tps FROM c)
SELECT CAST(sum(pos) AS BIGINT) AS n_later, CAST(sum(pos + neg) AS BIGINT) AS n_scored,
       round(sum(neg * (2 * tps - pos)) / (2.0 * sum(pos) * sum(neg)), 9) AS auc FROM r"""))
def q_later_events(spark, sf):
    """Scores of a past day, judged by the pending events that came after it."""
    from parcelrisk.session import scratch_dir
    from parcelrisk.sources.readers import read_table
    from parcelrisk.sources.sinks import write_run
    scores = t(spark, sf, "customer").select(
        "c_name", F.floor(F.col("c_acctbal") / 100).cast("double").alias("score"),
        F.lit(_SCORED_AT).cast("timestamp_ntz").alias("scored_at"))
    stored = read_table(spark, write_run(scores, scratch_dir(spark, "scores"), run_id="19980101-000000"))
    o = t(spark, sf, "orders")
    events = pending(o).select("o_orderkey", "address").join(o.select("o_orderkey", "o_orderdate"), "o_orderkey")
    s = match.later_outcome(stored, events, "c_name", "address", "scored_at", "o_orderdate")
    n = s.agg(F.sum("outcome").cast("bigint").alias("n_later"), F.count(F.lit(1)).alias("n_scored")).first()
    return evaluate.auc(s, "score", "outcome").select(        # two numbers beside one
        F.lit(n.n_later).alias("n_later"), F.lit(n.n_scored).alias("n_scored"),
        F.round("auc", 9).alias("auc"))


@query("neighbours_of_set", """
WITH p AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 100.0::DOUBLE AS y FROM customer)
SELECT a.c_custkey AS point, b.c_custkey AS neighbour,
       round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS distance
FROM p a JOIN p b ON (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 250.0 * 250.0
WHERE a.c_custkey % 100 = 0""")
def q_neighbours_of_set(spark, sf):
    """All customers near each customer whose key is divisible by 100."""
    p = t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"),
                                        (F.col("c_nationkey") * 100.0).alias("y"))
    n = grid.neighbours_of(p.where("c_custkey % 100 = 0"), p, "x", "y", 250.0, "c_custkey", "c_custkey")
    return n.withColumn("distance", F.round("distance", 6))


@query("nearest_customers", """
WITH p AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 100.0::DOUBLE AS y FROM customer),
d AS (SELECT a.c_custkey AS point, b.c_custkey AS neighbour,
             sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance
      FROM p a JOIN p b ON a.c_custkey <> b.c_custkey WHERE a.c_custkey % 100 = 0)
SELECT point, neighbour, round(distance, 6) AS distance,
       CAST(row_number() OVER (PARTITION BY point ORDER BY distance, neighbour) AS INTEGER) AS rank
FROM d QUALIFY row_number() OVER (PARTITION BY point ORDER BY distance, neighbour) <= 5""")
def q_nearest_customers(spark, sf):
    """The five customers nearest to each customer whose key is divisible by 100."""
    p = t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"),
                                        (F.col("c_nationkey") * 100.0).alias("y"))
    n = grid.nearest_k(p.where("c_custkey % 100 = 0"), p, "x", "y", 5, "c_custkey", "c_custkey", exclude_self=True)
    return n.withColumn("distance", F.round("distance", 6))


@query("value_history_reason", """
SELECT lpad(concat('', o_custkey), 6, '0') || lpad(concat('', o_orderkey % 10), 4, '0') AS "PIN",
       CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(sum(CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 1000) AS BIGINT) AS total
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL""")
def q_value_history_reason(spark, sf):
    """Total value by year, of one reason only: the wide table, year by year."""
    v = t(spark, sf, "orders").select(
        F.col("o_custkey").alias("Major"), (F.col("o_orderkey") % 10).alias("Minor"),
        F.year("o_orderdate").alias("TaxYr"), F.floor("o_totalprice").alias("LandVal"),
        (F.col("o_orderkey") % 1000).alias("ImpsVal"), F.col("o_orderpriority").alias("Reason"))
    return unpivot_years(value_history_wide(v, reason="1-URGENT"), "PIN", "total")
