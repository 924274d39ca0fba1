"""The feature tables of the batch job over the given tables, and the exact
properties that scores have whatever the learner."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.operators import features as feat
from parcelrisk.operators.schema import ColumnRoles
from parcelrisk.plans import recipes
from parcelrisk.plans.catalog import FOLD_SQL, PENDING_SQL, _w, pending
from parcelrisk.plans.catalog_models import QUERIES_WITH_SCORES, customer_features
from parcelrisk.plans.registry import QUERIES, query, t

# Both engines read these expressions: customers in the shape of the parcel extracts.
_PIN = "lpad(concat('', c_custkey), 6, '0') || lpad(concat('', c_nationkey), 4, '0')"
GIS = {
    "PIN": _PIN, "MAJOR": "c_custkey", "MINOR": "c_nationkey",
    "SITETYPE": "CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END", "ADDR_FULL": "c_name",
    "LAT": "47e0 + c_nationkey / 1e2", "LON": "c_custkey / 1e3",
    "KCTP_STATE": "CASE WHEN c_custkey % 19 <> 0 THEN 'WA' END", "LOTSQFT": "c_custkey * 1e0",
    "LEVYCODE": "concat('', c_nationkey)", "NEW_CONSTR": "'N'", "TAXVAL_RSN": "'A'",
    "APPRLNDVAL": "CASE WHEN c_custkey % 7 = 0 THEN 0e0 ELSE c_acctbal END",
    "APPR_IMPR": "c_nationkey * 1e2", "TAX_LNDVAL": "c_acctbal", "TAX_IMPR": "1e0",
    "QTS": "CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE 'NW' END", "SEC": "'1'", "TWP": "'25'",
    "RNG": "'4'", "Shape_Length": "c_nationkey * 1e0",
    "Shape_Area": "CASE WHEN c_custkey % 13 = 0 THEN 0e0 ELSE c_custkey * 1e1 END",
    "PROPTYPE": "c_mktsegment", "KCA_ZONING": "concat('Z', c_nationkey % 4)",
    "KCA_ACRES": "c_custkey / 1e4",
    "PREUSE_DESC": "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END",
    "CTYNAME": "CASE WHEN c_nationkey % 5 = 0 THEN 'KENT' ELSE 'SEATTLE' END",
}
PARCELS = {
    "Major": "c_custkey", "Minor": "c_nationkey",
    "DistrictName": "CASE WHEN c_nationkey % 6 = 0 THEN 'KENT' ELSE 'SEATTLE' END",
    "PropName": "c_name", "Unbuildable": "c_custkey % 4 = 0", "PcntUnusable": "c_custkey % 100 * 1e0",
    "WfntFootage": "c_nationkey * 1e0", "SqFtLot": "c_custkey * 2e0",
    "LevyCode": "concat('L', c_nationkey % 3)", "CurrentZoning": "c_mktsegment",
    "Stream": "CASE WHEN c_custkey % 5 = 0 THEN 'Y' WHEN c_custkey % 5 = 1 THEN 'N' END",
    "LakeSammamish": "c_nationkey % 4",
}


def _select(columns: dict) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def gis(spark, sf) -> DataFrame:
    return t(spark, sf, "customer").selectExpr(*[f"{e} AS {c}" for c, e in GIS.items()])


def parcels(spark, sf) -> DataFrame:
    return t(spark, sf, "customer").selectExpr(*[f"{e} AS {c}" for c, e in PARCELS.items()])


def entities(spark, sf) -> DataFrame:
    e = recipes.entity_table(gis(spark, sf), pending(t(spark, sf, "orders")),
                             pending_address="address")
    return e.withColumns({c: F.round(c, 9) for c in RATIOS})


RATIOS = ("value_per_area", "improvement_over_land", "improvement_over_total")
ENTITY_SQL = PENDING_SQL + f""",
gis AS (SELECT {_select(GIS)} FROM customer),
keys AS (SELECT DISTINCT lower(address) AS k FROM pending),
entity AS (
  SELECT {", ".join("coalesce(PREUSE_DESC, 'NaN') AS PREUSE_DESC" if c == "PREUSE_DESC" else c
                    for c in recipes.ENTITY_COLUMNS)},
         round(APPRLNDVAL / nullif(Shape_Area, 0), 9) AS value_per_area,
         round(APPR_IMPR / nullif(APPRLNDVAL, 0), 9) AS improvement_over_land,
         round(APPR_IMPR / nullif(APPR_IMPR + APPRLNDVAL, 0), 9) AS improvement_over_total,
         CAST(k IS NOT NULL AS INTEGER) AS TARGET
  FROM gis LEFT JOIN keys ON lower(ADDR_FULL) = k
  WHERE CTYNAME = 'SEATTLE' AND QTS <> '  ' AND SITETYPE IS NOT NULL AND KCTP_STATE IS NOT NULL)"""
_DROPPED = {*recipes.ATTRIBUTE_DROPPED}
ATTRIBUTE_SQL = f"""
attribute AS (
  SELECT {", ".join({"Unbuildable": "CAST(coalesce(Unbuildable, false) AS INTEGER) AS Unbuildable",
                     "Stream": "CAST(coalesce(Stream = 'Y', false) AS INTEGER) AS Stream"}.get(c, c)
                    for c in PARCELS if c not in _DROPPED)}, {_PIN.replace("c_custkey", "Major")
                                                           .replace("c_nationkey", "Minor")} AS PIN
  FROM (SELECT {_select(PARCELS)} FROM customer) WHERE DistrictName = 'SEATTLE')"""


@query("entity_table", _w(ENTITY_SQL, "SELECT * FROM entity"))
def q_entity_table(spark, sf):
    """Customers in the shape of the parcel addresses, filtered and labelled."""
    return entities(spark, sf)


@query("attribute_table", "WITH " + ATTRIBUTE_SQL + " SELECT * FROM attribute")
def q_attribute_table(spark, sf):
    return recipes.attribute_table(parcels(spark, sf))


@query("feature_table", _w(ENTITY_SQL + "," + ATTRIBUTE_SQL, "SELECT entity.*, " + ", ".join(
    f"a.{c} AS attr_{c}" for c in PARCELS if c not in _DROPPED)
    + " FROM entity JOIN attribute a USING (PIN)"))
def q_feature_table(spark, sf):
    """Both sides joined; ``LEVYCODE`` and ``LevyCode`` differ only in case."""
    return recipes.feature_table(entities(spark, sf), recipes.attribute_table(parcels(spark, sf)))


# --------------------------------------------------- exact parts of the models

_NUM = ("c_acctbal", "n_orders", "avg_price", "max_price", "acct_over_spend")


@query("features_scaled", """
WITH o AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS a, max(o_totalprice) AS m,
                  sum(o_totalprice) AS s FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nat, c_acctbal,
             coalesce(n, 0)::DOUBLE AS n_orders, coalesce(a, 0) AS avg_price,
             coalesce(m, 0) AS max_price, coalesce(c_acctbal / nullif(s, 0), 0) AS acct_over_spend
      FROM customer LEFT JOIN o ON c_custkey = o_custkey),
d AS (SELECT """ + ", ".join(f"stddev_samp({x}) AS {x}" for x in _NUM) + """ FROM c),
seg AS (SELECT seg, row_number() OVER (ORDER BY count(*) DESC, seg) AS i, count(*) OVER () AS n
        FROM c GROUP BY seg),
nat AS (SELECT nat, row_number() OVER (ORDER BY count(*) DESC, nat) AS i, count(*) OVER () AS n
        FROM c GROUP BY nat)
SELECT c_custkey, """ + ", ".join(f"round(c.{x} / d.{x}, 6) AS {x}" for x in _NUM) + """,
       list_transform(range(1, seg.n), lambda k: CAST(k = seg.i AS INTEGER)) AS segment,
       list_transform(range(1, nat.n), lambda k: CAST(k = nat.i AS INTEGER)) AS nation
FROM c JOIN seg USING (seg) JOIN nat USING (nat), d""")
def q_features_scaled(spark, sf):
    """The feature vector taken apart: numerics over their standard deviation,
    one slot per level but the rarest."""
    v = customer_features(spark, sf).select("c_custkey", vector_to_array("features").alias("v"))
    n_seg = t(spark, sf, "customer").select("c_mktsegment").distinct().count() - 1
    first = len(_NUM)
    return v.select(
        "c_custkey", *[F.round(F.get("v", F.lit(i)), 6).alias(x) for i, x in enumerate(_NUM)],
        F.slice("v", first + 1, n_seg).cast("array<int>").alias("segment"),
        F.slice("v", F.lit(first + n_seg + 1), F.greatest(F.size("v") - first - n_seg, F.lit(0)))
        .cast("array<int>").alias("nation"))


def _score_faults(name: str):
    """Per group: rows, different keys, and rows that break what every score keeps."""
    spec = QUERIES_WITH_SCORES[name]

    def run(spark, sf):
        s = QUERIES[name](spark, sf)
        group = spec["group"]
        bad = (F.abs(F.col("prob0") + F.col("prob1") - 1) > 1e-9) | (F.col("prob0") < 0) \
            | (F.col("prob1") < 0)
        top = F.when(F.col("prob1") > F.col("prob0"), 1.0).when(F.col("prob1") < F.col("prob0"), 0.0)
        return s.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*spec["key"]).alias("n_keys"),
            F.count_if(F.coalesce(bad, F.lit(True))).alias("n_bad_sums"),
            F.count_if(F.coalesce(top != F.col("prediction"), F.lit(False))).alias("n_bad_predictions"))
    return run


for _name, _spec in QUERIES_WITH_SCORES.items():
    query(f"{_name}_contract", _spec["sql"])(_score_faults(_name))


@query("logistic_equations", "SELECT 0 AS n_unbalanced, (SELECT count(*) FROM customer) AS n_rows")
def q_logistic_equations(spark, sf):
    """Score equations of an unregularised logistic fit: over the training
    rows sum((label - p) * x) is zero for every feature and the constant."""
    c = t(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("a"),
        (F.col("c_nationkey") % 5).cast("double").alias("b"),
        ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 3 == 0).cast("int").alias("y"))
    roles = ColumnRoles(key="c_custkey", numeric=("a", "b"), label="y")
    lr = LogisticRegression(featuresCol="features", labelCol="y", tol=1e-12, maxIter=200)
    p = feat.prepare(c, roles)
    s = Pipeline(stages=[*feat.feature_pipeline(roles, scale=False).getStages(), lr]).fit(p) \
        .transform(p).select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("p"), "a", "b")
    r = F.col("y") - F.col("p")
    sums = s.agg(F.count(F.lit(1)).alias("n_rows"), *[
        (F.abs(F.sum(r * x)) / F.count(F.lit(1)) > 1e-6).cast("int").alias(f"u{i}")
        for i, x in enumerate((F.lit(1.0), F.col("a"), F.col("b")))])
    return sums.select((F.col("u0") + F.col("u1") + F.col("u2")).alias("n_unbalanced"), "n_rows")
