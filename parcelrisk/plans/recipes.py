"""End-to-end recipes: pending events, entity and attribute tables, the
labelled feature table, out-of-fold scoring and its evaluation.

Every recipe takes DataFrames and column names; the defaults are the column
names of the public-record parcel, permit and assessment extracts the
pipeline was designed for, so the same code runs on any table that plays
the same role.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.functions.scalars import (
    bool_to_int, composite_key, not_blank, not_in_keep_null, safe_ratio,
)
from parcelrisk.operators.clean import fill_null, flag_columns
from parcelrisk.operators.folds import assign_folds
from parcelrisk.operators.match import flag_membership
from pyspark.ml import Pipeline

from parcelrisk.operators.model import default_forest, oof_score
from parcelrisk.operators.features import prepare, build_features, feature_pipeline
from parcelrisk.operators.schema import ColumnRoles

# ---------------------------------------------------------------------------
# Column names and codes of the source extracts.  They must be
# spelled exactly as in the files for the recipes to find their columns.
# ---------------------------------------------------------------------------
PERMIT_COLUMNS = ["OriginalAddress1", "OriginalCity", "OriginalState", "OriginalZip",
                  "Latitude", "Longitude"]
PERMIT_CLASS = ("PermitClassMapped", "Residential")
PERMIT_TYPE_COLUMNS = ["PermitTypeDesc", "PermitTypeMapped"]
PERMIT_TYPE_VALUE = "Demolition"
PERMIT_STATUS = ("StatusCurrent", ["Closed", "Completed"])

ENTITY_COLUMNS = ["PIN", "MAJOR", "MINOR", "SITETYPE", "ADDR_FULL", "LAT", "LON",
                  "KCTP_STATE", "LOTSQFT", "LEVYCODE", "NEW_CONSTR", "TAXVAL_RSN", "APPRLNDVAL",
                  "APPR_IMPR", "TAX_LNDVAL", "TAX_IMPR", "QTS", "SEC", "TWP", "RNG",
                  "Shape_Length", "Shape_Area", "PROPTYPE", "KCA_ZONING",
                  "KCA_ACRES", "PREUSE_DESC"]
ENTITY_NUMERIC = ["LAT", "LON", "LOTSQFT", "APPRLNDVAL", "APPR_IMPR", "TAX_LNDVAL", "TAX_IMPR",
                  "Shape_Length", "Shape_Area", "value_per_area", "improvement_over_land"]
ENTITY_CATEGORICAL = ["KCTP_STATE", "SITETYPE", "LEVYCODE", "NEW_CONSTR", "TAXVAL_RSN", "QTS",
                      "SEC", "TWP", "RNG", "KCA_ZONING", "PROPTYPE", "PREUSE_DESC"]
ENTITY_UNSCALED = ["KCA_ACRES"]
ENTITY_IDENTITY = ["MAJOR", "MINOR", "ADDR_FULL"]

ATTRIBUTE_DROPPED = ["Major", "Minor", "PropName", "PlatName", "PlatLot", "PlatBlock", "PropType",
                     "SpecArea", "SpecSubArea", "HBUAsIfVacant", "HBUAsImproved",
                     "RestrictiveSzShape", "DNRLease", "TranspConcurrency", "DistrictName",
                     "LandfillBuffer"]
ATTRIBUTE_BINARY = ["AdjacentGolfFairway", "AdjacentGreenbelt", "HistoricSite",
                    "CurrentUseDesignation", "NativeGrowthProtEsmt", "Easements",
                    "OtherDesignation", "DeedRestrictions", "DevelopmentRightsPurch",
                    "CoalMineHazard", "CriticalDrainage", "ErosionHazard",
                    "HundredYrFloodPlain", "SeismicHazard", "LandslideHazard",
                    "SteepSlopeHazard", "Stream", "Wetland", "SpeciesOfConcern",
                    "SensitiveAreaTract", "WaterProblems", "OtherProblems",
                    "WfntProximityInfluence", "PowerLines", "OtherNuisances"]
ATTRIBUTE_NUMERIC = ["PcntUnusable", "WfntFootage", "SqFtLot"]
ATTRIBUTE_CATEGORICAL = ["Range", "Township", "Section", "QuarterSection", "Area", "SubArea",
                         "LevyCode", "CurrentZoning", "PresentUse", "WaterSystem",
                         "SewerSystem", "Access", "Topography", "StreetSurface",
                         "InadequateParking", "MtRainier", "Olympics", "Cascades", "Territorial",
                         "SeattleSkyline", "PugetSound", "LakeWashington", "SmallLakeRiverCreek",
                         "OtherView", "WfntLocation", "WfntBank", "WfntPoorQuality",
                         "WfntRestrictedAccess", "WfntAccessRights", "TidelandShoreland",
                         "LotDepthFactor", "TrafficNoise", "NbrBldgSites", "Contamination"]
CITY = "SEATTLE"
BLANK_QTS = "  "
PIN_WIDTHS = (6, 4)
# ---------------------------------------------------------------------------


def pending_permits(permits: DataFrame,
                    class_col: str = PERMIT_CLASS[0], class_value: str = PERMIT_CLASS[1],
                    type_cols: Sequence[str] = tuple(PERMIT_TYPE_COLUMNS),
                    type_value: str = PERMIT_TYPE_VALUE,
                    status_col: str = PERMIT_STATUS[0],
                    closed_values: Sequence[str] = tuple(PERMIT_STATUS[1]),
                    address_col: str = PERMIT_COLUMNS[0],
                    keep: Sequence[str] = tuple(PERMIT_COLUMNS)) -> DataFrame:
    """Open events of one class and type with an address: class equals
    ``class_value``; any of ``type_cols`` equals ``type_value``; status is
    none of ``closed_values`` (an unknown status is kept); address known."""
    type_ok = F.lit(False)
    for c in type_cols:
        type_ok = type_ok | F.coalesce(F.col(c) == F.lit(type_value), F.lit(False))
    return permits.where(
        (F.col(class_col) == F.lit(class_value)) & type_ok
        & not_in_keep_null(status_col, closed_values)
        & F.col(address_col).isNotNull()).select(*keep)


def entity_table(gis: DataFrame, pending: DataFrame, city: str = CITY,
                 address_col: str = "ADDR_FULL", pending_address: str = PERMIT_COLUMNS[0],
                 label: str = "TARGET") -> DataFrame:
    """Entities of one city with a usable section code and known site type
    and state; the three value ratios; the label = address among the
    pending events (case-insensitive)."""
    g = gis.where((F.col("CTYNAME") == F.lit(city)) & not_blank("QTS", BLANK_QTS)
                  & F.col("SITETYPE").isNotNull() & F.col("KCTP_STATE").isNotNull())
    g = fill_null(g, {"PREUSE_DESC": "NaN"}).select(*ENTITY_COLUMNS)
    g = g.withColumns({
        "value_per_area": safe_ratio("APPRLNDVAL", "Shape_Area"),
        "improvement_over_land": safe_ratio("APPR_IMPR", "APPRLNDVAL"),
        "improvement_over_total": safe_ratio(F.col("APPR_IMPR"),
                                             F.col("APPR_IMPR") + F.col("APPRLNDVAL")),
    })
    return flag_membership(g, pending, address_col, pending_address, out=label)


def attribute_table(parcels: DataFrame, city: str = CITY) -> DataFrame:
    """Attributes keyed by the zero-padded composite PIN, one district,
    administrative columns dropped, flags as 0/1."""
    p = parcels.withColumn("PIN", composite_key(["Major", "Minor"], PIN_WIDTHS)) \
        .where(F.col("DistrictName") == F.lit(city))
    p = p.drop(*ATTRIBUTE_DROPPED)
    if "Unbuildable" in p.columns:
        p = p.withColumn("Unbuildable", bool_to_int("Unbuildable"))
    return flag_columns(p, [c for c in ATTRIBUTE_BINARY if c in p.columns])


ATTRIBUTE_PREFIX = "attr_"      # some attribute names differ from entity names only in case


def feature_table(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """Entities with their attributes, joined on PIN; attribute columns carry
    ``ATTRIBUTE_PREFIX``."""
    e = entities.withColumn("PIN", F.col("PIN").cast("string"))
    a = attributes.select(
        F.col("PIN").cast("string").alias("PIN"),
        *[F.col(c).alias(ATTRIBUTE_PREFIX + c) for c in attributes.columns if c != "PIN"])
    return e.join(a, on="PIN", how="inner")


def feature_roles(table: DataFrame) -> ColumnRoles:
    """The roles of the columns of ``feature_table``.  Attribute columns
    without a role of their own that hold numbers enter the vector unscaled,
    like the flags."""
    def attr(names):
        return [ATTRIBUTE_PREFIX + c for c in names]

    def there(names):
        return tuple(c for c in names if c in table.columns)

    numeric = there(ENTITY_NUMERIC + ["improvement_over_total"] + attr(ATTRIBUTE_NUMERIC))
    categorical = there(ENTITY_CATEGORICAL + attr(ATTRIBUTE_CATEGORICAL))
    flags = there(attr(ATTRIBUTE_BINARY + ["Unbuildable"]))
    kinds = dict(table.dtypes)
    rest = [c for c in table.columns if c.startswith(ATTRIBUTE_PREFIX)
            and c not in {*numeric, *categorical, *flags}
            and kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float",
                                           "double", "decimal", "boolean")]
    return ColumnRoles(
        key="PIN", identity=tuple(ENTITY_IDENTITY), label="TARGET", fold="fold",
        numeric=numeric, categorical=categorical,
        binary=(*there(ENTITY_UNSCALED), *flags, *rest))


def _joined(entities: DataFrame, attributes: DataFrame) -> tuple[DataFrame, ColumnRoles]:
    j = feature_table(entities, attributes)
    return j, feature_roles(j)


def labelled_features(entities: DataFrame, attributes: DataFrame, k: int = 10, seed: int = 0,
                      keep_raw: bool = False, fill_numeric: float = 0.0) -> DataFrame:
    """Entity and attribute feature blocks joined on PIN into one vector
    ``all_features``, with the label and a hash fold per PIN."""
    j, roles = _joined(entities, attributes)
    j = assign_folds(j, "PIN", k, seed)
    feats, _ = build_features(j, roles, out="all_features", keep_raw=keep_raw,
                              fill_numeric=fill_numeric)
    return feats


def score_entities(entities: DataFrame, attributes: DataFrame, k: int = 10, seed: int = 0,
                   parallelism: int | None = None, fit_scope: str = "all",
                   fill_numeric: float = 0.0) -> DataFrame:
    """The batch job: label, features, k-fold out-of-fold random forest.
    Returns PIN, MAJOR, MINOR, ADDR_FULL, TARGET, fold, prediction, prob0,
    prob1 -- every entity exactly once.

    ``fit_scope='all'`` fits the scaler and indexers on every row (the
    original method); ``'train'`` fits them inside each fold on the
    training folds only, so the held-out fold never shapes its features."""
    keep = ["PIN", *ENTITY_IDENTITY]
    if fit_scope == "all":
        data = labelled_features(entities, attributes, k, seed, fill_numeric=fill_numeric)
        return oof_score(data, "all_features", "TARGET", "fold", k,
                         keep=keep, parallelism=parallelism, seed=seed)
    if fit_scope != "train":
        raise ValueError("fit_scope must be 'all' or 'train'")
    j, roles = _joined(entities, attributes)
    j = assign_folds(j, "PIN", k, seed)
    named = [roles.key, *roles.identity, *roles.numeric, *roles.categorical, *roles.binary,
             roles.label, roles.fold]
    prepared = prepare(j.select(*dict.fromkeys(named)), roles, fill_numeric)
    stages = feature_pipeline(roles, out="all_features", handle_invalid="keep").getStages()
    pipe = Pipeline(stages=[*stages, default_forest("all_features", "TARGET", seed)])
    return oof_score(prepared, "all_features", "TARGET", "fold", k, estimator=pipe,
                     keep=keep, parallelism=parallelism, seed=seed)


# Value-history extract columns.
VALUE_KEY = ("Major", "Minor")
VALUE_YEAR = "TaxYr"
VALUE_PARTS = ("LandVal", "ImpsVal")
VALUE_REASON = "Reason"


def value_history_wide(values: DataFrame, reason: str | None = None, agg: str = "sum",
                       years: Sequence[int] | None = None, round_to: int | None = None) -> DataFrame:
    """Value history keyed by PIN, one column per tax year holding the
    total value (land + improvements), optionally only rows of one
    ``reason`` (e.g. revaluations).  Pass ``years`` to skip the job that
    finds them."""
    from parcelrisk.operators.reshape import pivot_by
    v = values.withColumn("PIN", composite_key(list(VALUE_KEY), PIN_WIDTHS)) \
        .withColumn("TotalVal", F.col(VALUE_PARTS[0]) + F.col(VALUE_PARTS[1]))
    if reason is not None:
        v = v.where(F.col(VALUE_REASON) == F.lit(reason))
    return pivot_by(v, "PIN", VALUE_YEAR, "TotalVal", agg, years, round_to).orderBy("PIN")


def units_table(spark, path: str, schema=None, **opts) -> DataFrame:
    """Unit breakdown extract as it is (plain or zipped CSV)."""
    from parcelrisk.sources.readers import read_delimited, read_zipped_delimited
    if path.endswith(".zip"):
        return read_zipped_delimited(spark, path, schema, **opts)
    return read_delimited(spark, path, schema=schema, **opts)


def residential_buildings(spark, path: str, schema=None, **opts) -> DataFrame:
    """Residential building extract as it is; the path argument is used."""
    from parcelrisk.sources.readers import read_delimited
    return read_delimited(spark, path, schema=schema, **opts)
