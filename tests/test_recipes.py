"""The batch job on tables in the shape of the source extracts."""
from pyspark.sql import functions as F

from parcelrisk.plans import recipes


def gis_table(spark, n=60):
    c = F.col("id")
    cols = {
        "PIN": F.format_string("%06d%04d", c + 100, c), "MAJOR": c + 100, "MINOR": c,
        "SITETYPE": F.when(c % 2 == 0, "R1").otherwise("C1"),
        "ADDR_FULL": F.concat(c.cast("string"), F.lit(" MAIN ST")),
        "LAT": 47.6 + c / 1000, "LON": -122.3 - c / 1000,
        "KCTP_STATE": F.lit("WA"), "LOTSQFT": 4000.0 + c * 10, "LEVYCODE": (c % 3).cast("string"),
        "NEW_CONSTR": F.lit("N"), "TAXVAL_RSN": F.lit("A"),
        "APPRLNDVAL": 300000.0 + c * 1000, "APPR_IMPR": 100000.0 + (c % 7) * 20000,
        "TAX_LNDVAL": 300000.0, "TAX_IMPR": 100000.0,
        "QTS": F.when(c == 1, "  ").otherwise(F.lit("NW")), "SEC": F.lit("1"), "TWP": F.lit("25"),
        "RNG": F.lit("4"), "Shape_Length": 300.0, "Shape_Area": F.when(c == 2, 0.0).otherwise(5000.0),
        "PROPTYPE": F.lit("R"), "KCA_ZONING": F.when(c % 4 == 0, "SF5000").otherwise("LR2"),
        "KCA_ACRES": 0.1, "PREUSE_DESC": F.when(c % 5 == 0, None).otherwise("Single Family"),
        "CTYNAME": F.when(c == 3, "KENT").otherwise("SEATTLE"),
    }
    return spark.range(n).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in cols.items()])


def parcel_table(spark, n=60):
    c = F.col("id")
    cols = {"Major": c + 100, "Minor": c, "DistrictName": F.lit("SEATTLE"),
            "PropName": F.lit("x"), "Unbuildable": c % 9 == 0,
            "PcntUnusable": (c % 3).cast("double"), "WfntFootage": F.lit(0.0),
            "CurrentZoning": F.when(c % 2 == 0, "SF").otherwise("MR"),
            "Stream": F.when(c % 6 == 0, "Y").otherwise("N"),
            "OtherProblems": F.when(c % 5 == 0, "Y").otherwise("N"),
            "SqFtLot": 4000.0 + c, "LakeSammamish": (c % 4).cast("int"),
            "AirportNoise": (c % 2).cast("int"), "LevyCode": F.when(c % 10 != 0, (c % 3).cast("string"))}
    cols |= {n: F.lit("x") for n in recipes.ATTRIBUTE_DROPPED if n not in cols}
    cols |= {n: F.when(c % (3 + i % 5) == 0, "Y").otherwise("N")
             for i, n in enumerate(recipes.ATTRIBUTE_BINARY) if n not in cols}
    cols |= {n: (c % (1 + i % 6)).cast("string")
             for i, n in enumerate(recipes.ATTRIBUTE_CATEGORICAL) if n not in cols}
    return spark.range(n).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in cols.items()])


def permit_table(spark):
    rows = [("Residential", "Demolition", "Demolition", "Issued", f"{i} main st")
            for i in range(0, 60, 4)]
    rows.append(("Residential", "Demolition", "Demolition", "Closed", "5 MAIN ST"))
    return spark.createDataFrame(
        rows, "PermitClassMapped string, PermitTypeDesc string, PermitTypeMapped string, "
              "StatusCurrent string, OriginalAddress1 string") \
        .withColumn("OriginalCity", F.lit("SEATTLE")).withColumn("OriginalState", F.lit("WA")) \
        .withColumn("OriginalZip", F.lit("98109")).withColumn("Latitude", F.lit(47.6)) \
        .withColumn("Longitude", F.lit(-122.3))


def test_entity_table_filters_ratios_and_label(spark):
    pend = recipes.pending_permits(permit_table(spark))
    ent = recipes.entity_table(gis_table(spark), pend)
    rows = {r.MINOR: r for r in ent.collect()}
    assert 1 not in rows and 3 not in rows and len(rows) == 58
    assert rows[2].value_per_area is None
    assert rows[0].PREUSE_DESC == "NaN" and rows[0].TARGET == 1 and rows[5].TARGET == 0
    assert sum(r.TARGET for r in rows.values()) == 15


def test_score_entities_scores_each_pin_once(spark):
    pend = recipes.pending_permits(permit_table(spark))
    ent = recipes.entity_table(gis_table(spark), pend)
    att = recipes.attribute_table(parcel_table(spark))
    out = recipes.score_entities(ent, att, k=3, parallelism=2).collect()
    pins = [r.PIN for r in out]
    assert len(pins) == 58 and len(set(pins)) == 58
    assert all(0 <= r.prob1 <= 1 for r in out)
    assert set(out[0].asDict()) >= {"PIN", "MAJOR", "MINOR", "ADDR_FULL", "TARGET", "fold", "prob0", "prob1"}


def test_value_history_wide(spark):
    rows = [(335240, 1605, 2018, 100, 50, "REVALUE"), (335240, 1605, 2019, 120, 60, "REVALUE"),
            (335240, 1605, 2019, 1, 1, "NEW PARCEL"), (12, 3, 2019, 7, 0, "REVALUE")]
    df = spark.createDataFrame(rows, "Major long, Minor long, TaxYr int, LandVal long, "
                                     "ImpsVal long, Reason string")
    out = recipes.value_history_wide(df, reason="REVALUE", years=[2018, 2019]).collect()
    assert [tuple(r) for r in out] == [("0000120003", None, 7), ("3352401605", 150, 180)]


def test_score_entities_fit_on_training_folds(spark):
    pend = recipes.pending_permits(permit_table(spark))
    ent = recipes.entity_table(gis_table(spark), pend)
    att = recipes.attribute_table(parcel_table(spark))
    out = recipes.score_entities(ent, att, k=3, parallelism=2, fit_scope="train").collect()
    assert len({r.PIN for r in out}) == len(out) == 58


def test_full_column_sets_make_one_vector(spark):
    """Every documented column of both extracts, two of which differ only in case."""
    ent = recipes.entity_table(gis_table(spark), recipes.pending_permits(permit_table(spark)))
    att = recipes.attribute_table(parcel_table(spark))
    assert {"LEVYCODE"} <= set(ent.columns) and {"LevyCode", "SqFtLot"} <= set(att.columns)
    j = recipes.feature_table(ent, att)
    roles = recipes.feature_roles(j)
    assert "attr_SqFtLot" in roles.numeric and "attr_SqFtLot" not in roles.categorical
    assert {"KCA_ACRES", "attr_LakeSammamish", "attr_AirportNoise", "attr_Unbuildable"} <= set(roles.binary)
    assert {"LEVYCODE", "attr_LevyCode"} <= set(roles.categorical)
    out = recipes.labelled_features(ent, att, k=3)
    sizes = {len(r.all_features) for r in out.collect()}
    levels = sum(j.select(c).na.fill("NaN").distinct().count() - 1 for c in roles.categorical)
    assert sizes == {len(roles.numeric) + levels + len(roles.binary)}
