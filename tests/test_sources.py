import zipfile

import pytest
from pyspark.sql import functions as F

from parcelrisk.plans import recipes
from parcelrisk.session import scratch_dir
from parcelrisk.sources import (
    read_delimited, read_directory, read_zipped_delimited, register_directory, write_delimited, write_zipped_delimited,
)


def test_csv_null_tokens_latin1_and_timestamps(spark, tmp_path):
    p = tmp_path / "permits.csv"
    p.write_bytes("id,name,when\n1,Caf\xe9,2019-01-02\n2,NA,not a date\n".encode("latin-1"))
    df = read_delimited(spark, str(p), schema="id int, name string, when string",
                        encoding="ISO-8859-1", null_tokens=["NA"], timestamp_cols=[2])
    rows = sorted(df.collect())
    assert rows[0].name == "Caf\xe9" and rows[0].when.year == 2019
    assert rows[1].name is None and rows[1].when is None


def test_zip_source_respects_quotes(spark, tmp_path):
    d = tmp_path / "zips"
    d.mkdir()
    with zipfile.ZipFile(d / "a.zip", "w") as zf:
        zf.writestr("a.csv", 'id,txt\n1,"x, y"\n2,"multi\nline"\n')
    df = read_zipped_delimited(spark, str(d), "id int, txt string")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x, y"), (2, "multi\nline")]


def test_register_directory_fails_then_reports(spark):
    base = scratch_dir(spark, "reg")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    write_delimited(df, f"{base}/EXTR_Thing.csv")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS regtest LOCATION '{base}/db'")
    first = register_directory(spark, base, database="regtest", infer=True).collect()
    second = register_directory(spark, base, database="regtest", infer=True).collect()
    assert [tuple(r) for r in first] == [("EXTR_Thing.csv", "thing", "created")]
    assert [tuple(r) for r in second] == [("EXTR_Thing.csv", "thing", "exists")]
    assert set(read_directory(spark, base)) == {"thing"}


def test_pending_permits_recipe(spark):
    cols = "PermitClassMapped string, PermitTypeDesc string, PermitTypeMapped string, " \
           "StatusCurrent string, OriginalAddress1 string, OriginalCity string, " \
           "OriginalState string, OriginalZip string, Latitude double, Longitude double"
    rows = [("Residential", "Demolition", "Demolition", s, a, "SEATTLE", "WA", "98101", 0.0, 0.0)
            for s, a in [("Closed", "1 A"), ("Completed", "2 A"), ("Issued", "3 A"), (None, "4 A"),
                         ("Issued", None)]]
    rows.append(("Residential", "New", "Demolition", "Issued", "5 A", "SEATTLE", "WA", "1", 0.0, 0.0))
    rows.append(("Commercial", "Demolition", "Demolition", "Issued", "6 A", "SEATTLE", "WA", "1", 0.0, 0.0))
    out = recipes.pending_permits(spark.createDataFrame(rows, cols))
    assert sorted(r.OriginalAddress1 for r in out.collect()) == ["3 A", "4 A", "5 A"]


def test_attribute_table_flags_twice_listed_stay(spark):
    names = ["Major", "Minor", "DistrictName", "Unbuildable", "OtherProblems", "WfntProximityInfluence"]
    df = spark.createDataFrame([(335240, 1605, "SEATTLE", True, "Y", "Y"),
                                (12, 3, "SEATTLE", None, "N", None),
                                (1, 1, "KENT", False, "Y", "Y")],
                               "Major long, Minor long, DistrictName string, Unbuildable boolean, "
                               "OtherProblems string, WfntProximityInfluence string")
    out = {r.PIN: r for r in recipes.attribute_table(df).collect()}
    assert set(out) == {"3352401605", "0000120003"}
    assert out["3352401605"].OtherProblems == 1 and out["3352401605"].WfntProximityInfluence == 1
    assert out["0000120003"].Unbuildable == 0 and out["0000120003"].OtherProblems == 0
    assert "Major" not in recipes.attribute_table(df).columns and names


def test_register_schema_only(spark):
    base = scratch_dir(spark, "reg-schema")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    write_delimited(df, f"{base}/EXTR_Empty.csv")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS regempty LOCATION '{base}/db'")
    st = register_directory(spark, base, database="regempty", schema="k int, v string",
                            schema_only=True).collect()
    assert [tuple(r) for r in st] == [("EXTR_Empty.csv", "empty", "created")]
    t = spark.table("regempty.empty")
    assert t.count() == 0 and t.dtypes == [("k", "int"), ("v", "string")]


def test_columns_are_bound_by_header_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a,c\nx,1,9\n")
    got = read_delimited(spark, str(tmp_path / "x.csv"), schema="a int, b string").collect()
    assert [tuple(r) for r in got] == [(1, "x")]
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "x.csv"), schema="a int, zz string")
    (tmp_path / "y.csv").write_text("a,b\n1,x\nnope,y\n")
    with pytest.raises(Exception):
        read_delimited(spark, str(tmp_path / "y.csv"), schema="a int, b string").collect()
    loose = read_delimited(spark, str(tmp_path / "y.csv"), schema="a int, b string", strict=False)
    assert sorted(tuple(r) for r in loose.collect() if r.a is None) == [(None, "y")]


def test_zip_members_pattern_names_and_modes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        zf.writestr("readme.txt", "this, is\nno table")
        zf.writestr("d/a.csv", "txt,id,more\nx,1,q\n")
    got = read_zipped_delimited(spark, str(tmp_path), "id int, txt string").collect()
    assert [tuple(r) for r in got] == [(1, "x")]
    with pytest.raises(Exception):
        read_zipped_delimited(spark, str(tmp_path), "id int, zz string").collect()
    out = f"{tmp_path}/out"
    df = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(40)], "k int, v string")
    write_zipped_delimited(df.repartition(4), out).collect()
    with pytest.raises(FileExistsError):
        write_zipped_delimited(df, out)
    write_zipped_delimited(df.limit(10).coalesce(1), out, mode="overwrite").collect()
    assert read_zipped_delimited(spark, out, "k int, v string").count() == 10
