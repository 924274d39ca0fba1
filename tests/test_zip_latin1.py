from pathlib import Path

from parcelrisk.plans import catalog_io
from parcelrisk.plans.registry import QUERIES


def test_archives_follow_the_partitions_of_the_table(spark, tmp_path, monkeypatch):
    # six files, each read as one partition
    spark.range(600).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name",
                                "'BUILDING' AS c_mktsegment").repartition(6).write.parquet(
        f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(catalog_io, "scratch_dir", lambda spark, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = QUERIES["zip_latin1"](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    archives = list(Path(tmp_path, "zip").glob("*.zip"))
    # the second write is there alone: no archive of the first is left
    assert len(archives) >= 6 and len(rows) == 600
    assert {r.c_custkey: r.name for r in rows} == {k: f"Customer#{k}éß" for k in range(600)}
    assert sum(r.segment is None for r in rows) == 200
