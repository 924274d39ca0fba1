from sf_paths import SF_SMALL

from parcelrisk.plans.catalog import pending
from parcelrisk.session import scratch_dir
from parcelrisk.streaming import label_refresh_stream


def test_label_refresh_is_incremental_and_idempotent(spark):
    base = scratch_dir(spark, "stream-test")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    customers = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    # two arrivals of new event files
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{base}/in/a")
    args = (spark, f"{base}/in", orders.schema, customers, pending, "address", "c_name",
            "c_custkey", f"{base}/sink", f"{base}/ckpt")
    label_refresh_stream(*args).awaitTermination()
    first = spark.read.parquet(f"{base}/sink").count()
    orders.where("o_orderkey % 2 = 1").write.parquet(f"{base}/in/b")
    label_refresh_stream(*args).awaitTermination()
    label_refresh_stream(*args).awaitTermination()     # nothing new: no new rows
    keys = [r.c_custkey for r in spark.read.parquet(f"{base}/sink").collect()]
    from parcelrisk.plans.catalog import labels
    want = {r.c_custkey for r in labels(spark, SF_SMALL).where("TARGET = 1").collect()}
    assert len(keys) == len(set(keys)) == len(want) and set(keys) == want and first <= len(want)


def _ancestors(lines, i):
    """Plan lines above line ``i`` that are its ancestors (less indented)."""
    depth = len(lines[i]) - len(lines[i].lstrip(" :|+-"))
    for line in reversed(lines[:i]):
        d = len(line) - len(line.lstrip(" :|+-"))
        if d < depth:
            depth = d
            yield line


def test_bucketed_index_joins_without_shuffling_the_entities(spark):
    import uuid

    from parcelrisk.streaming import address_index, new_positives
    base = scratch_dir(spark, "index-test")
    db = f"pr_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    customers = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = address_index(customers, "c_name", "c_custkey", f"{db}.addr", buckets)
    args = (pending, "address", "c_name", "c_custkey")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # a large entity table
    try:
        out = new_positives(orders, index, *args)
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        i = next(k for k, line in enumerate(lines) if "Bucketed: true" in line)
        path = []
        for line in _ancestors(lines, i):
            if "SortMergeJoin" in line:
                break
            path.append(line)
        else:
            raise AssertionError("the bucketed scan does not feed a sort-merge join")
        # the bucketed scan feeds the join directly: no exchange between them
        assert not any("Exchange" in line for line in path), path
        plain = new_positives(orders, customers, *args)
        assert out.count() == plain.count() and out.exceptAll(plain).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
