import bisect
import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from parcelrisk.operators.asof import asof_join, yearly_state
from parcelrisk.session import scratch_dir
from parcelrisk.sources.sinks import write_partitions
from parcelrisk.streaming import label_state
from parcelrisk.streaming import compact_labels, label_withdrawal_stream, labelled_addresses, labelled_entities

RECORD = "permit long, address string, status string, at timestamp_ntz"
DAY = dt.datetime(2020, 1, 1)


class Permits:
    """Arrivals of permit records, and the log that the stream makes of them."""

    def __init__(self, spark):
        self.spark, self.base, self.n, self.last = spark, scratch_dir(spark, "withdrawal-test"), 0, None

    def arrive(self, *rows):
        rows = [(k, a, s, None if d is None else DAY + dt.timedelta(days=d)) for k, a, s, d in rows]
        self.spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(f"{self.base}/in/{self.n:03d}")
        self.n += 1
        return self.run()

    def run(self):
        q = label_withdrawal_stream(self.spark, f"{self.base}/in", RECORD, "permit", "address", "at",
                                    F.col("status") != "Closed", f"{self.base}/log", f"{self.base}/ckpt",
                                    late_by="2 days")
        q.awaitTermination()
        self.last = (q.lastProgress or {"batchId": self.last})["batchId"]
        return {r["address"]: r["open_events"] for r in labelled_addresses(self.spark, f"{self.base}/log").collect()}

    def states(self):
        s = self.spark.read.format("statestore").load(f"{self.base}/ckpt")
        return {r["key"]["key"] for r in s.collect()}


def test_labels_are_given_and_withdrawn(spark):
    p = Permits(spark)
    assert p.arrive((1, "A St", "Issued", 0), (2, "a st", "Issued", 0), (3, "B St", "Closed", 0),
                    (4, None, "Issued", 0), (None, "C St", "Issued", 0), (5, "D St", "Issued", None)) == {"a st": 2}
    assert p.arrive((1, "A St", "Closed", 3)) == {"a st": 1}
    assert p.arrive((2, "A St", "Closed", 4), (6, "E St", "Issued", 4)) == {"e st": 1}
    # an older record changes nothing; a newer one opens it again; one of the same time that closes, closes
    assert p.arrive((2, "A St", "Issued", 3.5), (1, "A St", "Issued", 5)) == {"a st": 1, "e st": 1}
    assert p.arrive((1, "A St", "Closed", 5), (6, "F St", "Issued", 6)) == {"f st": 1}
    assert p.run() == {"f st": 1}                             # nothing new


def test_state_holds_no_closed_events_of_long_ago(spark):
    p = Permits(spark)
    p.arrive(*[(k, f"{k} St", "Issued", 0) for k in range(40)])
    p.arrive(*[(k, f"{k} St", "Closed", 1) for k in range(30)])
    p.arrive((100, "X St", "Issued", 30))                     # the watermark passes the closings
    p.arrive((101, "Y St", "Issued", 30))
    assert p.states() == {*range(30, 40), 100, 101}


def test_log_is_added_up_and_batches_are_idempotent(spark):
    p = Permits(spark)
    p.arrive((1, "A St", "Issued", 0), (2, "B St", "Issued", 0))
    first = p.last
    p.arrive((1, "A St", "Closed", 1), (3, "C St", "Issued", 1))
    log = f"{p.base}/log"
    before = {r["address"] for r in labelled_addresses(spark, log, as_of=first).collect()}
    assert before == {"a st", "b st"}
    # a batch that is run again writes its folder anew
    again = spark.read.parquet(f"{log}/changes").where(F.col("batch") == p.last).drop("batch").checkpoint()
    again.write.mode("overwrite").parquet(f"{log}/changes/batch={p.last}")
    assert {r["address"] for r in labelled_addresses(spark, log).collect()} == {"b st", "c st"}
    compact_labels(spark, log, p.last)
    compact_labels(spark, log, first)                         # already in the base
    assert p.arrive((2, "B St", "Closed", 2)) == {"c st": 1}
    with pytest.raises(ValueError):
        labelled_addresses(spark, log, as_of=first)
    homes = spark.createDataFrame([(1, "C ST"), (2, "B St"), (3, None)], "k int, a string")
    assert {(r["k"], r["TARGET"]) for r in labelled_entities(homes, "a", log).collect()} == {(1, 1), (2, 0), (3, 0)}


class GroupedPermits(Permits):
    """The same with a state kept by groups of events."""

    def run(self):
        q = label_withdrawal_stream(self.spark, f"{self.base}/in", RECORD, "permit", "address", "at",
                                    F.col("status") != "Closed", f"{self.base}/log", f"{self.base}/ckpt",
                                    late_by="2 days", grouped=True)
        q.awaitTermination()
        return {r["address"]: r["open_events"] for r in labelled_addresses(self.spark, f"{self.base}/log").collect()}

    def groups(self):
        return [[int(k) for k in r["value"]["groupState"]["key"]]
                for r in self.spark.read.format("statestore").load(f"{self.base}/ckpt").collect()]


def test_grouped_state_needs_few_calls_and_drops_closed_events(spark, monkeypatch):
    monkeypatch.setattr(label_state, "GROUPS", 5)
    p = GroupedPermits(spark)
    p.arrive(*[(k, f"{k} St", "Issued", 0) for k in range(40)])
    assert len(p.groups()) == 5                               # rows of state, each one call
    assert sorted(sum(p.groups(), [])) == [*range(40)]
    assert len(p.arrive(*[(k, f"{k} St", "Closed", 1 + k / 100) for k in range(30)])) == 10
    p.arrive((100, "X St", "Issued", 30))                     # the watermark passes the closings
    assert p.arrive((101, "Y St", "Issued", 30), (30, "Z St", "Closed", 30)) == {
        **{f"{k} st": 1 for k in range(31, 40)}, "x st": 1, "y st": 1}
    assert sorted(sum(p.groups(), [])) == [*range(30, 40), 100, 101]
    late = {f"{k} st": 1 for k in range(31, 40)}
    assert p.arrive((100, "X St", "Closed", 40), (101, "Y St", "Closed", 40)) == late
    p.arrive(*[(k, None, "Closed", 50) for k in range(31, 40)])
    assert p.arrive((200, "W St", "Issued", 90)) == {"w st": 1}
    assert p.groups() == [[200]]                              # groups without events are gone


def test_grouped_state_gives_the_labels_of_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(label_state, "GROUPS", 3)
    rng, p, newest = random.Random(5), GroupedPermits(spark), {}
    for n in range(5):
        rows = []
        for _ in range(60):
            k, d = rng.choice([None, *range(30)]), rng.choice([None, *(n + i / 4 for i in range(8))])
            status = rng.choice(["Issued", "Closed", "Closed", None])
            rows.append((k, None if k is None or k % 7 == 0 else f"S {(k + int(4 * (d or 0))) % 9}", status, d))
        for k, a, s, d in rows:
            if k is not None and d is not None:
                closed = s in ("Closed", None)                # an unknown status is not open
                newest[k] = max(newest.get(k, (-1,)), (d, closed, "" if closed or a is None else a.lower()))
        want = {}
        for _, _, a in newest.values():
            if a:
                want[a] = want.get(a, 0) + 1
        assert p.arrive(*rows) == want


def plain_asof(left, right, strict):
    by = {}
    for k, at, v in right:
        if k is not None and at is not None:
            by.setdefault(k, []).append((at, v))
    out = []
    for k, at, i in left:
        rows = sorted(by.get(k, [])) if at is not None else []
        n = bisect.bisect_left(rows, (at,)) if strict else bisect.bisect_right(rows, (at, 10**9))
        out.append((i, rows[n - 1][1] if n else None))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_plain_version_with_a_hot_key(spark, strict):
    rng = random.Random(strict)
    def key():
        return rng.choice([7, 7, 7, 7, *range(5, 12), None])
    left = [(key(), rng.choice([None, *range(60)]), i) for i in range(700)]
    right = [(key(), rng.choice([None, *range(60)]), rng.randrange(1000)) for _ in range(150)] + [
        (3, 5, 1), (13, 2, 2)]
    a = spark.createDataFrame(left, "k int, t int, i int").repartition(5)
    b = spark.createDataFrame(right, "k int, t int, v int")
    got = asof_join(a, b, "k", "t", "k", "t", ["v"], strict)
    assert got.columns == ["k", "t", "i", "v"]
    assert sorted((r["i"], r["v"]) for r in got.collect()) == plain_asof(left, right, strict)
    assert asof_join(a, b.limit(0), "k", "t", "k", "t", ["v"]).where("v is not null").count() == 0
    assert asof_join(a.limit(0), b, "k", "t", "k", "t", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(a, b, "k", "t", "k", "t", ["t"])


def test_a_key_of_many_ranges_is_carried_over_all(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
        right = spark.createDataFrame([(1, 0, "only")], "k int, t long, v string")
        got = asof_join(left, right, "k", "t", "k", "t", ["v"])
        assert got.where("v = 'only'").count() == 5000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_yearly_state_carries_attributes_over_silent_years(spark):
    h = spark.createDataFrame(
        [(1, dt.datetime(2018, 3, 1), "a"), (1, dt.datetime(2018, 12, 31, 23), "b"),
         (1, dt.datetime(2021, 1, 1), "c"), (2, dt.datetime(2020, 5, 5), None), (3, None, "x"),
         (4, dt.datetime(2030, 1, 1), "later")], "k int, at timestamp_ntz, v string")
    got = {(r["k"], r["year"]): r["v"] for r in yearly_state(h, "k", "at", ["v"], 2021).collect()}
    assert got == {(1, 2018): "b", (1, 2019): "b", (1, 2020): "b", (1, 2021): "c", (2, 2020): None, (2, 2021): None}


def _files(path):
    return {y: sorted(os.path.basename(f) for f in glob.glob(f"{path}/year={y}/*.parquet")) for y in (2019, 2020, 2021)}


def test_rewriting_one_year_leaves_the_files_of_the_others(spark):
    path = scratch_dir(spark, "store-test").replace("file:", "")
    rows = spark.range(300).select("id", (F.lit(2019) + F.col("id") % 3).cast("int").alias("year"))
    write_partitions(rows, path, ["year"], files_per_value=2)
    before = _files(path)
    assert all(1 <= len(f) <= 2 for f in before.values())
    write_partitions(rows.where("year = 2020 and id < 100").withColumn("id", -F.col("id")), path, ["year"])
    after = _files(path)
    assert before[2019] == after[2019] and before[2021] == after[2021]
    assert not set(before[2020]) & set(after[2020])
    got = spark.read.parquet(path)
    assert got.where("year = 2020").count() == 33 and got.where("year <> 2020").count() == 200


def test_the_store_is_pruned_by_the_join(spark):
    path = scratch_dir(spark, "store-test")
    rows = spark.range(300).select("id", (F.lit(2019) + F.col("id") % 3).cast("int").alias("year"))
    write_partitions(rows, path, ["year"])
    wanted = spark.createDataFrame([(2020, 1), (2021, 0)], "year int, use int").where("use = 1")
    joined = spark.read.parquet(path).join(wanted, "year")
    assert joined.count() == 100
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
