"""Labels that are withdrawn: an event that closes takes its label back.

Events (permits) arrive again and again, each time with their present status.
A keyed state holds, per event, when its status was last heard of, whether it is
open, and the address it is open for.  A batch gives out only changes: +1 for
an address that an event begins to be open for, -1 where it ceases to be.  An
older record that arrives late changes nothing.  A closed event is kept until
the watermark has passed its time, when no older record of it can still be let
in; then its state goes.  So the state holds the open events and those closed
of late, never the history.

The state is one row per event, which suits small arrivals: Spark calls Python
once for each event that is heard of.  ``grouped`` keeps it by groups of events
instead, with the same labels: calls are at most ``GROUPS`` in a batch, however
many events come, and a group that is heard of is written whole.

The sink is a log of changes, one folder per batch, added up per address
beforehand.  A batch that is run again rewrites its own folder, so the log is
right after any restart.  An address is labelled while its changes sum to more
than zero.  ``compact_labels`` adds up the batches so far into a base; readers
take the latest base and the batches after it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parcelrisk.operators.match import flag_membership

GROUPS = 4096           # a checkpoint with grouped state is bound to this number
_STATE = "at long, open boolean, address string"
_GROUP_STATE = "key array<string>, at array<long>, open array<boolean>, address array<string>"
_CHANGE = "address string, change long"
_LOG = "address string, change long, batch long"
_BASE = "address string, change long, upto long"


def status_changes(events: DataFrame, key: str, address: str, at: str, is_open: Column,
                   late_by: str = "1 day", grouped: bool = False) -> DataFrame:
    """(address, change) of a stream of event records: ``key`` names the event,
    ``at`` (a timestamp) orders its records, ``is_open`` says whether a record
    leaves it open.  Of records of one time a closing one counts as the later.
    Records without a key or a time are left out; an open event without an
    address labels nothing.  With ``grouped`` the changes of an address come
    added up by group, and events are told apart by their key as a string."""
    import pandas as pd

    moment = F.col(at).cast("timestamp")
    rows = events.select(F.col(key).alias("key"), F.lower(F.col(address)).alias("address"),
                         moment.alias("at"), F.unix_micros(moment).alias("us"),
                         F.coalesce(is_open, F.lit(False)).alias("open")) \
        .where(F.col("key").isNotNull() & F.col("at").isNotNull()) \
        .withWatermark("at", late_by)

    def changed(_key, frames: Iterator["pd.DataFrame"], state: GroupState):
        if state.hasTimedOut:                  # closed, and nothing older can come
            state.remove()
            return
        held = state.get if state.exists else None
        newest = None                          # (time, closed, address) of the latest record
        for pdf in frames:
            for us, opened, where in zip(pdf["us"], pdf["open"], pdf["address"]):
                if newest is None or (us, not opened) > newest[:2]:
                    newest = (int(us), not opened, where if opened and isinstance(where, str) else None)
        was_for = None if held is None else held[2]
        if held is not None and newest[:2] <= (held[0], not held[1]):
            newest = (held[0], not held[1], was_for)          # older than what is known
        state.update((newest[0], not newest[1], newest[2]))
        if newest[1]:
            state.setTimeoutTimestamp(max(newest[0] // 1000, state.getCurrentWatermarkMs()) + 1)
        out = [(a, n) for a, n in ((was_for, -1), (newest[2], 1)) if a is not None]
        if newest[2] != was_for:
            yield pd.DataFrame(out, columns=["address", "change"])

    def group_changed(_group, frames: Iterator["pd.DataFrame"], state: GroupState):
        held, sums = {}, {}                    # key: (time, closed, address); address: change
        if state.exists:
            held = {k: (us, not opened, where) for k, us, opened, where in zip(*state.get)}
        for pdf in () if state.hasTimedOut else frames:
            for k, us, opened, where in zip(*(pdf[c].tolist() for c in ("key", "us", "open", "address"))):
                was = held.get(k)
                if was is not None and (us, not opened) <= was[:2]:
                    continue                   # older than what is known
                now = held[k] = (us, not opened, where if opened and isinstance(where, str) else None)
                for a, n in ((None if was is None else was[2], -1), (now[2], 1)):
                    if a is not None:
                        sums[a] = sums.get(a, 0) + n
        mark = state.getCurrentWatermarkMs()   # nothing older can come to what is closed before it
        held = {k: v for k, v in held.items() if not v[1] or v[0] // 1000 + 1 >= mark}
        if held:
            state.update((list(held), [v[0] for v in held.values()], [not v[1] for v in held.values()],
                          [v[2] for v in held.values()]))
            closed = min((v[0] for v in held.values() if v[1]), default=None)
            if closed is not None:
                state.setTimeoutTimestamp(max(closed // 1000, mark) + 1)
        else:
            state.remove()
        out = [(a, n) for a, n in sums.items() if n]
        if out:
            yield pd.DataFrame(out, columns=["address", "change"])

    if grouped:
        rows = rows.withColumn("key", F.col("key").cast("string")) \
            .withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))
        return rows.groupBy("group").applyInPandasWithState(
            group_changed, _CHANGE, _GROUP_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return rows.groupBy("key").applyInPandasWithState(
        changed, _CHANGE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def label_withdrawal_stream(spark: SparkSession, events_dir: str, schema: T.StructType | str, key: str,
                            address: str, at: str, is_open: Column, log_dir: str, checkpoint: str,
                            fmt: str = "parquet", late_by: str = "1 day", available_now: bool = True,
                            max_files_per_trigger: int | None = None,
                            grouped: bool = False) -> StreamingQuery:
    """Start the query that follows ``events_dir`` and writes the log of changes
    below ``log_dir``.  ``available_now`` takes what is there and stops.
    ``grouped`` (for large arrivals) keeps the state by groups of events; a
    checkpoint goes on as it began."""
    reader = spark.readStream.schema(schema).format(fmt).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = status_changes(reader.load(events_dir), key, address, at, is_open, late_by, grouped)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("address").agg(F.sum("change").alias("change")).where("change <> 0") \
            .write.mode("overwrite").parquet(f"{log_dir}/changes/batch={batch_id}")

    w = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(append)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _bases(spark: SparkSession, log_dir: str) -> tuple[DataFrame, int] | None:
    """The latest base and the batch up to which it goes."""
    from pyspark.errors import AnalysisException
    try:
        base = spark.read.schema(_BASE).parquet(f"{log_dir}/base")
    except AnalysisException as e:             # none was made yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    upto = base.agg(F.max("upto")).first()[0]
    return None if upto is None else (base.where(F.col("upto") == upto).drop("upto"), upto)


def labelled_addresses(spark: SparkSession, log_dir: str, as_of: int | None = None) -> DataFrame:
    """(address, ``open_events``): the addresses labelled now, or after the
    batch ``as_of`` (not before the latest base)."""
    log = spark.read.schema(_LOG).parquet(f"{log_dir}/changes")
    if as_of is not None:
        log = log.where(F.col("batch") <= as_of)
    base = _bases(spark, log_dir)
    if base is not None:
        if as_of is not None and as_of < base[1]:
            raise ValueError(f"the batches up to {base[1]} are added up")
        log = log.where(F.col("batch") > base[1]).drop("batch").unionByName(base[0])
    return log.groupBy("address").agg(F.sum("change").alias("open_events")).where("open_events > 0")


def compact_labels(spark: SparkSession, log_dir: str, upto: int) -> None:
    """Add up the batches to ``upto`` into a base.  It counts once it is written
    whole; the folders it replaces may then be deleted."""
    log = spark.read.schema(_LOG).parquet(f"{log_dir}/changes").where(F.col("batch") <= upto)
    base = _bases(spark, log_dir)
    if base is not None:
        if base[1] >= upto:
            return
        log = log.where(F.col("batch") > base[1]).drop("batch").unionByName(base[0])
    log.groupBy("address").agg(F.sum("change").alias("change")).where("change <> 0") \
        .write.mode("overwrite").parquet(f"{log_dir}/base/upto={upto}")


def labelled_entities(entities: DataFrame, entity_address: str, log_dir: str,
                      as_of: int | None = None, out: str = "TARGET") -> DataFrame:
    """``entities`` with the label as it stands (row count unchanged)."""
    labels = labelled_addresses(entities.sparkSession, log_dir, as_of)
    return flag_membership(entities, labels, entity_address, "address", out=out)
