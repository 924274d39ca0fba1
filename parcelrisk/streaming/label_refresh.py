"""Refresh labels as new events (permits) arrive.

New event files land in a folder; a file-source stream picks them up, keeps
the pending ones, matches them against the (static) entity table by
normalised address and emits each entity the first time it gets a pending
event.  A batch reduces its events to distinct addresses before the join, so a
hot address meets its entities once, and leaves out the entities of earlier
batches; the stream keeps no state.  Output is one Parquet folder per batch
(``batch=<id>``, rewritten when the batch is run again) plus a checkpoint, both
in shared storage, so a restarted query continues exactly where it stopped.

A large entity table is better joined through ``address_index``: its
(key, normalised address) pairs written once as a table bucketed by the
address, so every micro-batch shuffles only its own new events to the
buckets and never the entity table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parcelrisk.sources.sinks import save_bucketed


ADDRESS = "_pr_addr"      # normalised address column of the entity index


def address_index(entities: DataFrame, entity_address: str, entity_key: str, table: str,
                  buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Entity keys with their normalised address, saved as a catalog table
    bucketed and sorted by the address (``new_positives`` uses it as is).
    Use at least ``spark.sql.shuffle.partitions`` buckets: with fewer, Spark
    shuffles the index again rather than lose join parallelism.  ``mode``
    "overwrite" rebuilds it (e.g. after the entity table changed)."""
    pairs = entities.select(entity_key, F.lower(F.col(entity_address)).alias(ADDRESS)) \
        .where(F.col(ADDRESS).isNotNull())
    return save_bucketed(pairs, table, [ADDRESS], buckets, mode)


def new_positives(events: DataFrame, entities: DataFrame, pending: Callable[[DataFrame], DataFrame],
                  event_address: str, entity_address: str, entity_key: str) -> DataFrame:
    """Entities matched by a pending event, one row per entity.  ``entities`` is the entity table, or
    an ``address_index`` of it (then ``entity_address`` is not used)."""
    keys = pending(events).select(F.lower(F.col(event_address)).alias(ADDRESS)) \
        .where(F.col(ADDRESS).isNotNull()).distinct()
    if ADDRESS in entities.columns:
        ents = entities.select(entity_key, ADDRESS)
    else:
        ents = entities.select(entity_key, F.lower(F.col(entity_address)).alias(ADDRESS))
    return keys.join(ents, on=ADDRESS, how="inner").select(entity_key).dropDuplicates([entity_key])


def label_refresh_stream(spark: SparkSession, events_dir: str, events_schema, entities: DataFrame,
                         pending: Callable[[DataFrame], DataFrame], event_address: str,
                         entity_address: str, entity_key: str, sink_dir: str, checkpoint: str,
                         fmt: str = "parquet", glob: str | None = None,
                         available_now: bool = True, max_files_per_trigger: int | None = None
                         ) -> StreamingQuery:
    """Start the refresh query; newly positive entity keys are appended to
    ``sink_dir`` (columns: the key and ``batch``).  ``available_now`` processes what is there and stops
    (scheduled runs); otherwise it keeps running."""
    reader = spark.readStream.schema(events_schema).format(fmt) \
        .option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.load(events_dir)

    def append(batch: DataFrame, batch_id: int) -> None:
        found = new_positives(batch, entities, pending, event_address, entity_address, entity_key)
        if batch_id > 0:
            before = T.StructType([found.schema[entity_key], T.StructField("batch", T.LongType())])
            known = spark.read.schema(before).parquet(sink_dir).where(F.col("batch") < batch_id)
            found = found.join(known, entity_key, "left_anti")
        found.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
