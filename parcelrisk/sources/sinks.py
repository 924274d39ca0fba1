"""Sinks: delimited text, run-stamped outputs, catalog registration, and
zipped CSV archives (one archive per partition, written by its task)."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parcelrisk.sources.readers import directory_entries, entry_table_name, read_delimited


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True,
                    sep: str = ",", single_file: bool = False, encoding: str = "UTF-8") -> str:
    """CSV with a header.  Writes in parallel, one file per partition; a
    single file (``coalesce(1)``, one task for all rows) only on request."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", header).option("sep", sep) \
        .option("encoding", encoding).csv(path)
    return path


def write_run(df: DataFrame, base: str, run_id: str | None = None, fmt: str = "parquet",
              mode: str = "errorifexists") -> str:
    """Write a scored table below ``base/run_id=<stamp>`` (default stamp
    ``yyyyMMdd-HHmmss`` of now) and return the folder; no driver collect."""
    run_id = run_id or time.strftime("%Y%m%d-%H%M%S")
    path = f"{base.rstrip('/')}/run_id={run_id}"
    df.write.mode(mode).format(fmt).save(path)
    return path


def write_partitions(df: DataFrame, path: str, by: Sequence[str], files_per_value: int = 1,
                     spread_by: Sequence[str] = ()) -> str:
    """Write ``df`` below ``path`` in one folder per value of ``by`` (say, the
    year).  A folder whose value ``df`` has is replaced, the others keep their
    files: recomputing one year touches that year only.

    Each value is written by ``files_per_value`` tasks, so a value with a third
    of the rows needn't be one task's; its rows are dealt by a hash of
    ``spread_by`` (default: all other columns)."""
    spread = list(spread_by) or [f.name for f in df.schema if f.name not in set(by)
                                 and "map<" not in f.dataType.simpleString()]
    deal = [F.col(c) for c in by]
    if files_per_value > 1 and spread:
        deal.append(F.pmod(F.xxhash64(*spread), F.lit(files_per_value)))
    df.repartition(*deal).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*by).parquet(path)
    return path


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int,
                  mode: str = "errorifexists") -> DataFrame:
    """Catalog table bucketed and sorted by ``keys``: a later equi-join on
    the keys reads it without a shuffle (only the other side is shuffled to
    match), which pays off when the table is joined again and again."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def register_directory(spark: SparkSession, path: str, glob: str = "*.csv", prefix: str = "EXTR_",
                       database: str | None = None, schema=None, schema_only: bool = False,
                       parallelism: int = 8, **read_opts) -> DataFrame:
    """Create one catalog table per top-level entry of ``path`` (a file, or
    a folder of part files), named from the entry.  Every entry is reported
    and none stops the others: ``created``; ``exists`` (the table is left
    alone); ``clash`` (another entry has made this table); ``failed: <error>:
    <its first line>``.  What is not about an entry, such as a lost connection to
    the driver's JVM, is raised.
    ``schema`` may be a dict by table name.  With ``schema_only`` the tables
    are created empty, with the columns (and types) of the files.  Returns
    (entry, table_name, status) rows."""
    def create(entry: str, name: str) -> tuple[str, str, str]:
        full = name if database is None else f"{database}.{name}"
        try:
            own = schema.get(name) if isinstance(schema, dict) else schema
            src = read_delimited(spark, f"{path.rstrip('/')}/{entry}", schema=own, glob=glob, **read_opts)
            (src.limit(0) if schema_only else src).write.mode("errorifexists").saveAsTable(full)
            return entry, name, "created"
        except (PySparkException, Py4JJavaError, ValueError) as e:     # the entry's fault
            known = isinstance(e, AnalysisException) and (
                "ALREADY_EXISTS" in str(e) or "already exists" in str(e))
            said = " ".join(str(e).split("\n", 1)[0].split())[:300]
            return entry, name, "exists" if known else f"failed: {type(e).__name__}: {said}"

    # the entries of one name go one after the other, until one makes the table; names
    # go side by side, a few at a time (each is a job of its own)
    entries: dict[str, list[str]] = {}
    for entry in directory_entries(spark, path, glob):          # one row per entry
        entries.setdefault(entry_table_name(entry, prefix), []).append(entry)

    def create_one(name: str) -> list[tuple[str, str, str]]:
        out, made = [], False
        for entry in entries[name]:
            out.append((entry, name, "clash") if made else create(entry, name))
            made = made or out[-1][2] == "created"
        return out

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        status = [row for rows in pool.map(create_one, entries) for row in rows]
    return spark.createDataFrame(status, "entry string, table_name string, status string")


def _zip_writer(out_dir: str, member: str, names: list[str], encoding: str, member_rows: int | None):
    import pandas as pd
    from pyarrow import fs as pafs

    def run(batches):
        batches = iter(batches)
        first = next((b for b in batches if len(b)), None)
        if first is None:                      # empty partition: no archive
            return
        # named by partition: a retried or speculative attempt rewrites the
        # same archive (temp name, then rename) instead of adding a copy
        pid = TaskContext.get().partitionId()
        target = f"{out_dir}/part-{pid:05d}.zip"
        filesystem, final = pafs.FileSystem.from_uri(target)
        tmp = f"{final}.{uuid.uuid4().hex}.tmp"
        filesystem.create_dir(final.rsplit("/", 1)[0], recursive=True)
        stem, dot, ending = member.partition(".")

        def members():
            """(name, its batches); of ``member_rows`` rows each, if given."""
            if member_rows is None:
                yield member, chain([first], batches)
                return
            rest, k = chain([first], batches), 0
            ahead = next(rest, None)
            while ahead is not None:
                def own():
                    nonlocal ahead
                    room = member_rows
                    while ahead is not None and room:
                        part, more = ahead.iloc[:room], ahead.iloc[room:]
                        room -= len(part)
                        ahead = more if len(more) else next((b for b in rest if len(b)), None)
                        yield part
                yield f"{stem}-{k:05d}{dot}{ending}", own()
                k += 1

        n = 0
        # batches stream through the CSV writer into the deflated member on the
        # output stream: memory holds one batch, not the partition
        with filesystem.open_output_stream(tmp) as fh, \
                zipfile.ZipFile(fh, "w", compression=zipfile.ZIP_DEFLATED) as zf:
            for name, own in members():
                with zf.open(name, "w", force_zip64=True) as raw:
                    text = io.TextIOWrapper(raw, encoding=encoding, newline="")
                    head = names
                    for b in own:
                        b.to_csv(text, index=False, header=head, lineterminator="\n")
                        head, n = False, n + len(b)
                    text.flush()
                    text.detach()
        filesystem.move(tmp, final)
        yield pd.DataFrame({"path": [target], "rows": [n]})
    return run


def _target_uri(spark: SparkSession, path: str) -> str:
    """``path`` as a URI; a path without a scheme is a local folder, which only
    a local master shares with its tasks."""
    if "://" in path:
        return path
    if path.startswith("file:/"):
        return "file://" + path[len("file:"):]
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{path!r} names no file system that all executors share")
    return "file://" + path


def write_zipped_delimited(df: DataFrame, out_dir: str, member: str = "data.csv",
                           encoding: str = "UTF-8", mode: str = "errorifexists",
                           member_rows: int | None = None) -> DataFrame:
    """Write each partition as one zip archive holding one CSV member, or, with
    ``member_rows``, members of so many rows (``data-00000.csv``, ...), each with a header.
    Returns a (path, rows) table, one row per archive.  ``mode``:
    "errorifexists" writes when the result is evaluated; "overwrite" writes now,
    to a new folder, and puts the archives in the place of the old ones once all
    are there."""
    from pyarrow import fs as pafs

    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be 'errorifexists' or 'overwrite'")
    uri = _target_uri(df.sparkSession, out_dir.rstrip("/"))
    filesystem, folder = pafs.FileSystem.from_uri(uri)
    there = filesystem.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    if there and mode == "errorifexists":
        raise FileExistsError(out_dir)
    names = df.columns
    text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    columns = "path string, rows long"
    if mode == "errorifexists":
        return text.mapInPandas(_zip_writer(uri, member, names, encoding, member_rows), columns)
    staged = f"_new-{uuid.uuid4().hex[:12]}"
    wrote = text.mapInPandas(_zip_writer(f"{uri}/{staged}", member, names, encoding, member_rows), columns).collect()
    for info in there:
        if info.base_name.endswith(".zip"):
            filesystem.delete_file(info.path)
    done = []
    for r in wrote:
        name = r["path"].rsplit("/", 1)[1]
        filesystem.move(f"{folder}/{staged}/{name}", f"{folder}/{name}")
        done.append((f"{uri}/{name}", r["rows"]))
    if wrote:
        filesystem.delete_dir(f"{folder}/{staged}")
    return df.sparkSession.createDataFrame(done, columns)
