"""Zipped delimited text, one task per member.

A batch source in Python: the driver reads the central directories of the
archives (a few bytes per member) and plans one partition per member, largest
first; a task opens the archive where it lies, seeks to its member and parses
it as it is inflated.  So neither the size of an archive nor that of a member
is bounded by memory, and an archive of many members is read by many tasks.
The file system has to be one that pyarrow opens (local and mounted paths, HDFS
with its native library, object stores); ``readers.read_zipped_delimited`` reads whole
archives through Spark's own file systems where it is not.
"""

from __future__ import annotations

import fnmatch
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parcelrisk.sources.readers import (
    DEFAULT_NULL_TOKENS, _nulls, _text_schema, _timestamps, _typed, as_schema, csv_chunks,
)


def open_file_system(uri: str):
    """(file system, path) of a URI; a path without a scheme is a local one."""
    from pyarrow import fs as pafs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def archives_below(path: str, glob: str) -> list[str]:
    """The paths of the archives below ``path`` (or ``path`` itself), ascending."""
    from pyarrow import fs as pafs
    filesystem, at = open_file_system(path)
    info = filesystem.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [at]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = filesystem.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(i.path for i in found if i.type == pafs.FileType.File
                  and fnmatch.fnmatch(i.base_name, glob)
                  and not any(part.startswith(("_", ".")) for part in i.path[len(at):].split("/")))


class Member(InputPartition):
    def __init__(self, archive: str, name: str, size: int):
        super().__init__((archive, name))
        self.archive, self.name, self.size = archive, name, size


class MemberReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.names = dict(options), schema.fieldNames()

    def partitions(self) -> list[Member]:
        path, wanted = self.options["path"], self.options.get("member", "*.csv")
        filesystem, _ = open_file_system(path)
        members = []
        for archive in archives_below(path, self.options.get("glob", "*.zip")):
            with filesystem.open_input_file(archive) as fh, zipfile.ZipFile(fh) as zf:
                members += [Member(archive, m.filename, m.file_size) for m in zf.infolist()
                            if not m.is_dir() and fnmatch.fnmatch(m.filename.rsplit("/", 1)[-1], wanted)]
        # Spark wants one partition at least
        return sorted(members, key=lambda m: (-m.size, m.archive, m.name)) or [Member("", "", 0)]

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if not member.archive:
            return
        filesystem, _ = open_file_system(self.options["path"])
        schema = pa.schema([(n, pa.string()) for n in self.names])
        with filesystem.open_input_file(member.archive) as fh, zipfile.ZipFile(fh) as zf, \
                zf.open(member.name) as raw:
            for chunk in csv_chunks(raw, member.name, self.names, json.loads(self.options.get("header", "true")),
                                    self.options.get("encoding", "UTF-8"), self.options.get("sep", ","),
                                    int(self.options.get("batchrows", "50000"))):
                yield pa.RecordBatch.from_pandas(chunk, schema, preserve_index=False)


class ZippedDelimited(DataSource):
    """``spark.read.format("zipped_delimited")``: text columns named by the schema."""

    @classmethod
    def name(cls) -> str:
        return "zipped_delimited"

    def reader(self, schema: T.StructType) -> MemberReader:
        return MemberReader(self.options, schema)


def read_zip_members(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
                     encoding: str = "UTF-8", sep: str = ",", glob: str = "*.zip", member: str = "*.csv",
                     null_tokens=DEFAULT_NULL_TOKENS, timestamp_cols=None, batch_rows: int = 50_000,
                     strict: bool = True) -> DataFrame:
    """Zipped CSV archives below ``path``, one task per member; the options are
    those of ``readers.read_zipped_delimited``, the rows are the same."""
    schema = as_schema(schema)
    spark.dataSource.register(ZippedDelimited)
    raw = spark.read.format("zipped_delimited").schema(_text_schema(schema.fieldNames())).options(
        path=path, glob=glob, member=member, header=json.dumps(header), encoding=encoding, sep=sep,
        batchrows=str(batch_rows)).load()
    return _timestamps(_typed(_nulls(raw, null_tokens), schema, strict), timestamp_cols, None)
