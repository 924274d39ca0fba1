"""Readers.

Delimited text is read with an explicit schema whenever one is known:
inference costs an extra pass and turns zero-padded keys into numbers.
Zipped CSV cannot be read by the CSV source (it silently yields wrong rows),
so archives are read as binary files and decoded by ``mapInPandas``: one
archive per task (a zip is not splittable), rows yielded in bounded batches.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The texts that pandas reads as missing.
DEFAULT_NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                       "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                       "nan", "null")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table (columnar, filter and column pushdown)."""
    return spark.read.parquet(path)


def _resolve(df: DataFrame, cols: Sequence) -> list[str]:
    return [df.columns[c] if isinstance(c, int) else c for c in cols]


def _nulls(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    toks = list(tokens)
    return df.withColumns({c: F.when(F.col(c).isin(toks), F.lit(None)).otherwise(F.col(c))
                           for c, t in df.dtypes if t == "string"}) if toks else df


def _timestamps(df: DataFrame, cols, fmt: str | None) -> DataFrame:
    args = [F.lit(fmt)] if fmt else []
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), *args)
                           for c in _resolve(df, cols)}) if cols else df


def _typed(df: DataFrame, schema: T.StructType, strict: bool) -> DataFrame:
    """Text columns cast to ``schema``, bound by name."""
    def value(f):
        c = F.col(f"`{f.name}`")
        return c.cast(f.dataType) if strict else c.try_cast(f.dataType)

    return df.select(*[value(f).alias(f.name) for f in schema.fields])


def as_schema(schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
                   header: bool = True, sep: str = ",", encoding: str = "UTF-8",
                   infer: bool = False, null_tokens: Sequence[str] = DEFAULT_NULL_TOKENS,
                   timestamp_cols: Sequence | None = None, timestamp_format: str | None = None,
                   multi_line: bool = False, limit: int | None = None, strict: bool = True,
                   glob: str | None = None) -> DataFrame:
    """CSV / delimited text.

    ``schema`` fixes names and types (no inference pass); with a header its
    columns are bound by name, columns of the file beyond it are left out, and
    a missing column, or a file whose header differs from the first file's, is
    an error.  ``null_tokens`` become null before the types are applied; a
    value that is not of its type is an error, or null without ``strict``.
    Without a schema every column is text unless ``infer``.
    ``timestamp_cols`` (names or 0-based positions) are parsed with
    ``try_to_timestamp``: a bad value becomes null, the column is still typed.
    ``limit`` reads the first rows only (``nrows``)."""
    def reader():
        r = spark.read.option("header", header).option("sep", sep).option("encoding", encoding) \
            .option("multiLine", multi_line).option("mode", "FAILFAST")
        return r.option("pathGlobFilter", glob) if glob else r

    if schema is not None:
        schema = as_schema(schema)
        names = schema.fieldNames()
        if header:
            found = reader().csv(path).columns          # one line of one file
            missing = [n for n in names if n not in found]
            if missing:
                raise ValueError(f"columns not in the file: {missing}")
            text = reader().schema(_text_schema(found)).option("enforceSchema", False).csv(path)
        else:
            text = reader().schema(_text_schema(names)).csv(path)
        df = _typed(_nulls(text, null_tokens), schema, strict)
    else:
        df = _nulls((reader().option("inferSchema", True) if infer else reader()).csv(path), null_tokens)
    df = _timestamps(df, timestamp_cols, timestamp_format)
    return df.limit(limit) if limit is not None else df


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path`` matching ``glob`` (path, length), listed by the
    binary-file source without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", True).load(path).select("path", "length")


def directory_entries(spark: SparkSession, path: str, glob: str = "*.csv") -> list[str]:
    """Top-level entries below ``path`` with files that match: a plain file, or
    a folder written by Spark (``name.csv/part-*``).  The files are listed and
    grouped by Spark; the driver gets one row per entry."""
    root = path.rstrip("/").rsplit("://", 1)[-1].replace("file:", "", 1)
    rest = F.substring_index(F.col("path"), root + "/", -1)
    entries = list_files(spark, path, glob).select(
        F.substring_index(rest, "/", 1).alias("entry")).distinct()
    return sorted(r["entry"] for r in entries.collect())


def entry_table_name(entry: str, prefix: str = "EXTR_") -> str:
    """File name -> table name: prefix stripped, cut at the first dot,
    lower case (the Column version is ``functions.table_name``)."""
    base = entry[len(prefix):] if entry.startswith(prefix) else entry
    return base.split(".", 1)[0].lower()


def read_directory(spark: SparkSession, path: str, glob: str = "*.csv", prefix: str = "EXTR_",
                   schema=None, **opts) -> dict[str, DataFrame]:
    """One DataFrame per top-level entry of a directory, keyed by the table
    name made from the entry name.  Each table is a lazy read of its files.
    ``schema`` may be a dict by table name.  Two entries of one table name are
    an error."""
    out: dict[str, DataFrame] = {}
    for e in directory_entries(spark, path, glob):
        name = entry_table_name(e, prefix)
        if name in out:
            raise ValueError(f"two entries make the table {name!r}")
        own = schema.get(name) if isinstance(schema, dict) else schema
        out[name] = read_delimited(spark, f"{path.rstrip('/')}/{e}", schema=own, glob=glob, **opts)
    return out


def csv_chunks(fh, entry: str, names: list[str], header: bool, encoding: str, sep: str, batch_rows: int):
    """Text columns ``names`` of an open CSV stream, in bounded chunks: C parser, text
    kept as text, quotes and quoted newlines respected."""
    import pandas as pd

    chunks = pd.read_csv(fh, sep=sep, header=0 if header else None, dtype=str, keep_default_na=False,
                         na_filter=False, encoding=encoding, chunksize=batch_rows, index_col=False)
    for chunk in chunks:
        if not header:
            if len(chunk.columns) != len(names):
                raise ValueError(f"{entry}: {len(chunk.columns)} columns, the schema has {len(names)}")
            chunk.columns = names
        missing = [n for n in names if n not in chunk.columns]
        if missing:
            raise ValueError(f"{entry}: columns not in the file: {missing}")
        yield chunk[names]


def _zip_rows(names: list[str], header: bool, encoding: str, sep: str, batch_rows: int,
              member: str):
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as zf:
                    for entry in zf.namelist():
                        if entry.endswith("/") or not fnmatch.fnmatch(entry.rsplit("/", 1)[-1], member):
                            continue
                        with zf.open(entry) as fh:
                            yield from csv_chunks(fh, entry, names, header, encoding, sep, batch_rows)
    return run


def read_zipped_delimited(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
                          encoding: str = "UTF-8", sep: str = ",", glob: str = "*.zip",
                          null_tokens: Sequence[str] = DEFAULT_NULL_TOKENS,
                          timestamp_cols: Sequence | None = None, batch_rows: int = 50_000,
                          member: str = "*.csv", strict: bool = True) -> DataFrame:
    """Zipped CSV archives below ``path``: the members whose name matches
    ``member``, parsed by pandas in chunks (quoted separators and newlines
    respected).  Columns are bound by header name (by position without a
    header), as in ``read_delimited``.  Land the result as Parquet once.

    A task holds a whole archive (up to 2 GiB); larger ones, or archives of many
    members, are read by ``archives.read_zip_members``."""
    schema = as_schema(schema)
    names = schema.fieldNames()
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", True).load(path).select("content")
    # no repartition: the file source already gives each task whole archives,
    # and a shuffle would move every compressed byte once more
    raw = files.mapInPandas(_zip_rows(names, header, encoding, sep, batch_rows, member),
                            _text_schema(names))
    return _timestamps(_typed(_nulls(raw, null_tokens), schema, strict), timestamp_cols, None)


def synthetic_binary(spark: SparkSession, n: int, cols: Sequence[str], seed: int = 0) -> DataFrame:
    """Random 0/1 table, ``n`` rows x ``cols`` (smoke data for a learner),
    generated on the executors."""
    return spark.range(n).select(
        F.col("id"), *[(F.rand(seed + i) < 0.5).cast("int").alias(c) for i, c in enumerate(cols)])
