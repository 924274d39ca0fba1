"""Delimited text with bad records: typed rows, and a table of what was rejected.

The lines are read once.  A line of the wrong number of columns, with a value that
is not of its column's type, or without a value that must be there, becomes a
reject with its file, the reason (the first column that is at fault) and the line
as it stands in the file.  Rows and rejects go to one Parquet table in two
folders in the same pass; their counts come from the footers of the files.  (An
``Observation`` would count on the way, but a session that has made one can't
apply MLlib models any more: they can't be sent to tasks.)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelrisk.sources.readers import DEFAULT_NULL_TOKENS, as_schema

_BAD = "_pr_bad"


@dataclass(frozen=True)
class Loaded:
    """What ``read_with_rejects`` made of the files."""
    rows: DataFrame          # the typed rows
    rejects: DataFrame       # file, reason, line
    n_rows: int
    n_rejects: int


def _quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _reason(schema: T.StructType, raw: dict[str, Column], typed: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for f in reversed(schema.fields):
        if not f.nullable:
            out = F.when(typed[f.name].isNull(), f"{f.name}: no value").otherwise(out)
        out = F.when(raw[f.name].isNotNull() & typed[f.name].isNull(),
                     f"{f.name}: not of type {f.dataType.simpleString()}").otherwise(out)
    return F.when(F.col(_BAD).isNotNull(), "number of columns").otherwise(out)


def read_with_rejects(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, out_dir: str,
                      header: bool = True, sep: str = ",", encoding: str = "UTF-8",
                      null_tokens: Sequence[str] = DEFAULT_NULL_TOKENS, glob: str | None = None) -> Loaded:
    """Read delimited files with an explicit schema into the new folder ``out_dir``.

    With a header, columns are bound by name (a missing one is an error) and the
    header lines, which must be the same in all files, are left out; without one, by
    position.  A record is one line: quoted separators are respected, quoted
    newlines aren't.  ``nullable=False`` in the schema makes a value a must."""
    schema = as_schema(schema)
    names = schema.fieldNames()

    def reader():
        r = spark.read.option("encoding", encoding)
        return r.option("pathGlobFilter", glob) if glob else r

    if header:
        found = reader().option("header", True).option("sep", sep).csv(path).columns     # one line of one file
        missing = [n for n in names if n not in found]
        if missing:
            raise ValueError(f"columns not in the file: {missing}")
    else:
        found = names
    # a separator that no text has: the line as it is, in the files' encoding
    lines = reader().option("sep", "\u0001").option("quote", "").option("header", False) \
        .option("mode", "FAILFAST").schema("line string").csv(path)
    places = [f"c{i}" for i in range(len(found))]
    record = T.StructType([T.StructField(c, T.StringType()) for c in [*places, _BAD]])
    fields = lines.select("line", F.col("_metadata.file_path").alias("file"), F.from_csv(
        "line", record.simpleString()[len("struct<"):-1].replace(":", " "),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "sep": sep}).alias("r")).select(
        "line", "file", "r.*")
    if header:
        same = F.lit(True)
        for c, n in zip(places, found):
            same = same & F.col(c).eqNullSafe(F.lit(n))
        fields = fields.where(~(same & F.col(_BAD).isNull()))
    toks = list(null_tokens)
    raw, typed = {}, {}
    for f in schema.fields:
        c = F.col(f"c{found.index(f.name)}")
        raw[f.name] = F.when(c.isin(toks), F.lit(None)).otherwise(c) if toks else c
        typed[f.name] = raw[f.name].try_cast(f.dataType)
    judged = fields.withColumn("_pr_reason", _reason(schema, raw, typed))
    bad = F.col("_pr_reason").isNotNull()
    table = judged.select(
        F.struct(*[F.when(~bad, typed[n]).alias(n) for n in names]).alias("row"),
        F.when(bad, F.struct("file", F.col("_pr_reason").alias("reason"), "line")).alias("reject"),
        bad.cast("int").alias("rejected"))
    table.write.partitionBy("rejected").parquet(out_dir)
    stored = spark.read.schema(table.schema).parquet(out_dir)
    counts = stored.agg(F.count(F.lit(1)).alias("n"),                       # reads no column of the files
                        F.count_if(F.col("rejected") == 1).alias("n_rejects")).first()
    return Loaded(stored.where("rejected = 0").select(*[_quoted("row")[n].alias(n) for n in names]),
                  stored.where("rejected = 1").select("reject.*"),
                  counts["n"] - counts["n_rejects"], counts["n_rejects"])
