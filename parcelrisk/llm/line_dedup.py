"""Line deduplication: lines that many documents share stay in one of them.

Line keys are hashed to 128 bits and dealt by ranges of (hash, document), with
a secondary sort by document and position, so a key that a third of all
documents hold is spread over many ranges.  Each range streams its rows and
marks the first occurrence of a key in a document; per key, the marks are
counted with partial aggregation.  The result is one compressed keep bitmap
per document (the runs of kept lines) instead of text.

Edge cases: a null or empty text is one empty line.  Rows that share a
``doc_id`` count as one document; each row is returned with its own bitmap,
and exact repeats get the same.  Rows with a null id count as one document
that precedes all others.  Lines are only compared by key, so ties do not
arise; within the keeping document all lines of a key stay.  Other columns of
the input are not read by ``line_keep_bitmaps`` and pass through
``drop_repeated_lines`` whatever their names.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, col, fresh, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _version(text: Column) -> Column:
    """Tells apart rows of one id whose texts differ."""
    return F.xxhash64(F.lit(0), text)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, version, places): per document that loses lines, their sorted positions.

    A key of at least ``min_chars`` code points held by ``min_docs`` or more
    documents keeps its lines only in the largest id."""
    rows = docs.select(col(id_col).alias("doc"), _version(col(text_col)).alias("version"),
                       F.posexplode(_lines(col(text_col))).alias("place", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).filter(
        F.length("key") >= min_chars)
    # written before it is dealt: sampling the range bounds then reads hashes,
    # not the texts again
    rows = written(rows.select(F.xxhash64("key").alias("h1"),
                               F.xxhash64(F.lit(1), "key").alias("h2"),
                               "doc", "version", "place"), "line-hashes")
    # the window needs no exchange of its own: ranges of (h1, h2, doc) cluster it
    stream = Window.partitionBy("h1", "h2", "doc").orderBy("version", "place")
    marked = written(
        rows.repartitionByRange("h1", "h2", "doc")
        .withColumn("first", (F.row_number().over(stream) == 1).cast("long")), "line-marks")
    # written, so that both sides of the join are plain exchanges, of which the
    # rows of a frequent key are split over tasks
    shared = written(marked.groupBy("h1", "h2")
                     .agg(F.sum("first").alias("n"), F.max("doc").alias("keeper"))
                     .filter(F.col("n") >= min_docs).drop("n"), "line-keys")
    gone = marked.join(shared, ["h1", "h2"]).filter(
        F.col("doc").isNull() | (F.col("doc") < F.col("keeper")))
    return gone.groupBy("doc", "version").agg(
        F.sort_array(F.collect_set("place")).alias("places"))


def _with_runs(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int):
    gone = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    n, p, r, ls = (fresh(docs, x) for x in ("__l_n", "__l_places", "__l_runs", "__l_lines"))
    v, gd, gv = (fresh(docs, x) for x in ("__l_version", "__l_doc", "__l_gone_version"))
    gone = gone.select(F.col("doc").alias(gd), F.col("version").alias(gv),
                       F.col("places").alias(p))
    df = docs.withColumn(v, _version(col(text_col)))
    df = df.join(gone, df[f"`{id_col}`"].eqNullSafe(gone[gd]) & (df[v] == gone[gv]), "left")
    df = df.drop(v, gd, gv).withColumn(p, F.coalesce(F.col(p), F.array().cast("array<int>")))
    # a column of its own: it is read by every run's slice
    df = df.withColumn(ls, _lines(col(text_col))).withColumn(n, F.size(F.col(ls)))
    at = F.col(p)
    # the runs between one dropped line and the next
    runs = F.filter(
        F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.struct(
            (F.coalesce(F.get(at, k - 1), F.lit(-1)) + 1).alias("start"),
            (F.coalesce(F.get(at, k), F.col(n)) - F.coalesce(F.get(at, k - 1), F.lit(-1)) - 1
             ).alias("length"))),
        lambda x: x["length"] > 0)
    return df.withColumn(r, runs), n, p, r, ls


def kept_text(lines: Column, runs: Column) -> Column:
    """The text that a keep bitmap leaves of a column of lines."""
    return F.array_join(F.flatten(F.transform(
        runs, lambda x: F.slice(lines, x["start"] + 1, x["length"]))), "\n")


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = 20, min_docs: int = 3,
                      with_text: bool = False) -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_dropped`` and ``keep_runs``,
    the run-length coded bitmap (start and length of each run of kept lines).
    ``with_text`` adds ``kept``, the lines that stay."""
    df, n, p, r, ls = _with_runs(docs.select(col(id_col), col(text_col)), id_col, text_col,
                             min_chars, min_docs)
    out = [col(id_col), F.col(n).cast("long").alias("n_lines"),
           F.size(p).cast("long").alias("n_dropped"), F.col(r).alias("keep_runs")]
    if with_text:
        out.append(F.when(F.size(p) == 0, F.coalesce(col(text_col), F.lit(""))).otherwise(
            kept_text(F.col(ls), F.col(r))).alias("kept"))
    return df.select(*out)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the bitmaps applied to the text; texts that lose nothing,
    nulls included, stay as they are."""
    df, _, p, r, ls = _with_runs(docs, id_col, text_col, min_chars, min_docs)
    text = F.when(F.size(p) == 0, col(text_col)).otherwise(kept_text(F.col(ls), F.col(r)))
    return df.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns])
