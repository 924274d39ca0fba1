"""A training corpus from raw documents: quality rules, line dedup, SimHash
near-dedup, benchmark decontamination, best-fit packing.

Each stage takes the documents that its predecessor kept and returns
documents; the last returns one row per packed piece.

Edge cases: documents of null, empty or blank text have too few words and go in the
first stage; very long texts are judged whole.  Rows without an id count as one
document before all others for repeated lines, and come last among near-duplicates;
of exactly repeated rows one stays.  An empty table gives an empty result; an empty
benchmark cuts nothing.  Extra columns pass through all stages but the last, whatever
their names; ``n_chars`` is counted anew where it may have changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelrisk.llm import decontaminate, line_dedup, packing, quality, simhash
from parcelrisk.llm.common import delete, scratch, scratch_scope, table
from parcelrisk.llm.queries import WORD_BPE, tokenizer_file


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage may have shortened."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules (50 words, not mostly repeats) and the
    threshold table."""
    return quality.keep_documents(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them."""
    return _recounted(line_dedup.drop_repeated_lines(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one_per_group(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such go."""
    return _recounted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths, with every document's pieces in them."""
    return packing.pack_documents(docs, tokenizer_file(WORD_BPE))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and token counts are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again.  What a stage
    wrote on the way is deleted when it is done, its result when the next one is;
    the last stage's tables stay, as the result reads them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            done = stage(spark, docs, sf_dir)
            done.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
