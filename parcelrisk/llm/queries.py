"""The queries ``opN_<name>`` over the benchmark tables, and their SQL.

Each query applies its operator with production parameters to the whole
table; where a contract fixes digest columns, they are derived here from the
operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation, decontaminate, embeddings, license_scan, line_dedup, packing, periodic,
               quality, secret_scan, simhash, token_ids, unigram, url_filter)
from .common import scratch, table
from .sql import OP3_SQL, OP8_SQL, OP9_SQL

END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


@query("op9_quality_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.quality_measures(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept")


@query("op8_line_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = line_dedup.line_keep_bitmaps(table(spark, sf_dir, "documents"), with_text=True)
    return b.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_scan.secret_spans(table(spark, sf_dir, "documents"))

    def count(ord_: int):
        return F.size(F.filter("spans", lambda x: x["ord"] == ord_)).cast("long")

    base = F.filter("spans", lambda x: x["ord"] < 3)
    return s.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
                    count(2).alias("n_hex"),
                    F.sha2(secret_scan.span_string(base), 256).alias("base_sha256"),
                    secret_scan.span_string(F.col("spans")).alias("spans"))


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id")


@query("op3_decontaminate", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "benchmark"))
    return h.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_token_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_ids.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file(WORD_BPE), END_ID)
    d = token_ids.read_token_files(spark, path)
    return d.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filter.mine_rules(url_filter.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge_urls(pages, rules)


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the licenses found: the best, its score, and all names."""
    d = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    d = d.select("doc_id", F.concat("hits", "passages").alias("hits"))
    best = F.array_min(F.transform("hits", lambda h: F.struct(
        (-h["dice"]).alias("d"), h["license"].alias("license"))))
    return d.select(
        "doc_id", F.size("hits").cast("long").alias("n_hits"), best["license"].alias("license"),
        (-best["d"]).alias("dice"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(
            "hits", lambda h: h["license"]))), ",").alias("licenses"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.unigram_token_counts(docs, tokenizer_file(PIECES))


@query("op11_embedding_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic.periodic_runs(periodic.rewritten_periodically(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    d = d.withColumn("best", best).withColumn("length", -F.col("best.shorter"))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        "length", F.col("best.period").alias("period"),
        F.floor(1000 * F.col("length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report = conversation.repair_report(conversation.damaged(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct()
    d = every.join(report, every["conv_id"].eqNullSafe(report["c"]), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return d.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
