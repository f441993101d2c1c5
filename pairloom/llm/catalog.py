"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, html_extract, langid, line_dedup, lz_fingerprint, minhash, packing, quality, tokens_orc, toxicity
from pairloom.llm.common import held_out, read_table, tuned


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(tuned(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(tuned(spark), sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(tuned(spark), sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    score = quality.scorer(quality.fit(docs, labels), spark)
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens_orc.new_path(tuned(spark))
    tokens_orc.write(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokens_orc.positions(spark, path)


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(read_table(tuned(spark), sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(tuned(spark), sf_dir, "pages")
    main_text = html_extract.extractor(html_extract.train(), spark)
    return pages.select("page_id", "url", main_text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(tuned(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, limit=1024)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "lines_removed")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(tuned(spark), sf_dir, "documents")
    found = docs.select("doc_id", decontaminate.hits(docs, read_table(spark, sf_dir, "benchmark")).alias("item_ids"))
    return found.select("doc_id", "item_ids", (F.size("item_ids") > 0).alias("contaminated"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(tuned(spark), sf_dir, "documents")
    language = langid.predictor(langid.fit(docs), spark)
    found = docs.select("doc_id", held_out().alias("held_out"), language("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_minhash, op3_quality, op4_orc_tokens, op5_lz_fingerprint, op6_html, op7_packing, op8_line_dedup, op9_decontaminate, op10_language)
}
#: No query of this subpackage is plain SQL; tests use brute force (op2), direct computation, round trips, planted passages or held-out rows.
ORACLES: dict[str, str] = {}
