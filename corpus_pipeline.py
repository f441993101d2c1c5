"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, line_dedup, minhash, packing, toxicity
from pairloom.llm.common import read_table, tuned, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half; the learner sees labelled rows of ``docs`` only.

    Null and empty texts score by the intercept; without labels all scores are 0.5 or more and
    every document would go, so none does; repeated rows fare alike; all columns pass through.
    """
    tuned(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(docs, model) < 0.5) if len(model.index) else docs


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines cut out; n_chars, where there is such a column, follows the text.

    A document of which nothing but blanks stays goes; any other keeps what is its own. Null
    and empty texts stay; rows that repeat id and text are one occurrence; all other columns
    pass through, whatever their names.
    """
    out = line_dedup.deduplicated(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    nothing = (F.col("lines_removed") > 0) & (F.trim(F.col("text"), F.lit(" \t\r\n")) == "")
    out = out.filter(~F.coalesce(nothing, F.lit(False)))
    changed = F.col("lines_removed") > 0
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest doc_id.

    Texts without words, and rows without an id, are linked with nothing and stay; rows that
    share an id are one document; all columns pass through.
    """
    tuned(spark)
    gone = minhash.near_duplicates(docs).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay, as does everything if there are no items."""
    tuned(spark)
    return docs.filter(F.size(decontaminate.hits(docs, read_table(spark, sf_dir, "benchmark"))) == 0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, limit=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained scores, MinHash and a tokenizer are beyond SQL; tests compare each stage's operator with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
