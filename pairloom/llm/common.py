"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import types
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 1024
#: Entries in a word memo of one Python worker; beyond it, words are hashed anew each time.
MEMO_LIMIT = 400_000

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Sets Arrow's batch size to what whole documents need."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 0 modulo 5; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a single-machine session may go without one and gets its own."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        root = sc.getCheckpointDir()
    return root


_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing.

    Once the table stands, the shuffle files that led to it go. The table itself stays until
    ``discard`` or until the driver's Python exits, as the returned frame is read lazily.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairloom_path = path
    return out


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def discard(*frames: DataFrame) -> None:
    """Removes tables that ``written`` returned; nothing may read them any more."""
    for frame in frames:
        _remove(frame._pairloom_path)


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def process_cache(name: str, make):
    """An object that lives as long as the Python worker, shared by its tasks."""
    store = sys.modules.setdefault("_pairloom_process_cache", types.ModuleType("_pairloom_process_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO_LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_memo() -> WordHashes:
    return process_cache("words", WordHashes)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows outside the held-out fold, by smallest id hash.

    ``max_rows`` bounds what is broadcast and learned. Rows with a null id or label are left
    out; of rows that repeat an id the smallest label and the smallest text count.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
