"""Token-id output as ORC: run-length encoded integers, row indexes, and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, so files, stripes and row groups hold
ascending ids: a reader prunes them by the min/max row index, tests the Bloom filter for
single ids, and reads stripes in parallel. ``start`` positions are not stored: they follow
from a running sum over the files' totals (one row per file) and within each file.

Edge cases: a null or empty text has the end id alone; an empty table writes no rows; rows that
repeat an id stay separate, ordered by the digest of their token ids; a null id sorts first; extra columns
are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm import encode
from pairloom.llm.common import temporary

SCHEMA = "doc_id long, n_tokens int, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "5000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD",
}


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "lowered") -> DataFrame:
    """(doc_id, n_tokens, ids) of each document, the end id included; keeps the rows' order."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encode.encoder(tokenizer_path, kind)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                ids = [x + end for x in found([t or "" for t in part.column(1).to_pylist()])]
                n = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ids_of, SCHEMA)


def parts_of(docs: DataFrame, megabytes: int = 128) -> int:
    """Files for ``docs``: as many as shuffles have, or more if the plan's size estimate asks for it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # a plan without statistics claims the largest number there is
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (megabytes << 20) if known else 0)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, kind: str = "lowered") -> None:
    """Writes ``docs`` in ascending id order."""
    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(parts_of(rows), "doc_id").sortWithinPartitions("doc_id")
    encoded(ordered, tokenizer_path, end_id, kind).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows."""
    return spark.read.schema(SCHEMA).orc(path)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files. Block totals read the stored counts alone; ids are read once."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])), np.int64, len(lists))
            n = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n), pa.array(crc)], names=["doc_id", "file", "block", "n_tokens", "ids_crc32"])

    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = read(spark, path).select("doc_id", "ids", *place).mapInArrow(digest, "doc_id long, file string, block long, n_tokens long, ids_crc32 long")
    # One row per file block: as many as read tasks, which is what the broadcast holds.
    blocks = read(spark, path).select("doc_id", "n_tokens", *place).groupBy("file", "block").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    order = Window.orderBy((F.col("nulls") == 0).asc(), F.col("low").asc_nulls_first(), "file", "block").rowsBetween(Window.unboundedPreceding, 0)
    before = blocks.select("file", "block", (F.sum("total").over(order) - F.col("total")).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(before), ["file", "block"]).select(
        "doc_id", (F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_path(spark: SparkSession) -> str:
    """A folder for token files beside the shared ones; it goes when the driver's Python exits."""
    return temporary(spark, "tokens.orc")
