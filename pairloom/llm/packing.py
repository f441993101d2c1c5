"""Packing: shortest-pack-first over the histogram of lengths.

Each document's ids are cut into full pieces of the limit and a rest. Rests go through a
histogram (at most ``limit`` lengths), on which the driver places lengths longest first, each
count into the packing patterns with the most room, updating the patterns' counts. Slots of
patterns are ranges of ranks within a length; documents get their rank within their length by
a two-level count and are joined to the slots, so no task ever sees all rows. Sequences are
padded to the limit, except one whose filled length is a power of two.

Edge cases: a null or empty text is its end id alone; an empty table gives no pieces; repeated
ids with equal texts stay separate documents; a null id packs like any other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm import encode
from pairloom.llm.common import written

#: Parts that pieces of one length are dealt to for ranking: of a rest's length, and of the full length, the bulk of all pieces.
SALTS, FULL_SALTS = 64, 1 << 14


@dataclass(frozen=True)
class Slots:
    """Parallel arrays: ranks [low, low + count) of ``length`` go to sequences ``sequence`` + i at ``offset``."""

    length: np.ndarray
    low: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placement) with counts. Longest lengths first; each goes to the shortest packs that exist."""
    room: dict[int, Counter] = {}  # space left: patterns with their counts
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in room if s >= length), default=None)
            if space is None:
                room.setdefault(limit - length, Counter())[(length,)] += left
                left = 0
                continue
            pattern, n = max(room[space].items(), key=lambda x: (x[1], x[0]))
            used = min(n, left)
            if used == n:
                del room[space][pattern]
                if not room[space]:
                    del room[space]
            else:
                room[space][pattern] -= used
            room.setdefault(space - length, Counter())[pattern + (length,)] += used
            left -= used
    return sorted(((p, n) for c in room.values() for p, n in c.items()), key=lambda x: (sum(x[0]), x[0]))


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> Slots:
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, ranks[length], n, sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Slots(*cols, sequence)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int, kind: str = "spaced") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, salt); salt spreads equal lengths."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encode.encoder(tokenizer_path, kind)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [x + end for x in found([t or "" for t in batch.column(1).to_pylist()])]
            at, start, length, crc, total = [], [], [], [], []
            for i, x in enumerate(ids):
                n = len(x) // 4
                for s in range(0, n, limit):
                    at.append(i)
                    start.append(s)
                    length.append(min(limit, n - s))
                    crc.append(zlib.crc32(x[4 * s : 4 * (s + limit)]))
                    total.append(n)
            arrays = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    salts = F.when(F.col("length") == limit, F.lit(FULL_SALTS)).otherwise(F.lit(SALTS))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts))


def pack(cut: DataFrame, limit: int) -> DataFrame:
    """``cut`` must be a stored table: it is read three times. Adds sequence_id and offset."""
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    slots = slots_of(shortest_pack_first(histogram, limit))
    across = Window.partitionBy("length").orderBy("salt")  # at most FULL_SALTS rows a length
    before = counts.select("length", "salt", (F.sum("n").over(across) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(before), ["length", "salt"])  # limit x SALTS + FULL_SALTS rows at most
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    shared = cut.sparkSession.sparkContext.broadcast(slots)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = shared.value
        size = int(s.low.max(initial=0) + s.count.max(initial=0)) + 1
        i = np.searchsorted(s.length * size + s.low, length.to_numpy() * size + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": s.sequence[i] + rank.to_numpy() - s.low[i], "offset": s.offset[i]})

    found = ranked.withColumn("at", placed("length", "rank"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int = 1024, kind: str = "spaced") -> DataFrame:
    return pack(written(pieces(docs, tokenizer_path, end_id, limit, kind), "pieces"), limit)
