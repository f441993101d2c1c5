"""Document fingerprints: Lempel-Ziv phrases under minimum-hash signatures.

A document's UTF-8 bytes are parsed into LZ78 phrases (each the longest phrase known so far
and one more byte); phrases are hashed, and the ``SIZE`` smallest distinct hashes are the
fingerprint. The likeness of two fingerprints is the share of common hashes among the
``SIZE`` smallest of their union, an estimate of the phrase sets' Jaccard index that is
exact where a union has no more than ``SIZE`` phrases.

Edge cases: an empty or null text has the empty fingerprint; two empty fingerprints have
likeness 1, an empty and another one 0; equal texts have equal fingerprints; repeated ids are
ordered by their text; a null id comes last in descending order; a single document is its own
next one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import mixed

SIZE = 128
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
Parse = tuple[list[int], dict[int, int], int]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables = [_powers(_POWER, 1 << 12), _powers(_INVERSE, 1 << 12)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) <= n:
        size = 1 << int(n).bit_length()
        _tables[:] = [_powers(_POWER, size), _powers(_INVERSE, size)]
    return _tables[0], _tables[1]


def parse(data: bytes, known: dict[int, int] | None = None, cuts: list[int] | None = None, start: int = 0) -> tuple[list[int], dict[int, int]]:
    """Ends of the phrases of ``data`` from ``start`` on, and the phrase tree (node * 256 + byte: node)."""
    known, cuts = {} if known is None else known, [] if cuts is None else cuts
    get, done, node, new = known.get, cuts.append, 0, (len(known) + 1) << 8
    for i, byte in enumerate(data[start:] if start else data, start + 1):
        found = get(node | byte)
        if found is None:
            known[node | byte] = new
            new += 256
            node = 0
            done(i)
        else:
            node = found
    if node:  # the last phrase repeats a known one
        done(len(data))
    return cuts, known


def phrase_hashes(data: bytes, cuts: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases that end at ``cuts``, from prefix sums of a polynomial."""
    if not cuts:
        return np.zeros(0, np.uint32)
    up, down = _grown(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    ends = np.asarray(cuts)
    begins = np.concatenate([[0], ends[:-1]])
    return (mixed((prefix[ends] - prefix[begins]) * down[begins]) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:SIZE]


def fingerprint(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "replace")
    return signature(phrase_hashes(data, parse(data)[0]))


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def edited_signature(data: bytes, cuts: list[int], known: dict[int, int], changed: bytes, kept: int) -> np.ndarray:
    """The fingerprint of ``changed``, which shares ``data``'s first ``kept`` bytes and so the phrases that end there."""
    shared = [c for c in cuts if c <= kept]
    if shared and shared[-1] == len(data):  # the closing phrase may repeat a known one
        shared.pop()
    first = dict(islice(known.items(), len(shared)))  # each phrase but the closing one added one entry
    return signature(phrase_hashes(changed, parse(changed, first, shared, shared[-1] if shared else 0)[0]))


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, doc_id, text, head): ids descending by bucket, each bucket followed by the next one's first row (head true).

    Bucket bounds are quantiles of the ids; only those and each bucket's largest id, one row a
    bucket, are gathered, so neighbours meet without a global sort in one task.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    cuts = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000).alias("q")).first().q or []
    cuts = sorted({*cuts})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.size(F.filter(bounds, lambda c: c < key))  # larger ids, higher buckets
    rows = rows.withColumn("bucket", bucket)
    top = rows.groupBy("bucket").agg(F.max(F.struct(key.alias("k"), F.xxhash64("text").alias("h"))).alias("top"))
    above = Window.orderBy("bucket")  # one row a bucket
    top = top.select("bucket", "top.*", F.coalesce(F.lead("bucket").over(above), F.first("bucket").over(above.rowsBetween(Window.unboundedPreceding, 0))).alias("follows"))
    joined = rows.join(F.broadcast(top), "bucket", "left")
    heads = joined.filter((key == F.col("k")) & (F.xxhash64("text") == F.col("h"))).dropDuplicates(["bucket", "k", "h"])
    both = rows.select("bucket", "doc_id", "text", F.lit(False).alias("head")).unionByName(heads.select(F.col("follows").alias("bucket"), "doc_id", "text", F.lit(True).alias("head")))
    return both.repartitionByRange(parts, F.col("bucket")).sortWithinPartitions("bucket", "head", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, out = None, []
        for b in batches:
            for bucket, doc_id, text, head in zip(b.bucket, b.doc_id, b.text, b["head"]):
                data = text.encode("utf-8", "replace")
                cuts, known = parse(data)
                now = (bucket, doc_id, text, data, cuts, signature(phrase_hashes(data, cuts)), known)
                if before is not None and before[0] == bucket:
                    out.append(_row(before, now))
                before = None if head else now
                if len(out) >= 512:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
        yield pd.DataFrame(out, columns=COLUMNS)

    return in_order(docs, parts).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        walk, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(now: tuple, following: tuple) -> tuple:
    _, doc_id, text, data, cuts, sig, known = now
    third = len(text) // 3
    kept = text[: len(text) - third]
    changed = (kept + following[2][:third]).encode("utf-8", "replace")
    new = edited_signature(data, cuts, known, changed, len(kept.encode("utf-8", "replace")))
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), shown(sig), shown(new), likeness(sig, new), likeness(sig, following[5])
