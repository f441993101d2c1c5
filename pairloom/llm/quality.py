"""Quality: nearest-neighbour voting among latent-semantic vectors.

A document's terms are its hashed words and, as further terms of the same vocabulary, the
repetition patterns of each four words in a row (which neighbours are equal, and whether any
others are). Term frequencies per thousand enter by their logarithm, weighted by idf; a truncated SVD
fitted on a bounded sample of labelled rows (``KnnParams.max_rows``) projects them, so that
a document is its latent-semantic vector and nothing else. The labelled vectors are broadcast
(max_rows x rank floats); each batch of documents takes exact cosine products with all of them
in one blocked product, and the nearest labels vote with their similarity as weight.

Edge cases: a null or empty text has the zero vector, all cosines are 0 and it scores the
share of good labels; without labelled rows each score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import MEMO_LIMIT, labelled_sample, process_cache

WORD_BITS, PATTERNS = 12, 16
TERMS = (1 << WORD_BITS) + PATTERNS


@dataclass(frozen=True)
class KnnParams:
    max_rows: int = 4000
    rank: int = 64
    neighbours: int = 25
    power: float = 8.0


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    params: KnnParams


class _Words(dict):
    """Memo from a word to the hash of its lower case."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh32_intdigest(word.lower().encode("utf-8", "replace"))
        if len(self) < MEMO_LIMIT:
            self[word] = value
        return value


def counts(text: str | None) -> np.ndarray:
    """How often each term stands in a text."""
    words = text.split() if text else []
    h = np.fromiter(map(process_cache("quality words", _Words).__getitem__, words), np.int64, len(words))
    tf = np.zeros(TERMS, np.float32)
    tf[:-PATTERNS] = np.bincount(h >> (32 - WORD_BITS), minlength=1 << WORD_BITS)
    if len(h) >= 4:
        a, b, c, d = h[:-3], h[1:-2], h[2:-1], h[3:]
        pattern = (a == b) + 2 * (b == c) + 4 * (c == d) + 8 * ((a == c) | (b == d) | (a == d))
        tf[-PATTERNS:] = np.bincount(pattern, minlength=PATTERNS)
    return tf


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(tf: np.ndarray) -> np.ndarray:
    return np.log1p(tf * (1000 / np.maximum(tf.sum(axis=1, keepdims=True), 1)))


def embed(texts, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent-semantic vectors as rows; zero where there are no words."""
    x = _weighted(np.stack([counts(t) for t in texts]))
    return _unit(_unit(x * idf) @ basis).astype(np.float32)


def fit_arrays(texts: list[str], labels: np.ndarray, p: KnnParams) -> QualityModel:
    x = _weighted(np.stack([counts(t) for t in texts])) if texts else np.zeros((0, TERMS), np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(x * idf)
    rng = np.random.default_rng(11)
    q = rng.standard_normal((TERMS, min(p.rank, max(1, len(x))))).astype(np.float32)
    for _ in range(6):  # subspace iteration towards the leading right singular vectors
        q, _ = np.linalg.qr(x.T @ (x @ q))
    q = q.astype(np.float32)
    return QualityModel(idf, q, _unit(x @ q).astype(np.float32), labels.astype(np.float32), p)


def vote(x: np.ndarray, model: QualityModel, block: int = 256) -> np.ndarray:
    p, m = model.params, len(model.labels)
    if not m:
        return np.full(len(x), 0.5)
    k, prior, out = min(p.neighbours, m), float(model.labels.mean()), np.empty(len(x))
    for s in range(0, len(x), block):
        cos = x[s : s + block] @ model.vectors.T
        at = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < m else np.tile(np.arange(m), (len(cos), 1))
        w = np.maximum(np.take_along_axis(cos, at, 1), 0).astype(np.float64) ** p.power
        total = w.sum(axis=1)
        out[s : s + block] = np.where(total > 1e-12, (w * model.labels[at]).sum(axis=1) / np.maximum(total, 1e-12), prior)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, params: KnnParams = KnnParams()) -> QualityModel:
    """Fits in one task over the bounded sample and returns arrays of a size that the parameters fix."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(d), int(y), t or "") for b in batches for d, t, y in zip(b.doc_id, b.text, b.label))
        m = fit_arrays([t for _, _, t in rows], np.array([y for _, y, _ in rows], np.float32), params)
        parts = {"idf": m.idf, "basis": m.basis, "vectors": m.vectors, "labels": m.labels}
        yield pd.DataFrame([(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in parts.items()], columns=["part", "shape", "data"])

    sample = labelled_sample(docs, labels, "quality", params.max_rows).select("doc_id", "text", "label")
    out = sample.repartition(1).mapInPandas(learn, "part string, shape array<int>, data binary").collect()
    got = {r.part: np.frombuffer(bytes(r.data), np.float32).reshape(r.shape) for r in out}
    return QualityModel(got["idf"], got["basis"], got["vectors"], got["labels"], params)


def scorer(model: QualityModel, spark):
    """A column function from text to the share of good votes."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        m = shared.value
        out = [vote(embed(texts[s : s + 256], m.idf, m.basis), m) for s in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return quality
