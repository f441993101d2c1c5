"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 give sparse weights, which are broadcast. The learner
sees a bounded sample of labelled rows (``FtrlParams.max_rows``); scoring covers every row.

Edge cases: a null or empty text scores the intercept alone; without any labelled row all
weights are zero and every score is 0.5; repeated rows score alike; other columns, whatever
their names, are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import MEMO_LIMIT, labelled_sample, process_cache


@dataclass(frozen=True)
class FtrlParams:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 12
    bits: int = 18
    max_rows: int = 10_000


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float
    index: np.ndarray
    weight: np.ndarray
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


_NOT_WORD = re.compile(r"[^\w]+")


def plain_words(text: str | None) -> list[str]:
    """Lower-cased words: runs of letters, digits and underscores."""
    return _NOT_WORD.sub(" ", text.lower()).split() if text else []


class _Grams(dict):
    """Memo from a word to eight 32-bit hashes: the word, its beginnings of 3 to 8 characters, its ending."""

    def __missing__(self, word: str) -> bytes:
        parts = [word, *(word[:n] + "-" for n in range(3, 9)), "-" + word[-5:]]
        value = b"".join(xxhash.xxh32_digest(x.encode("utf-8", "replace")) for x in parts)
        if len(self) < MEMO_LIMIT:
            self[word] = value
        return value


def grams(text: str | None, bits: int) -> np.ndarray:
    """Slots, with repeats, of a text's words, their beginnings and endings, word pairs, and pairs that skip one or two words."""
    words = plain_words(text)
    if not words:
        return np.zeros(0, np.int64)
    memo = process_cache("grams", _Grams)
    h = np.frombuffer(b"".join(map(memo.__getitem__, words)), ">u4").reshape(-1, 8).astype(np.uint32)
    left, right = h[:, 0] * np.uint32(0x9E3779B1), h[:, 0] * np.uint32(0x85EBCA77)
    pairs = [(left[:-gap] ^ (right[gap:] + np.uint32(gap))) * np.uint32(0xC2B2AE3D) for gap in (1, 2, 3) if len(h) > gap]
    return (np.concatenate([h.ravel(), *pairs]) >> np.uint32(32 - bits)).astype(np.int64)


def gram_slots(text: str | None, bits: int) -> np.ndarray:
    """The distinct slots."""
    return np.unique(grams(text, bits))


def margin(text: str | None, weight: np.ndarray, bits: int) -> float:
    """Sum of weights over the distinct slots; only slots that have a weight are sorted."""
    slots = grams(text, bits)
    return float(weight[np.unique(slots[weight[slots] != 0])].sum())


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, int]], p: FtrlParams) -> tuple[float, np.ndarray]:
    """Intercept and dense weights. Coordinate 2**bits is the intercept, which has no L1."""
    size = (1 << p.bits) + 1
    z, root = np.zeros(size), np.zeros(size)  # root: square root of the summed squared gradients
    last = size - 1
    l1 = np.full(size, p.l1)
    l1[last] = 0.0

    def weights(z: np.ndarray, root: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return (np.clip(z, -l1, l1) - z) / ((p.beta + root) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for slots, label in rows:
            at = np.append(slots, last)
            z_at, before = z[at], root[at]
            w = weights(z_at, before, l1[at])
            g = sigmoid(w.sum()) - label
            after = np.sqrt(before * before + g * g)
            z[at] = z_at + g - (after - before) / p.alpha * w
            root[at] = after
    w = weights(z, root, l1)
    return float(w[last]), w[:last]


def fit(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> ToxicityModel:
    """Learns from the bounded sample in one task; only nonzero weights return to the driver."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(d), int(y), t or "") for b in batches for d, t, y in zip(b.doc_id, b.text, b.label))
        order = np.random.default_rng(7).permutation(len(rows))
        b, w = ftrl([(gram_slots(rows[i][2], params.bits), rows[i][1]) for i in order], params)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.append(at, -1), "weight": np.append(w[at], b)})

    sample = labelled_sample(docs, labels, "toxic", params.max_rows).select("doc_id", "text", "label")
    out = sample.repartition(1).mapInPandas(learn, "slot long, weight double").toPandas()
    slots, weight = out.slot.to_numpy(np.int64), out.weight.to_numpy(np.float64)
    at = slots >= 0
    return ToxicityModel(float(weight[~at].sum()), slots[at], weight[at].astype(np.float32), params.bits)


def scorer(model: ToxicityModel, spark):
    """A column function from text to P(toxic)."""
    shared = spark.sparkContext.broadcast((model.intercept, model.dense(), model.bits))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        intercept, weight, bits = shared.value
        raw = [intercept + margin(t, weight, bits) for t in texts]
        return pd.Series(sigmoid(np.asarray(raw, np.float64)))

    return toxicity


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    return scorer(model, docs.sparkSession)(F.col(text))
