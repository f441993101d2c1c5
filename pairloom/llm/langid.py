"""Language identification: prediction by partial matching over bytes.

Each language has its own context tree of orders one to three over all 256 byte values, learned
from a bounded sample (``PpmParams.docs_per_language``) and then frozen; it holds every context
that the sample shows ``min_context_count`` times, so its size is bounded by the sample's. Method
C supplies escape probabilities: in a context with n symbols seen, d of them distinct, a symbol seen there
c times has c / (n + d); any other one has the escape's d / (n + d) times its probability in the
next shorter context, down to a uniform byte. As statistics are frozen, the exact code length
of a byte depends only on its deepest tree node, so one table (node x byte) a language holds
all of them and a text is scored by table look-ups. Bytes that no language's sample shows have equal
statistics everywhere and share a column.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the
first language by name; without learned languages everything is ``und``; null languages are
never learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import held_out

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class PpmParams:
    docs_per_language: int = 300
    min_context_count: int = 40


@dataclass(frozen=True)
class Tree:
    """``row`` maps the last two bytes to a row of ``node``, which maps that row and the byte before to a line of ``cost`` (bits)."""

    row: np.ndarray
    node: np.ndarray
    cost: np.ndarray


@dataclass(frozen=True)
class PpmModel:
    languages: list[str]
    byte_class: np.ndarray
    classes: int
    trees: list[Tree]


def _escaped(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """P(symbol | context) from counts (contexts x symbols) and the shorter contexts' probabilities."""
    n, d = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    return np.where(n > 0, np.where(counts > 0, counts, d * shorter) / np.maximum(n + d, 1), shorter)


def _counted(contexts: np.ndarray, keep: np.ndarray, symbols: np.ndarray, n: np.ndarray, a: int) -> np.ndarray:
    """Counts of the symbols after each context in ``keep`` (sorted)."""
    at = np.searchsorted(keep, contexts)
    here = (at < len(keep)) & (keep[np.minimum(at, max(0, len(keep) - 1))] == contexts) if len(keep) else np.zeros(len(contexts), bool)
    return np.bincount(at[here] * a + symbols[here], weights=n[here], minlength=len(keep) * a).reshape(len(keep), a)


def _tree(texts: list[bytes], byte_class: np.ndarray, a: int, least: int) -> Tree:
    start, codes = a - 1, [np.zeros(0, np.int64)]
    for t in texts:
        c = np.concatenate([np.full(3, start), byte_class[np.frombuffer(t, np.uint8)]]).astype(np.int64)
        codes.append(((c[:-3] * a + c[1:-2]) * a + c[2:-1]) * a + c[3:])
    grams, n = np.unique(np.concatenate(codes), return_counts=True)
    n, symbols, c1, c2, c3 = n.astype(float), grams % a, grams // a % a, grams // a % a**2, grams // a

    def often(contexts):
        found, inverse = np.unique(contexts, return_inverse=True)
        return found[np.bincount(inverse, weights=n, minlength=len(found)) >= least] if len(found) else found

    k2, k3 = often(c2), often(c3)
    members = np.bincount(byte_class, minlength=a)
    uniform = members[None, :] / 256
    p0 = _escaped(np.bincount(symbols, weights=n, minlength=a)[None, :], uniform)
    p1 = _escaped(_counted(c1, np.arange(a), symbols, n, a), p0)
    p2 = _escaped(_counted(c2, k2, symbols, n, a), p1[k2 % a])
    p3 = _escaped(_counted(c3, k3, symbols, n, a), p2[np.searchsorted(k2, k3 % a**2)])
    row = np.tile(np.arange(a), a)
    row[k2] = a + np.arange(len(k2))
    node = np.repeat(np.arange(a + len(k2)), a).reshape(-1, a)
    node[row[k3 % a**2], k3 // a**2] = a + len(k2) + np.arange(len(k3))
    bits = -np.log2(np.maximum(np.vstack([p1, p2, p3]), 1e-30)) + np.log2(np.maximum(members, 1))
    return Tree(row.astype(np.int32), node.ravel().astype(np.int32), bits.ravel().astype(np.float32))


def train(samples: dict[str, list[bytes]], params: PpmParams = PpmParams()) -> PpmModel:
    languages = sorted(samples)
    seen = sum((np.bincount(np.frombuffer(t, np.uint8), minlength=256) for ts in samples.values() for t in ts), np.zeros(256, np.int64))
    common = np.flatnonzero(seen)
    byte_class = np.full(256, len(common), np.int32)  # the class of unseen bytes; one more stands before a text's start
    byte_class[common] = np.arange(len(common))
    a = len(common) + 2
    return PpmModel(languages, byte_class, a, [_tree(samples[x], byte_class, a, params.min_context_count) for x in languages])


def code_lengths(texts: list[bytes], model: PpmModel) -> np.ndarray:
    """Bits per text and language."""
    a, out = model.classes, np.zeros((len(texts), max(1, len(model.trees))))
    at, size = 0, 0
    for end in range(len(texts) + 1):
        if end < len(texts) and size < 400_000:
            size += len(texts[end])
            continue
        group = texts[at:end]
        lengths = np.array([len(t) for t in group], np.int64)
        c = model.byte_class[np.frombuffer(b"".join(group), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        before = np.full((3, len(c)), a - 1, np.int32)
        for k in (1, 2, 3):
            before[k - 1, k:] = c[: max(0, len(c) - k)]
            for j in range(k):  # contexts do not reach into the text before
                before[k - 1, (starts + j)[lengths > j]] = a - 1
        two, some = before[1] * a + before[0], lengths > 0
        for x, tree in enumerate(model.trees if some.any() else []):
            bits = tree.cost[tree.node[tree.row[two] * a + before[2]] * a + c]
            out[at:end, x][some] = np.add.reduceat(bits, starts[some], dtype=np.float64)
        at, size = end, len(texts[end]) if end < len(texts) else 0
    return out


def fit(docs: DataFrame, params: PpmParams = PpmParams()) -> PpmModel:
    """Learns from about ``docs_per_language`` rows of each language, chosen by id hash, never from the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not share:
        return train({}, params)
    scale = 1 << 30
    at_most = F.create_map(*[x for r in share for x in (F.lit(r.lang), F.lit(int(min(1.0, params.docs_per_language / r.n) * scale)))])
    rows = rows.withColumn("place", F.xxhash64("doc_id")).filter(F.pmod("place", F.lit(scale)) < at_most[F.col("lang")])
    chosen = rows.orderBy("place", "doc_id", "lang", "text").limit(2 * params.docs_per_language * len(share)).select("doc_id", "text", "lang")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[tuple[int, bytes]]] = {}
        for b in batches:
            for d, t, lang in zip(b.doc_id, b.text, b.lang):
                found.setdefault(lang, []).append((int(d), t.encode("utf-8", "replace")))
        m = train({k: [t for _, t in sorted(v)] for k, v in found.items()}, params)
        parts = [("byte_class", "", m.byte_class)] + [(part, name, getattr(tree, part)) for name, tree in zip(m.languages, m.trees) for part in ("row", "node", "cost")]
        yield pd.DataFrame([(part, name, str(v.dtype), v.tobytes()) for part, name, v in parts], columns=["part", "lang", "kind", "data"])

    out = chosen.repartition(1).mapInPandas(learn, "part string, lang string, kind string, data binary").collect()
    got = {(r.part, r.lang): np.frombuffer(bytes(r.data), r.kind) for r in out}
    if not got:
        return train({}, params)
    languages = sorted({lang for part, lang in got if part == "cost"})
    classes = int(got["byte_class", ""].max()) + 2 if languages else 2
    return PpmModel(languages, got["byte_class", ""], classes, [Tree(*(got[part, x] for part in ("row", "node", "cost"))) for x in languages])


def predict(texts: list[str | None], model: PpmModel) -> tuple[list[str], np.ndarray]:
    """Languages, and the posterior of each under equal priors and frozen statistics."""
    bits = code_lengths([(t or "").encode("utf-8", "replace") for t in texts], model)
    best = bits.argmin(axis=1) if len(texts) else np.zeros(0, int)
    gap = bits - bits.min(axis=1, keepdims=True) if len(texts) else bits
    posterior = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
    known = [bool(model.languages) and bool(t) and _LETTER.search(t) is not None for t in texts]
    return [model.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, posterior, 0.0)


def predictor(model: PpmModel, spark):
    """A column function from text to struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        names, score = predict([t if isinstance(t, str) else None for t in texts], shared.value)
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": score})

    return language
