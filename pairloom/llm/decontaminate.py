"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit distance.

Items and documents become sequences of lower-cased words without ASCII punctuation. A link is
a stretch of text within a quarter of the item's words by edit distance. Windows of an item's
size are laid over a document wherever a link can be: q = n // 4 edits leave two at least of any q + 2
of the item's n positions untouched, so a link shows two words of the item's q + 2 rarest
positions, at places that agree on where the item starts to within q words. Windows without such a pair
cannot match and are skipped; nothing else is. Windows are embedded by the CGK random walk: at
step j the walk emits its current word and advances by a random bit of (j, word), so that a
small edit distance becomes a small Hamming distance. ``REPEATS`` independent walks each
compare ``BITS`` sampled coordinates; a window that agrees in any repeat is verified by exact
edit distance against the best matching stretch of text.

The benchmark is the stated query set. It is broadcast in blocks of ``BLOCK`` items, each of
which meets every document, without any shuffle; edits of more than a quarter are not links.

Edge cases: a null or wordless text matches nothing; items without words, text or id are left out; an
empty benchmark matches nothing; repeated items are all reported, repeated rows of one item_id
once; a passage broken by line ends, punctuation or case still matches; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import plain_words, process_cache

REPEATS, BITS, BLOCK, WINDOWS = 24, 2, 5000, 20_000


class Items:
    """A block of items, indexed. Words of the block are numbered from 1; 0 is any other word."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = [(i, w) for i, w in ((i, plain_words(t)) for i, t in sorted(rows, key=lambda r: (r[0], r[1] or ""))) if w]
        self.ids = np.array([i for i, _ in texts], np.int64)
        self.vocabulary: dict[bytes, int] = {}
        self.seqs = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int32) for _, w in texts]
        self.sizes = np.array([len(s) for s in self.seqs], np.int64)
        names = [b""] + list(self.vocabulary)
        df = Counter(x for s in self.seqs for x in set(s.tolist()))
        spots: list[tuple[int, int, int]] = []
        for k, s in enumerate(self.seqs):
            order = sorted(range(len(s)), key=lambda o: (df[int(s[o])], -len(names[s[o]]), o))
            spots += [(int(s[o]), k, o) for o in order[: len(s) // 4 + 2]]
        self.anchors = np.minimum(self.sizes, self.sizes // 4 + 2)
        spots.sort()
        self.spots = np.array(spots, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.spots[:, 0], np.arange(len(names) + 1))
        rng = np.random.default_rng(5)
        longest = int(self.sizes.max(initial=1))
        # Bit j of a word in a repeat: the top bit of its number times the repeat's odd multiplier of step j.
        self.number = rng.integers(0, 1 << 63, len(names), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factor = rng.integers(0, 1 << 63, (2 * longest + 2, REPEATS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        share = rng.random((REPEATS, BITS))
        self.samples = np.floor(share[None] * np.maximum(1, 1.5 * self.sizes)[:, None, None]).astype(np.int64)
        if len(self.seqs):
            at = np.cumsum(self.sizes) - self.sizes
            self.own = self.embedded(np.concatenate(self.seqs), np.arange(len(self.seqs)), at, at, at + self.sizes)

    def embedded(self, flat: np.ndarray, item: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(windows, REPEATS, BITS) sampled words of each window's walks; -1 beyond the window or text."""
        n = len(item)
        i = np.zeros((n, REPEATS), np.int64)
        out = np.full((n, REPEATS, BITS), -1, np.int64)
        size, pick = self.sizes[item][:, None], self.samples[item]
        for j in range(int(pick.max(initial=0)) + 1):
            at = start[:, None] + i
            inside = (i < size) & (at >= low[:, None]) & (at < high[:, None])
            word = np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], 0)
            for b in range(BITS):
                hit = pick[:, :, b] == j
                out[:, :, b][hit] = np.where(inside, word, -1)[hit]
            i += ((self.number[word] * self.factor[j]) >> np.uint64(63)).astype(np.int64)
        return out

    def close(self, k: int, text: np.ndarray) -> bool:
        """Whether some stretch of ``text`` is within a quarter of the item's words by edit distance."""
        s, span = self.seqs[k], np.arange(len(text) + 1)
        row = np.zeros(len(text) + 1, np.int64)
        for x in s:
            new = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + (text != x)]))
            row = np.minimum.accumulate(new - span) + span
        return bool(row.min() * 4 <= len(s))

    def matches(self, texts) -> list[list[int]]:
        """Ids of the items found in each text."""
        found: list[set[int]] = [set() for _ in texts]
        if not len(self.seqs):
            return [[] for _ in found]
        get, parts = self.vocabulary.get, []
        for t in texts:
            w = plain_words(t)
            parts.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        flat = np.concatenate([*parts, np.zeros(1, np.int32)])
        count = (self.first[1:] - self.first[:-1])[flat[:-1]]
        at = np.flatnonzero(count)
        if not len(at):
            return [[] for _ in found]
        n = count[at]
        row = np.repeat(self.first[flat[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, start = self.spots[row, 1], np.repeat(at, n) - self.spots[row, 2]
        doc = np.repeat(np.searchsorted(ends, at, side="right"), n)
        # A window needs a second anchor at nearly the same place, as every link has one.
        key = doc * len(self.seqs) + item
        order = np.lexsort((start, key))
        key, item, start, doc = key[order], item[order], start[order], doc[order]
        close = (key[1:] == key[:-1]) & (start[1:] - start[:-1] <= self.sizes[item[1:]] // 4)
        voted = np.append(close, False) | np.append(False, close) | (self.anchors[item] < 2)
        voted &= np.append(True, (key[1:] != key[:-1]) | (start[1:] != start[:-1]))  # one window a place
        by_size = np.argsort(self.sizes[item[voted]], kind="stable")  # walks of one block are of like length
        item, start, doc = item[voted][by_size], start[voted][by_size], doc[voted][by_size]
        for s in range(0, len(item), WINDOWS):
            it, st, d = item[s : s + WINDOWS], start[s : s + WINDOWS], doc[s : s + WINDOWS]
            seen = self.embedded(flat, it, st, ends[d] - sizes[d], ends[d])
            agree = ((seen == self.own[it]) & (seen > 0)).all(axis=2).any(axis=1)
            for k, a, x in zip(it[agree].tolist(), st[agree].tolist(), d[agree].tolist()):
                if k not in found[x]:
                    slack = int(self.sizes[k]) // 4
                    low, high = max(int(ends[x] - sizes[x]), a - slack), min(int(ends[x]), a + int(self.sizes[k]) + slack)
                    if self.close(k, flat[low:high]):
                        found[x].add(k)
        return [sorted(set(self.ids[list(f)].tolist())) if f else [] for f in found]


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """A column with the sorted ids of the benchmark items that a document's text contains."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-rows.count() // BLOCK))
    found = []
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, r.text) for r in part.toLocalIterator()]))
        found.append(_matcher(shared)(F.col(text)))
    return F.array_sort(F.concat(*found)) if blocks > 1 else found[0]


def _matcher(shared):
    @F.pandas_udf("array<long>")
    def matched(texts: pd.Series) -> pd.Series:
        return pd.Series(_items(shared).matches([t if isinstance(t, str) else None for t in texts]), dtype=object)

    return matched


def _items(shared) -> Items:
    """The index of a broadcast block, kept by the worker for its next tasks."""
    kept = process_cache("items", dict)
    key, rows = shared.value
    if key not in kept:
        if len(kept) > 2:
            kept.clear()
        kept[key] = Items(rows)
    return kept[key]
