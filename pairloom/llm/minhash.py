"""MinHash near-deduplication with odd sketches.

Every document's distinct five-word shingles are hashed to 64 bits; 128 MinHash samples give
32 bands of four. A second MinHash, of one sample in each of 1024 bins of the hash range, is
folded into a 2048-bit parity bitmap, the odd sketch; a second bitmap folds all hashes, which
is nearly exact for sets that are small beside it. Documents with equal sets are joined by
their sets' digest first, so only one representative of each set goes on. Within a bucket of a
band each member is tested against one hub, the member whose buckets are the fullest, never
all pairs; the population count of two sketches' XOR estimates the symmetric difference and
drops hopeless candidates, the rest are confirmed on full shingle sets. Members of one
bucket that are still in different components afterwards meet too, but only those that the
count of shingles which others have as well leaves a partner (see ``across``), so no candidate
of any band is lost: a link at similarity 0.75 shares no band with probability
(1 - 0.75^4)^32 < 1e-5.

Edge cases: a text without words has no shingles and is linked with nothing; with fewer than
five words the whole sequence is one shingle; rows that share a doc_id are one node; a null
doc_id is linked with nothing and kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, mixed, word_memo, written

WORDS, SAMPLES, BANDS = 5, 128, 32
BINS, BITS = 1024, 2048
LEAST, STEP = 0.75, 1.05
_P = np.uint64(0x100000001B3)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def contract_words(text: str | None) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, runs without space, tab, LF, VT, FF, CR."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    w = word_memo().of(contract_words(text))
    if not len(w):
        return w
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _P + mixed(w[i : len(w) - k + 1 + i])
    return np.unique(mixed(h))


def samples(s: np.ndarray) -> np.ndarray:
    """The 128 MinHash samples of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    return reduce(np.minimum, ((x[i : i + 2048, None] * _A + _B).min(axis=0) for i in range(0, len(x), 2048)))


def bands(m: np.ndarray) -> np.ndarray:
    """(rows, 32) bucket keys from (rows, 128) samples; the band's number is part of the key."""
    m = m.astype(np.uint64).reshape(len(m), BANDS, SAMPLES // BANDS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(m), 1))
    for i in range(m.shape[2]):
        h = mixed(h + m[:, :, i] * np.uint64(0xC2B2AE3D27D4EB4F))
    return h.view(np.int64)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """BITS bits in 64-bit words; a bit holds the parity of the hashes that fall on it."""
    at = (mixed(hashes + np.uint64(1)) & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Two parity bitmaps: of the bins' smallest hashes, and of the whole set (a sample of all its hashes). ``s`` is sorted, so the smallest come first in their bins."""
    bin_ = (s >> np.uint64(64 - 10)).astype(np.int64)
    first = np.flatnonzero(np.diff(bin_, prepend=-1))
    return np.concatenate([_parity(s[first]), _parity(s)])


def xor_count(a: str, b: str, part: int = 0) -> Column:
    """Population count of the XOR of two sketch columns: of the bins (part 0) or of the whole sets (part 1)."""
    words = BITS // 64
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(part * words, (part + 1) * words)))


def may_link(a: str, b: str, na: str, nb: str) -> Column:
    """False for pairs that sketches rule out. Folding only lowers a whole set's XOR count, and a link differs in a seventh of both sizes' sum at most."""
    return (7 * xor_count(a, b, 1) <= F.col(na) + F.col(nb)) & (xor_count(a, b) <= most_xor(na, nb))


def most_xor(na: str, nb: str) -> Column:
    """The XOR count that a link of sets of these sizes exceeds with probability under 1e-4.

    With B bins, sizes n and union u = (na + nb) / (1 + J), the samples differ in
    B (2 - e^(-na/B) - e^(-nb/B)) - 2 J m places on average, m = B (1 - e^(-u/B)); only bins
    with two or more of the union's hashes add variance. D differences set
    BITS / 2 (1 - e^(-2D/BITS)) bits.
    """
    x, y, b = F.col(na).cast("double"), F.col(nb).cast("double"), float(BINS)
    u = (x + y) / (1 + LEAST)
    m = b * (1 - F.exp(-u / b))
    crowded = 1 - u * F.exp(-u / b) / m
    mean = b * (2 - F.exp(-x / b) - F.exp(-y / b)) - 2 * LEAST * m
    d = F.greatest(mean, F.lit(0.0))
    spread = 4 * LEAST * (1 - LEAST) * m * F.greatest(crowded, F.lit(0.0))  # variance of D
    kept = F.exp(-2 * d / BITS)
    folded = F.greatest(BITS / 4 * (1 - kept**2) - d * kept**2, F.lit(0.0))  # variance that folding adds
    return BITS / 2 * (1 - kept) + 4 * F.sqrt(spread * kept**2 + folded) + 3


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch) of every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            m = np.stack([samples(s) if len(s) else np.zeros(SAMPLES, np.uint32) for s in sets])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists(bands(m)), _lists(np.stack([odd_sketch(s) for s in sets]))],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def shingle_table(docs: DataFrame) -> DataFrame:
    """(id, shingles) of every row that has any."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, screened: bool = False) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sketches allow a link and whose full sets confirm it."""
    if not screened:
        pairs = (
            pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
            .filter(may_link("sa", "sb", "na", "nb")).select("a", "b")
        )
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b"
    )
    both = F.size(F.array_intersect("xa", "xb"))
    return full.filter(100 * both >= 75 * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable. Alternating large and small stars."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = written(large, "large-star")
        discard(now)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "small-star")
        discard(large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == seen:
            break
        state = seen
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = written(roots, "components")
    discard(now)
    return out


def _rooted(ids: DataFrame, column: str, roots: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the root of ``column``, or itself."""
    return ids.join(roots.select(F.col("node").alias(column), F.col("root").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots``, a stored table, after the links (a, b) between nodes."""
    ends = _rooted(_rooted(links, "a", roots, "ra"), "b", roots, "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = components(ends)
    moved = _rooted(roots, "root", merged, "to").select("node", F.col("to").alias("root"))
    new = merged.join(roots, "node", "left_anti")
    out = written(moved.unionByName(new), "roots")
    discard(merged, roots)
    return out


def _class(n: Column) -> Column:
    """Sizes within a step of ``STEP`` share a class."""
    return F.floor(F.log(n.cast("double")) / math.log(STEP) + 1e-9).cast("int")


def across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of members of one bucket in different components; ``placed`` has (bucket, id, root, n, sketch).

    A shingle that one member alone has can be in no intersection. With v shingles that others
    have too, a member of size n links with one of size m only if 7 v >= 3 (n + m), as the
    intersection has 3/7 of both sizes' sum at least. A member meets only the size classes
    that this leaves; whoever differs by himself from all others by more than a link allows
    meets nobody, however large the bucket is.
    """
    members = placed.select("id", "n").distinct()
    shingles = sets.join(members.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("s"))
    alone = shingles.groupBy("s").agg(F.count("*").alias("times"), F.min("id").alias("id")).filter("times = 1").groupBy("id").agg(F.count("*").alias("alone"))
    most = F.floor((7 * (F.col("n") - F.coalesce("alone", F.lit(0))) - 3 * F.col("n")) / F.lit(3)).alias("most")  # the largest partner
    rows = placed.join(members.join(alone, "id", "left").select("id", most), "id")
    low, high = F.ceil(LEAST * F.col("n")), F.least("n", "most")
    larger = rows.filter(low <= high).select(
        "bucket", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("sketch").alias("sa"), F.explode(F.sequence(_class(low), _class(high))).alias("size")
    )
    smaller = rows.filter("most >= n").select("bucket", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("sketch").alias("sb"), _class(F.col("n")).alias("size"))
    fits = (F.col("ra") != F.col("rb")) & (F.struct("nb", "b") < F.struct("na", "a")) & (F.col("nb") <= F.col("ma")) & (F.col("na") <= F.col("mb"))
    return larger.join(smaller, ["bucket", "size"]).filter(fits & may_link("sa", "sb", "na", "nb")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    made = written(features(docs), "features")
    named = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = written(named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r")).select("digest", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), "r.bands", "r.sketch"), "sets")
    sketches = same.select("id", "n", "sketch")
    rows = same.select("id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(rows.join(sizes, "bucket"), "shared")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("i"))).alias("hub"))
    members = written(shared.join(hubs, "bucket").select("bucket", "id", (-F.col("hub.i")).alias("hub"), F.col("hub.weight").alias("weight")), "members")
    discard(shared)
    wanted = members.select("id").distinct()
    texts = docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    sets = written(shingle_table(texts), "shingles")

    # First each document's heaviest hub; most components are whole after that.
    spokes = members.filter("id != hub").groupBy("id").agg(F.max(F.struct("weight", (-F.col("hub")).alias("i"))).alias("h")).select(F.col("id").alias("a"), (-F.col("h.i")).alias("b"))
    roots = components(confirmed(spokes, sketches, sets))
    # Then every other hub that is still in another component.
    spokes = members.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    apart = _rooted(_rooted(spokes, "a", roots, "ra"), "b", roots, "rb").filter("ra != rb").select("a", "b")
    links = written(confirmed(apart, sketches, sets), "links")
    if not links.isEmpty():
        roots = _joined(roots, links)
    # Last, members of one bucket in different components, hubs apart.
    placed = _rooted(members.filter("id != hub").select("bucket", "id"), "id", roots, "root")
    mixed_up = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
    placed = written(placed.join(mixed_up, "bucket", "left_semi").join(sketches, "id"), "placed")
    if not placed.isEmpty():
        last = written(confirmed(across(placed, sets), sketches, sets, screened=True), "links")
        if not last.isEmpty():
            roots = _joined(roots, last)
        discard(last)
    discard(members, sets, links, placed)

    ids = made.select("doc_id", "n_shingles", "digest")
    found = ids.join(same.select("digest", F.col("id").alias("first")), "digest", "left")
    found = found.withColumn("first", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("first")).otherwise(F.col("doc_id")))
    found = _rooted(found, "first", roots, "component_id")
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
