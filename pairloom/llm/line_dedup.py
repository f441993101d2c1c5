"""Line deduplication by content-defined chunks of lines, in DataFrame functions alone.

A line here ends at a line feed, or after a mark and the blank that follows it, so that a
passage pasted into a paragraph still consists of whole lines. The blank or line feed that
ends a line does not count. Chunk boundaries come from a rolling hash over the line hashes (a cyclic
polynomial of two neighbouring lines): a chunk starts where its low ``CUT_BITS`` bits are
zero, and at every line of ``LINE_CHARS`` characters or more, whatever stands around it, so that
insertions shift nothing. From each start a chunk holds the fewest lines, two at least, that
give ``LONG`` characters; a line of ``LONG`` characters is a chunk of its own too. Shorter
chunks, of ``MIN_CHARS`` characters and two lines or more, run from one boundary of the
rolling hash to the next. A whole text is a chunk too. So any run of whole lines that two texts share
holds equal chunks as soon as it has one line of ``LINE_CHARS`` characters with ``LONG`` characters from it on.

Chunks that occur elsewhere too are removed wherever they are not the first occurrence (by
doc_id, then position); the first one stays. Hashes find them; the bytes of all occurrences
are then grouped by value, and chunks whose hash stands for several values are settled by the
bytes themselves. Counting is partial before it is shuffled. A hash with more than one in
``HOT`` of all chunks meets the chunks by broadcast (there are at most ``HOT`` of these), so
no group of copies gathers in one task. Text moves twice, by document.

Edge cases: a null text stays null and an empty one empty; texts under ``MIN_CHARS`` characters
stay even where copied; rows that repeat both id and text
are one occurrence and are treated alike; a null id orders first; an empty table gives no
rows; other columns pass through unchanged, also when they are named like ours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, written

#: One match per line; the group leaves out its blank or line feed.
LINE = r"(?!\z)((?:[^\n.,;:!?|]++|[.,;:!?|](?! ))*+(?:[.,;:!?|](?= ))?)[ \n]?"
LINE_END = r"(?<=\n)|(?<=[.,;:!?|] )"
MIN_CHARS, LONG, LINE_CHARS, CUT_BITS, HOT = 40, 64, 24, 2, 1000
_NEAR = 8


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column computed once a row: a generator keeps the optimizer from copying it into other expressions."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def _keys() -> list[Column]:
    """A row's place in the order of occurrences: its id, then its text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k1"), F.hash("text").alias("k2")]


def _lines(whole: bool = False) -> Column:
    """The lines of ``text``, bare or whole with what ends them."""
    return F.regexp_extract_all("text", F.lit(LINE), F.lit(0 if whole else 1))


def _rolled(i: Column) -> Column:
    """The rolling hash of lines i and i + 1: the first one's hash rotated by one bit, XOR the second one's."""
    x = F.get("h", i)
    return F.shiftleft(x, 1).bitwiseOR(F.shiftrightunsigned(x, 63)).bitwiseXOR(F.coalesce(F.get("h", i + 1), F.lit(0).cast("long")))


def _cut(i: Column) -> Column:
    return _rolled(i).bitwiseAND(F.lit((1 << CUT_BITS) - 1).cast("long")) == 0


def _long_lines(i: Column) -> Column:
    """The fewest lines from i on, two at least, with ``LONG`` characters; null if the text ends before."""
    full = lambda t: t.bitwiseAND(F.lit((1 << 32) - 1)) >= LONG  # noqa: E731  characters below, lines from bit 32 on
    far = F.aggregate(F.slice("n", i + 1, F.lit(LONG)), F.lit(0).cast("long"), lambda t, x: F.when(full(t), t).otherwise(t + F.lit(1 << 32) + x))
    found = F.when(full(far), F.shiftright(far, 32).cast("int"))
    for m in range(_NEAR, 1, -1):
        found = F.when(reduce(lambda a, b: a + b, [F.get("n", i + j) for j in range(m)]) >= LONG, F.lit(m)).otherwise(found)
    return found


def _short_lines(i: Column) -> Column:
    """The lines from boundary i to the next boundary or the text's end, if they are two or more with ``MIN_CHARS`` to ``LONG - 1`` characters."""
    last = F.least(F.size("n"), i + F.coalesce(F.get("long", i) - 1, F.lit(LONG)))  # from here on there are too many characters
    following = F.get(F.filter(F.sequence(i + 1, F.greatest(last, i + 1)), lambda j: (j == F.size("n")) | F.get("cut", j)), F.lit(0))
    chars = F.aggregate(F.slice("n", i + 1, following - i), F.lit(0), lambda t, x: t + x)
    return F.when((following - i >= 2) & (following <= last) & chars.between(MIN_CHARS, LONG - 1), following - i)


def _chunk(i: Column, m: Column) -> Column:
    return i.cast("long") * 128 + m  # m is LONG at most; 0 stands for the whole text


def _found() -> Column:
    """All chunks, packed, from the arrays n (characters), cut (boundaries of the rolling hash) and long (lines of the long chunks)."""
    every = F.sequence(F.lit(0), F.size("n") - 1)
    alone = lambda i, m: (m == 2) & (F.get("n", i) >= LONG) & F.coalesce(F.get("n", i + 1) >= LONG, F.lit(False))  # noqa: E731  both lines are chunks of their own
    long = F.transform("long", lambda m, i: F.when(((i > 0) | F.get("cut", i) | (F.get("n", i) >= LINE_CHARS)) & ~alone(i, m), _chunk(i, m)))
    lines = F.transform("n", lambda n, i: F.when(n >= LONG, _chunk(i, F.lit(1))))
    few = F.filter(every, lambda i: ((i == 0) | F.get("cut", i)) & (F.get("n", i) < LONG) & F.coalesce(F.get("long", i) > 2, F.lit(True)))
    short = F.transform(few, lambda i: F.when((i > 0) | (_short_lines(i) < F.size("n")), _chunk(i, _short_lines(i))))
    # The whole text is a chunk too, unless it is one already.
    zero, first = F.lit(0), F.get("n", F.lit(0))
    covered = (F.size("n") == F.get("long", zero)) & ((first >= LINE_CHARS) | F.get("cut", zero)) & ~alone(zero, F.get("long", zero))
    known = F.coalesce(covered, F.lit(False)) | ((F.size("n") == 1) & (first >= LONG))
    whole = F.when(~known, _chunk(F.lit(0), F.lit(0)))
    return F.array_compact(F.concat(long, lines, short, F.array(whole)))


def chunks(docs: DataFrame) -> DataFrame:
    """(k1, k2, s, m, hash): every chunk's first line and number of lines. All work on a text's arrays precedes the row per chunk."""
    rows = docs.filter(F.length("text") >= MIN_CHARS).select(*_keys(), F.explode(F.array(_lines())).alias("lines"))
    rows = _computed(rows, "n", F.transform("lines", F.length))
    rows = _computed(rows, "h", F.transform("lines", lambda x: F.xxhash64(x))).select("k1", "k2", "n", "h")
    rows = _computed(rows, "cut", F.transform("h", lambda h, i: _cut(i)))
    rows = _computed(rows, "long", F.transform("n", lambda n, i: F.when((i == 0) | (n >= LINE_CHARS) | F.get("cut", i), _long_lines(i))))
    rows = _computed(rows, "found", _found()).select("k1", "k2", "h", "found")
    each = rows.select("k1", "k2", "h", F.explode("found").alias("x"))
    each = each.select("k1", "k2", "h", F.shiftright("x", 7).cast("int").alias("s"), F.col("x").bitwiseAND(F.lit(127).cast("long")).cast("int").alias("m"))
    each = each.withColumn("m", F.when(F.col("m") == 0, F.size("h")).otherwise(F.col("m")))
    return each.select("k1", "k2", "s", "m", F.xxhash64(F.slice("h", F.col("s") + 1, F.col("m"))).alias("hash"))


def _place() -> Column:
    """k2 and s in one number, in their order."""
    return (F.shiftleft(F.col("k2").cast("long"), 32) + F.col("s")).alias("place")


def repeated(made: DataFrame) -> DataFrame:
    """(hash, k1, k2, s, m, low) of the chunks in ``made``, a stored table, that occur twice or more; ``low`` is the smallest k1 of the hash."""
    total = made.count()
    counts = written(made.groupBy("hash").agg(F.count("*").alias("times"), F.min("k1").alias("low")).filter("times > 1"), "counts")
    hot = F.col("times") * HOT > total  # fewer than HOT hashes
    often, seldom = F.broadcast(counts.filter(hot).select("hash", "low")), counts.filter(~hot).select("hash", "low").hint("shuffle_hash")  # a partition has two of its chunks at least to each of these
    if counts.filter(hot).isEmpty():
        shared = made.join(seldom, "hash")
    else:
        shared = made.join(often.select("hash"), "hash", "left_anti").join(seldom, "hash").unionByName(made.join(often, "hash"))
    out = written(shared, "repeated")
    discard(counts)
    return out


def copies(marks: DataFrame, *by: str) -> DataFrame:
    """Rows of ``marks`` that are not the first occurrence of their ``by`` columns; ``low`` is the smallest k1 there."""
    own = marks.filter("k1 = low").select(*by, "k1", "k2", "s", "m", _place())
    first = own.groupBy(*by).agg(F.min("place").alias("first"))
    again = own.join(first, [*by]).filter("place > first")
    return marks.filter("k1 > low").select(*by, "k1", "k2", "s", "m").unionByName(again.select(*by, "k1", "k2", "s", "m"))


def _texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(hash, k1, k2, s, m, chunk): ``marks`` with their bytes, lines joined by line feeds."""
    spans = marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("hash", "s", "m")).alias("spans"))  # as many as a text has lines
    rows = docs.filter(F.length("text") >= MIN_CHARS).select(*_keys(), "text").join(spans.hint("shuffle_hash"), ["k1", "k2"])  # spans are smaller than texts
    rows = rows.select("k1", "k2", "spans", F.explode(F.array(_lines())).alias("lines"))
    each = rows.select("k1", "k2", "lines", F.explode("spans").alias("x"))
    return each.select("x.hash", "k1", "k2", "x.s", "x.m", F.array_join(F.slice("lines", F.col("x.s") + 1, F.col("x.m")), "\n").alias("chunk"))


def removals(docs: DataFrame) -> DataFrame:
    """(k1, k2, gone): positions of the lines to remove, for each row that loses any."""
    made = written(chunks(docs), "chunks")
    marks = repeated(made)
    discard(made)
    # Equal bytes fall into one group; a hash with several groups stands for different chunks.
    clashes = written(_texts(docs, marks).groupBy("hash", "chunk").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("values")).filter("values > 1").select("hash"), "clashes")
    gone = copies(marks, "hash")
    if not clashes.isEmpty():
        some = marks.join(clashes, "hash", "left_semi")
        exact = written(_texts(docs, some).select(F.col("chunk").alias("value"), "k1", "k2", "s", "m"), "exact")
        low = exact.groupBy("value").agg(F.min("k1").alias("low"))
        gone = gone.join(clashes, "hash", "left_anti").drop("hash").unionByName(copies(exact.join(low, "value"), "value").drop("value"))
    lines = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["m"] - 1))))
    out = written(gone.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "m")).alias("spans")).select("k1", "k2", lines.alias("gone")), "gone")
    discard(marks)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and ``lines_removed`` (replacing a column of that name)."""
    gone = removals(docs)
    names = [c for c in docs.columns if c not in ("text", "lines_removed")]
    row = docs.select(*_keys(), "text", F.struct(*names).alias("rest"))
    both = row.join(gone.hint("shuffle_hash"), ["k1", "k2"], "left")
    kept = _computed(both, "lines", F.when(F.col("gone").isNotNull(), _lines(whole=True)))
    kept = _computed(kept, "stay", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), ""))
    out = kept.select("rest.*", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))
    return out.select(*[c for c in docs.columns if c != "lines_removed"], "lines_removed")
