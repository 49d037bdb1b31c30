"""Benchmark passages in documents: SimHash of item-sized windows, verified by shingle similarity.

For every length that a benchmark item has, documents are seen as the windows of so many words (or
all words of a shorter document). A window and an item of that length are candidates if their 64-bit
SimHashes, taken over runs of five words, differ in at most RADIUS bits. They are found by equal
blocks: the fingerprint is cut into BLOCKS blocks, and by the pigeonhole principle two fingerprints
within the radius differ by at most FLIPS bits in one of them; the few items list every value within
FLIPS bits of each of their blocks, so one equality join finds all. Candidates are verified with the
exact similarity of the weighted shingles, where a weight is the number of occurrences.

A window without any shingle of an item of its length has similarity 0, so only windows that hold
one are fingerprinted. They are found by a join with the shingles of the benchmark, which is
broadcast in parts of bounded size, and carry their own words' fingerprints along, so documents are
read once per part and never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import words
from tidemark.session import stored

WORDS = 5
SIMILARITY = 0.8
# Six blocks with up to two flips each: (2 + 1) x 6 - 1 bits. At similarity 0.8 the expected
# distance is 9.7 bits with a deviation of 2.9, so the radius lies 2.7 deviations further out.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
FLIPS = 2
RADIUS = (FLIPS + 1) * len(BLOCK_BITS) - 1
# Benchmark shingles that are broadcast at once, about 24 bytes each.
BROADCAST_SHINGLES = 1_000_000
# Three counters of 21 bits share a word, so 22 sums count all 64 bits.
_LANES, _LANE_BITS = 22, 21
_SPREAD = sum(1 << (_LANE_BITS * k) for k in range(3))


def _shingles(h: str, n: str) -> str:
    """Fingerprints of all runs of WORDS words from those of the words."""
    run = ", ".join(["x", *[f"{h}[i + {k}]" for k in range(1, WORDS)]])
    return (
        f"CASE WHEN {n} < {WORDS} THEN cast(array() as array<bigint>) ELSE transform("
        f"slice({h}, 1, {n} - {WORDS - 1}), (x, i) -> xxhash64({run})) END"
    )


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    """Adds the number of words `n` and the shingles `s` of column `text`."""
    split = rows.select(*keep, F.transform(words("text"), lambda w: F.xxhash64(w)).alias("h"))
    return split.select(*keep, "h", F.size("h").alias("n")).selectExpr(
        *keep, "n", f"{_shingles('h', 'n')} AS s"
    )


def _bit_counts(shingle: str) -> list:
    return [
        F.sum(F.expr(f"shiftrightunsigned({shingle}, {j}) & {_SPREAD}L")).alias(f"c{j}")
        for j in range(_LANES)
    ]


def _simhash() -> str:
    """The fingerprint from the counters: a bit is set if more than half of `total` have it."""
    bits = []
    for b in range(64):
        j, lane = b % _LANE_BITS, b // _LANE_BITS
        if b == 63:
            j, lane = 21, 2
        count = f"(shiftrightunsigned(c{j}, {_LANE_BITS * lane}) & {(1 << _LANE_BITS) - 1}L)"
        bits.append(f"if(2 * {count} > total, shiftleft(1L, {b}), 0L)")
    return " | ".join(bits)


def _blocks(simhash: str) -> list[str]:
    out, shift = [], 0
    for bits in BLOCK_BITS:
        out.append(f"(shiftrightunsigned({simhash}, {shift}) & {(1 << bits) - 1}L)")
        shift += bits
    return out


def _flips(bits: int) -> list[int]:
    """All masks of `bits` bits with at most FLIPS ones."""
    return [m for m in range(1 << bits) if m.bit_count() <= FLIPS]


def _items(benchmark: DataFrame) -> DataFrame:
    """Columns: item_id, length, s, simhash. Items of fewer than WORDS words have no shingle."""
    rows = _hashed(
        benchmark.select(
            F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
        ).distinct(),
        "item_id",
    ).where(f"n >= {WORDS}")
    rows = rows.select("item_id", F.col("n").alias("length"), "s", F.xxhash64("s").alias("of"))
    marks = (
        rows.select("of", "s").dropDuplicates(["of"])
        .select("of", F.size("s").alias("total"), F.explode("s").alias("x"))
        .groupBy("of", "total")
        .agg(*_bit_counts("x"))
        .selectExpr("of", f"{_simhash()} AS simhash")
    )
    return stored(rows.join(marks, "of").drop("of"))


def _anchors(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per place of a document where a shingle of an item stands, and per such length.

    Columns: doc_id, mark, n, length, p, near (the shingles of all windows that hold place p), first
    (the place of near's first shingle). Rows that repeat altogether count once.
    """
    known = stored(items.select("length", F.explode("s").alias("x")).distinct())
    parts = max(1, -(-known.count() // BROADCAST_SHINGLES))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("mark"),
    )
    # The outer form: for the inner one a filter on the array's size is inferred and pushed down to
    # the scan, where the array would be computed again, inside out.
    placed = _hashed(rows, "doc_id", "mark").select(
        "doc_id", "mark", "n", "s", F.posexplode_outer("s").alias("p", "x")
    )

    def part(k: int) -> DataFrame:
        some = known.where(f"pmod(x, {parts}) = {k}") if parts > 1 else known
        return placed.join(F.broadcast(some), "x").selectExpr(
            "doc_id", "mark", "n", "length", "p",
            f"greatest(p - length + {WORDS}, 0) AS first",
            f"slice(s, greatest(p - length + {WORDS}, 0) + 1,"
            f" p + length - {WORDS - 1} - greatest(p - length + {WORDS}, 0)) AS near",
        )

    found = reduce(DataFrame.unionByName, [part(k) for k in range(parts)])
    # Every window belongs to the first place in it, so it is made once.
    places = Window.partitionBy("doc_id", "mark", "length").orderBy("p")
    return stored(
        found.withColumn("previous", F.lag("p").over(places)).where("p > coalesce(previous, -1)")
    )


def _windows(anchors: DataFrame) -> DataFrame:
    """One row per window: doc_id, mark, length, p, start, w (its shingles)."""
    last = f"least(p, greatest(n - length, 0))"
    starts = anchors.withColumn(
        "from_", F.expr(f"greatest(first, coalesce(previous, -1) + 1, 0)")
    ).where(f"from_ <= {last}")
    return starts.select(
        "doc_id", "mark", "length", "p", "first", "near",
        F.explode(F.expr(f"sequence(from_, {last})")).alias("start"),
    ).selectExpr(
        "doc_id", "mark", "length", "p", "start",
        f"slice(near, start - first + 1, length - {WORDS - 1}) AS w",
    )


# The weighted similarity is that of the sets unless a shingle repeats on both sides.
_SHARED = """
CASE WHEN size(array_distinct(w)) = size(w) OR size(array_distinct(s)) = size(s)
THEN size(array_intersect(w, s))
ELSE aggregate(array_intersect(w, s), 0, (a, x) ->
  a + least(size(filter(w, y -> y = x)), size(filter(s, y -> y = x)))) END
"""


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns: doc_id, mark, item_id, similarity, start, n_windows; one row per document and item.

    `similarity` is the highest weighted Jaccard similarity of a window, 0.8 or more; `start` is the
    first word of the first such window; `n_windows` counts the windows that reach 0.8. `mark` is a
    fingerprint of the text, so rows with the same doc_id but different texts are told apart. Rows
    that repeat altogether count once; a null doc_id is an id. Null texts, and documents or items of
    fewer than five words, never match. Other columns are ignored.
    """
    items = _items(benchmark)
    anchors = _anchors(documents, items)
    windows = _windows(anchors)
    marked = (
        windows.select("doc_id", "mark", "length", "p", "start", F.size("w").alias("total"), F.explode("w").alias("x"))
        .groupBy("doc_id", "mark", "length", "p", "start", "total")
        .agg(*_bit_counts("x"))
        .selectExpr("doc_id", "mark", "length", "p", "start", f"{_simhash()} AS simhash")
    )
    listed = items.select(
        "item_id", "length", F.col("simhash").alias("item_hash"),
        F.explode(
            F.expr(
                "concat("
                + ", ".join(
                    f"transform(array({', '.join(f'{m}L' for m in _flips(bits))}),"
                    f" m -> struct({k} AS block, {value} ^ m AS value))"
                    for k, (bits, value) in enumerate(zip(BLOCK_BITS, _blocks("simhash")))
                )
                + ")"
            )
        ).alias("key"),
    ).select("item_id", "length", "item_hash", "key.block", "key.value")
    asked = marked.select(
        "doc_id", "mark", "length", "p", "start", "simhash",
        F.posexplode(F.expr(f"array({', '.join(_blocks('simhash'))})")).alias("block", "value"),
    )
    candidates = (
        asked.join(listed, ["length", "block", "value"])
        .where(f"bit_count(simhash ^ item_hash) <= {RADIUS}")
        .select("doc_id", "mark", "length", "p", "start", "item_id")
        .distinct()
    )
    held = anchors.selectExpr(
        "doc_id AS of_doc", "mark AS of_mark", "length AS of_length", "p AS of_p", "first", "near"
    )
    verified = (
        candidates.join(
            held,
            F.expr("doc_id <=> of_doc AND mark = of_mark AND length = of_length AND p = of_p"),
        )
        .selectExpr(
            "doc_id", "mark", "start", "item_id", "length",
            f"slice(near, start - first + 1, length - {WORDS - 1}) AS w",
        )
        .join(items.select("item_id", "length", "s"), ["item_id", "length"])
        .select("doc_id", "mark", "start", "item_id", F.expr(_SHARED).alias("shared"),
                F.expr("size(w) + size(s)").alias("total"))
        .selectExpr("*", "shared / (total - shared) AS similarity")
        .where(f"similarity >= {SIMILARITY}")
    )
    return verified.groupBy("doc_id", "mark", "item_id").agg(
        F.max("similarity").alias("similarity"),
        F.min("start").alias("start"),
        F.countDistinct("start").alias("n_windows"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`documents` without those that hold a passage of `benchmark`. All columns are kept."""
    found = contamination(documents, benchmark).select(
        F.col("doc_id").alias("dirty_id"), F.col("mark").alias("dirty_mark")
    ).distinct()
    rows = documents.select(
        F.struct("*").alias("document"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("mark"),
    )
    kept = rows.join(found, F.expr("id <=> dirty_id AND mark = dirty_mark"), "left_anti")
    return kept.select("document.*")
