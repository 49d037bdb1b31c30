"""Shards of even bytes by Karmarkar-Karp differencing; equal texts stay together.

Texts are gathered in lumps by their hash, and a text whose copies outweigh a lump is an item of its
own. Lumps and heavy texts are at most two times `n_shards * LUMPS_PER_SHARD` whatever the input, so
differencing them takes one bounded step, and no document is moved to find its shard. The texts of
a lump are never looked at again, so the balance rests on the lumps: they are a thousandth of a
shard each, and differencing leaves far less than one of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

# Lumps per shard; a text with its copies is heavy if it outweighs an even lump.
LUMPS_PER_SHARD = 1024


def difference(sizes: Sequence[int], n_shards: int) -> list[int]:
    """The shard of each size, by differencing.

    A partial partition holds `n_shards` sums. The two with the largest spread are combined, the
    largest sum of one with the smallest of the other, until one is left. Ties go to the partition
    made first, so the result depends on the order of `sizes` alone.
    """
    if not sizes:
        return []
    empty: list[tuple[int, tuple]] = [(0, ())] * (n_shards - 1)
    # (negative spread, number, sums in ascending order, each with the tree of its items)
    partial = [(-s if n_shards > 1 else 0, k, [*empty, (s, k)]) for k, s in enumerate(sizes)]
    heapq.heapify(partial)
    made = len(partial)
    while len(partial) > 1:
        *_, a = heapq.heappop(partial)
        *_, b = heapq.heappop(partial)
        sums = sorted(
            ((x[0] + y[0], _both(x[1], y[1])) for x, y in zip(a, reversed(b))), key=lambda s: s[0]
        )
        # What all sums share is no spread: only differences go on.
        least = sums[0][0]
        sums = [(s - least, items) for s, items in sums]
        heapq.heappush(partial, (-sums[-1][0], made, sums))
        made += 1
    shards = [0] * len(sizes)
    # The largest sum comes first, so few items fill the first shards.
    for shard, (_, tree) in enumerate(reversed(partial[0][2])):
        pending = [tree]
        while pending:
            node = pending.pop()
            if isinstance(node, int):
                shards[node] = shard
            else:
                pending.extend(node)
    return shards


def _both(a, b):
    return b if a == () else a if b == () else (a, b)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _with_keys(documents: DataFrame, lumps: int) -> DataFrame:
    """Adds size, text_key and lump. Equal texts have equal keys; others that do stay together too."""
    text = _text()
    return documents.select(
        "*",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_key"),
    ).withColumn("lump", F.pmod(F.xxhash64("text_key", F.lit(13)), F.lit(lumps)).cast("int"))


def plan_shards(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    """The shard of every lump and heavy text: kind ('lump' or 'text'), item, bytes, shard.

    `item` is the number of the lump or the key of the text. At most two times
    `n_shards * LUMPS_PER_SHARD` rows, for any input; that many sizes pass through the driver.
    """
    if n_shards < 1:
        raise ValueError(f"n_shards must be positive, not {n_shards}")
    spark, lumps = documents.sparkSession, n_shards * LUMPS_PER_SHARD
    keyed = _with_keys(documents.select("text"), lumps)
    # Copies are summed before the shuffle, so a text that fills the table is one row per task.
    texts = stored(keyed.groupBy("text_key", "lump").agg(F.sum("size").alias("bytes")))
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    # Fewer than `lumps` texts can exceed the total divided by `lumps`.
    items = texts.select(
        F.when(F.col("bytes") * lumps > total, "text").otherwise("lump").alias("kind"),
        F.col("bytes"),
        F.when(F.col("bytes") * lumps > total, F.col("text_key")).otherwise(F.col("lump")).alias("item"),
    )
    sums = items.groupBy("kind", "item").agg(F.sum("bytes").alias("bytes"))
    rows = sorted(sums.collect(), key=lambda r: (-r.bytes, r.kind, r.item))
    shards = difference([r.bytes for r in rows], n_shards)
    return spark.createDataFrame(
        [(r.kind, r.item, r.bytes, s) for r, s in zip(rows, shards)],
        "kind string, item long, bytes long, shard int",
    )


def assign_shards(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    """All columns of `documents` beside the new ones: document, size, text_key, shard.

    `document` is the row as a struct, so columns of any name may come along. Sizes are the UTF-8
    bytes of the text plus 1. Equal texts, and null with empty ones, are in one shard, repeated rows
    and null ids too; the bytes of the shards differ by less than a lump unless a text with its
    copies outweighs a shard, which then holds it alone if it can. Very long texts are heavy texts.
    An empty table gives an empty result. No row is shuffled: the plan is small and bounded.
    """
    lumps = n_shards * LUMPS_PER_SHARD
    plan = plan_shards(documents, n_shards)
    heavy = plan.where("kind = 'text'").select(
        F.col("item").alias("text_key"), F.col("shard").alias("own_shard")
    )
    light = plan.where("kind = 'lump'").select(
        F.col("item").cast("int").alias("lump"), F.col("shard").alias("lump_shard")
    )
    rows = documents.select(F.struct(*documents.columns).alias("document"), F.col("text"))
    return (
        _with_keys(rows, lumps)
        .join(F.broadcast(heavy), "text_key", "left")
        .join(F.broadcast(light), "lump", "left")
        .select(
            "document", "size", "text_key", F.coalesce("own_shard", "lump_shard").alias("shard")
        )
    )


def number_rows(rows: DataFrame, shard: str, *order: str) -> DataFrame:
    """Adds `slot`, the place of a row in its shard from 0, in the given order, nulls first.

    Rows are sorted by ranges over the whole table and counted per sorted part; no task holds a
    shard. Rows that agree in all of `order` take their places in any order, so order by enough.
    """
    keys = [F.asc_nulls_first(c) for c in (shard, *order)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    kept = stored(ordered.withColumn("place", place)).withColumn("part", F.shiftright("place", 33))
    # One row per part and shard: no more than the parts and the shards together.
    counts = kept.groupBy(shard, "part").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")
    )
    before = F.expr(
        f"coalesce(sum(n) OVER (PARTITION BY {shard} ORDER BY part"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    starts = counts.select(shard, "part", (before - F.col("first")).alias("shift"))
    return (
        kept.join(F.broadcast(starts), [shard, "part"])
        .withColumn("slot", F.col("shift") + F.col("place"))
        .drop("place", "part", "shift")
    )


def shard_documents(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    """Columns: doc_id, size, text_crc32, shard, slot. Edge cases as in `assign_shards`.

    Slots follow doc_id, then the text. Texts are not shuffled.
    """
    assigned = assign_shards(documents, n_shards)
    text = F.coalesce(F.col("document.text").cast("string"), F.lit(""))
    rows = assigned.select(
        F.col("document.doc_id").alias("doc_id"),
        "size",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard",
        "text_key",
    )
    numbered = number_rows(rows, "shard", "doc_id", "text_key")
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(documents: DataFrame, folder: str, n_shards: int = 16) -> None:
    """Write all columns of `documents` as Parquet below `<folder>/shard=<n>`, in order of slots.

    A shard may be several files; their names follow the order. Texts are shuffled once. If
    `documents` has a column shard of its own, the folders are named shard_, and so on.
    """
    rows = assign_shards(documents, n_shards).select("document", "shard", "text_key")
    keys = [F.asc_nulls_first(c) for c in ("shard", "document.doc_id", "text_key")]
    name, taken = "shard", {c.lower() for c in documents.columns}
    while name in taken:
        name += "_"
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "document.*", F.col("shard").alias(name)
    ).write.partitionBy(name).parquet(folder)
