"""Mixing of sources to target weights by Sainte-Lague apportionment of equal blocks.

The words of a source are dealt to shards in a seeded order and cut into blocks of equal size. The
blocks that the mix takes are seats: sources receive them by the highest quotients target / (2k + 1)
and hand them on to their shards in the same way. A shard takes all of its blocks as many times as
its quota allows, and the rest of the quota by seeded systematic selection.

Only rows of a document's id and size are shuffled, and running sums stay inside a shard, whose size
is set. So the number of shards of a large source grows, not their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import words
from tidemark.session import stored

WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = 1.5, 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SEED = 7


def targets(sources: DataFrame) -> DataFrame:
    """Adds `target` to (source, source_size): weights in turn over the sources in order, null last.

    A target stops at MOST_EPOCHS times the source's size, and what is above goes to the others by
    weight. So there is a level such that every target is weight x level, or the stop if that is
    less. Sources are ordered by the level at which they stop; the first that need not stop when all
    before it do gives the level. One row per source meets in one task.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    rows = sources.select(
        "*",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in WEIGHTS]),
            (F.row_number().over(in_order) - 1) % len(WEIGHTS) + 1,
        ).alias("weight"),
        (F.lit(SHARE) * F.sum("source_size").over(everything)).alias("budget"),
    ).withColumn("stop", F.lit(float(MOST_EPOCHS)) * F.col("source_size"))
    by_stop = Window.orderBy(F.expr("stop / weight"), F.asc_nulls_last("source"))
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.row_number().over(by_stop).alias("place"),
        (
            (F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
            / F.sum("weight").over(after)
        ).alias("level"),
    ).withColumn("fits", F.expr("level <= stop / weight"))
    level = F.min_by(F.expr("if(fits, level, NULL)"), F.expr("if(fits, place, NULL)")).over(
        everything
    )
    return rows.select(
        "source",
        "source_size",
        F.least("stop", F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"),
    )


def apportion(rows: DataFrame, within: list[str], claim: str, seats: str, order: list) -> DataFrame:
    """Adds `quota`: the seats of each group `within`, dealt to its rows by the highest quotients.

    `claim` is a row's weight and `seats` the group's whole number of seats. Seats that a row has
    under a divisor so large that too few are dealt are certain, and those it lacks under one so
    small that too many are dealt are out of reach. At most about two quotients per row lie between
    and are ranked. Equal quotients go to the first row by `order`.
    """
    group = Window.partitionBy(*within)
    claims, n = F.sum(claim).over(group), F.count(F.lit(1)).over(group)
    rows = rows.withColumns({"_claims": claims, "_n": n})

    def seated(total: str) -> Column:
        return F.expr(
            f"if(_claims > 0, cast(floor({claim} * greatest({total}, 0) / _claims + 0.5) as bigint), 0L)"
        )

    # A margin of half a seat per row is exact; one more covers rounding.
    rows = rows.withColumns({
        "_low": F.greatest(seated(f"{seats} - _n / 2 - 1"), F.lit(0)),
        "_high": seated(f"{seats} + _n / 2 + 1"),
    })
    rows = rows.withColumn("_sure", F.sum("_low").over(group))
    open_ = rows.where("_high > _low").select(
        "*", F.explode(F.expr("sequence(_low, _high - 1)")).alias("_k")
    ).withColumn("_quotient", F.expr(f"{claim} / (2 * _k + 1)"))
    ranked = open_.withColumn(
        "_rank", F.row_number().over(group.orderBy(F.desc("_quotient"), *order, F.asc("_k")))
    ).where(f"_rank <= {seats} - _sure")
    names = [c for c in rows.columns if not c.startswith("_")]
    return (
        rows.select(*names, F.col("_low").alias("quota"))
        .unionByName(ranked.select(*names, F.lit(1).cast("long").alias("quota")))
        .groupBy(*names)
        .agg(F.sum("quota").alias("quota"))
    )


def _sized(documents: DataFrame, seed: int, carry: bool) -> DataFrame:
    """Columns: doc_id, source, size, mark (a seeded fingerprint), and the whole row if carried."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(words("text")).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(seed)).alias("mark"),
        *([F.struct("*").alias("document")] if carry else []),
    )


_SHARD = "pmod(shiftright(mark, 20), n_shards)"


def quotas(sizes: DataFrame, block_words: int, shard_words: int) -> DataFrame:
    """One row per source and shard: its words, blocks, block size, quota, and the source's target."""
    sources = targets(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ).withColumn("n_shards", F.expr(f"greatest(1L, cast(ceil(source_size / {shard_words}) as bigint))"))
    shards = (
        sizes.alias("d")
        .join(sources.alias("s"), F.expr("d.source <=> s.source"))
        .selectExpr("s.*", f"{_SHARD} AS shard", "size")
        .groupBy("source", "source_size", "target", "n_shards", "shard")
        .agg(F.sum("size").alias("shard_size"))
        .selectExpr(
            "*",
            f"greatest(1L, cast(ceil(shard_size / {block_words}) as bigint)) AS n_blocks",
        )
        .selectExpr(
            "*",
            "greatest(1L, cast(ceil(shard_size / n_blocks) as bigint)) AS block_size",
            # A source's share in blocks: a whole epoch is all of its blocks.
            "if(source_size > 0, target / source_size * n_blocks, 0D) AS claim",
        )
    )
    order = [F.asc_nulls_last("source")]
    held = shards.groupBy("source").agg(F.sum("claim").alias("claim")).withColumn(
        "mix", F.lit(1)
    )
    held = held.withColumn(
        "seats", F.round(F.sum("claim").over(Window.partitionBy("mix"))).cast("long")
    )
    seats = apportion(held, ["mix"], "claim", "seats", order).selectExpr(
        "source AS of", "quota AS source_quota"
    )
    rows = shards.join(seats, F.expr("source <=> of")).drop("of")
    dealt = apportion(rows, ["source"], "claim", "source_quota", [F.asc("shard")])
    return dealt.withColumn("quota", F.expr(f"least(quota, {MOST_EPOCHS} * n_blocks)"))


def mix(
    documents: DataFrame,
    *,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    carry: bool = False,
) -> DataFrame:
    """What the mix takes of each row of `documents` (doc_id, source, text).

    Columns: doc_id, source, size, source_size, target, taken, epochs, extra, and the geometry of
    the extra blocks: start, block_size, n_blocks, picked, phase. `taken` = epochs x size + extra
    words; no row gives more than twice its size. With `carry` the struct `document` holds the whole
    row. A null source is a source, the last one. A null text has size 0 and gives nothing. Rows
    with the same doc_id are separate documents; if they also have the same text they are
    interchangeable. The same input and seed give the same result.
    """
    sizes = stored(_sized(documents, seed, False))
    shards = quotas(sizes, block_words, shard_words).drop("claim", "source_quota", "n_shards")
    plan = stored(shards)
    by_source = sizes.groupBy("source").agg(
        F.expr(f"greatest(1L, cast(ceil(sum(size) / {shard_words}) as bigint))").alias("n_shards")
    )
    rows = _sized(documents, seed, True) if carry else sizes
    placed = (
        rows.alias("d")
        .join(by_source.alias("s"), F.expr("d.source <=> s.source"))
        .select("d.*", F.expr(_SHARD).alias("shard"))
    )
    place = Window.partitionBy("source", "shard").orderBy("mark", "doc_id", "size")
    ahead = place.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    joined = (
        placed.alias("d")
        .join(plan.alias("q"), F.expr("d.source <=> q.source AND d.shard = q.shard"))
        .select(
            "d.*", "source_size", "target", "n_blocks", "block_size",
            F.expr("quota div n_blocks").alias("epochs"),
            F.expr("quota % n_blocks").alias("picked"),
            F.expr(f"pmod(xxhash64(d.source, d.shard, {seed}), n_blocks)").alias("phase"),
        )
    )

    def words_before(place: str) -> str:
        """Words of picked blocks ahead of a place: whole blocks, and a part of the one it is in."""
        block = f"({place} div block_size)"
        picked = f"(({block} * picked + phase) div n_blocks)"
        here = f"((({block} + 1) * picked + phase) div n_blocks - {picked})"
        return f"({picked} * block_size + {here} * ({place} % block_size))"

    extra = f"{words_before('(start + size)')} - {words_before('start')}"
    return joined.selectExpr(
        "doc_id", "source", "size", "source_size", "target",
        f"epochs * size + {extra} AS taken", "epochs", f"{extra} AS extra",
        "start", "block_size", "n_blocks", "picked", "phase",
        *(["document"] if carry else []),
    )


def mixed_documents(documents: DataFrame, **parameters: int) -> DataFrame:
    """The mix as documents: each row as often as whole epochs take it, and the words of its extra
    blocks, joined by blanks, as one more row. `n_chars`, if it is there, follows the text.

    All columns of `documents` are kept, in their order. Documents without words are not in the mix.
    """
    taken = mix(documents, carry=True, **parameters)
    block = "((start + i) div block_size)"
    picked = f"(({block} + 1) * picked + phase) div n_blocks > ({block} * picked + phase) div n_blocks"
    rows = taken.withColumn("full_text", F.col("document.text").cast("string")).select(
        "document",
        F.expr("CASE WHEN size = 0 THEN 0 WHEN extra = size THEN epochs + 1 ELSE epochs END").alias("times"),
        F.when(
            F.expr("extra > 0 AND extra < size"),
            F.array_join(
                F.expr(
                    r"filter(split(btrim(full_text, ' \t\n' || chr(11) || '\f\r'),"
                    rf" '[\\x20\\x09-\\x0D]+'), (w, i) -> {picked})"
                ),
                " ",
            ),
        ).alias("part"),
    )
    whole = F.expr(
        "CASE WHEN times > 0 THEN array_repeat(document.text, cast(times as int)) ELSE array() END"
    )
    texts = F.concat(whole, F.expr("CASE WHEN part IS NULL THEN array() ELSE array(part) END"))
    out = rows.select("document", F.explode(texts).alias("mixed_text"))
    columns = []
    for name in documents.columns:
        value = F.col("document").getField(name)
        if name == "text":
            value = F.col("mixed_text")
        elif name == "n_chars":
            value = F.length("mixed_text").cast(documents.schema[name].dataType)
        columns.append(value.alias(name))
    return out.select(*columns)
