"""Near-duplicate documents by BagMinHash signatures of their word shingles.

A text is the multiset of its runs of five words. Every shingle drives Poisson processes over its
weight, cut into dyadic strips (0, 1], (1, 2], (2, 4] and so on; a point of a strip carries a weight
level and counts if the shingle is at least that heavy. Points fall on the registers of the
signature at random, and a register keeps its earliest point. Two texts agree in a register with a
probability that equals their weighted Jaccard similarity. Only the few early points of each text
are ever generated, so a signature costs little more than one hash per shingle.

Texts that agree in a whole band of registers are candidates. The multiset overlap of candidates is
then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.textbytes import blocks, mix, multiset, shingles, tidy
from tidemark.session import stored

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
# Texts that share a band are compared one by one up to this many, and through a centre beyond.
SMALL_BUCKET = 16
# Tasks over which the members of a large bucket or centre are dealt in joins. There are more members
# than that, so the copies of what they are joined with are fewer than the members.
SALTS = SMALL_BUCKET
# Texts in each of two blocks that are compared in one task.
BLOCK = 256
# Texts that are signed together, at about 30 KB each.
SIGNED_TOGETHER = 1024

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def signatures(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Signature of each of n multisets given as (element, owner) occurrences; n x REGISTERS times.

    An empty multiset has infinite times.
    """
    value, owner, weight = multiset(value, owner)
    # One process per shingle and strip; strip j >= 1 covers the levels 2**(j-1) + 1 ... 2**j.
    strips = np.zeros(len(weight), np.int64)
    heavy = weight > 1
    strips[heavy] = np.ceil(np.log2(weight[heavy])).astype(np.int64)
    element = np.repeat(np.arange(len(value)), strips + 1)
    strip = np.arange(len(element)) - np.repeat(np.cumsum(strips + 1) - strips - 1, strips + 1)
    width = np.where(strip > 0, np.left_shift(1, np.maximum(strip - 1, 0)), 1)
    seed = mix(value[element] + (strip.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03))
    times = np.full((n, REGISTERS), np.inf)
    total = np.bincount(owner, weight, n)
    # All registers are hit before this time but for one text in seven; those get more time.
    needed = REGISTERS * (np.log(REGISTERS) + 2)
    todo = total > 0
    while todo.any():
        limit = np.where(todo, needed / np.maximum(total, 1), 0.0)
        _points(times.reshape(-1), seed, owner[element], width, strip, weight[element], limit)
        todo &= np.isinf(times).any(axis=1)
        needed *= 2
    return times


def _points(times, seed, owner, width, strip, weight, limit) -> None:
    """Puts all points of the processes before the owner's time limit into `times`."""
    # Width 1 needs no level; most shingles occur once.
    at = np.flatnonzero(limit[owner] > 0)
    state, clock = seed[at], np.zeros(len(at))
    while len(at):
        state = state + _STEP
        drawn = mix(state)
        clock = clock - np.log1p(-(drawn >> _U(11)).astype(np.float64) * 2.0**-53) / width[at]
        alive = clock < limit[owner[at]]
        at, state, clock, drawn = at[alive], state[alive], clock[alive], drawn[alive]
        place = mix(drawn ^ _U(0xA0761D6478BD642F))
        register = (place % _U(REGISTERS)).astype(np.int64)
        level = width[at] + 1 + ((place >> _U(32)) % width[at].astype(_U)).astype(np.int64)
        counts = (strip[at] == 0) | (level <= weight[at])
        np.minimum.at(times, (owner[at] * REGISTERS + register)[counts], clock[counts])


@tidy
def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, block in blocks(batch.column(2), most=SIGNED_TOGETHER):
            n = len(block.sizes)
            value, owner = shingles(block, WORDS)
            times = signatures(value, owner, n)
            # Equal times are the same point; the register goes into the code.
            codes = mix(times.view(_U) ^ (np.arange(REGISTERS, dtype=_U) * _STEP)).view(np.int64)
            some = np.isfinite(times[:, 0])
            offsets = np.append(0, np.cumsum(np.where(some, REGISTERS, 0)))
            signature = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.array(codes[some].reshape(-1) >> 32, pa.int64()).cast(pa.int32()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), batch.column(1).slice(at, n), signature],
                names=["doc_id", "text_id", "signature"],
            )


@tidy
def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of each text as a set: the k-th occurrence of a shingle is an element."""
    for batch in batches:
        for at, block in blocks(batch.column(1)):
            n = len(block.sizes)
            value, owner, weight = multiset(*shingles(block, WORDS))
            which = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            elements = mix(np.repeat(value, weight) + which.astype(_U) * _STEP).view(np.int64)
            sizes = np.bincount(np.repeat(owner, weight), minlength=n)
            sets = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(elements)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), sets], names=["text_id", "elements"]
            )


def _members(texts: DataFrame) -> DataFrame:
    """Columns: bucket, text_id, signature; for each band in which a text has company."""
    bands = F.array(
        *[F.xxhash64(F.lit(k), F.slice("signature", k * ROWS + 1, ROWS)) for k in range(BANDS)]
    )
    rows = texts.where(F.size("signature") > 0).select("text_id", F.explode(bands).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return stored(rows.join(sizes, "bucket"))


def _dealt(rows: DataFrame, member: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))


def _copied(facts: DataFrame) -> DataFrame:
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_centres(members: DataFrame) -> DataFrame:
    """Members of large buckets with the centre of each: the text that has company in most of its
    bands, so the one closest to what all share."""
    company = members.groupBy("text_id").agg(F.sum(F.log2("size")).alias("company"))
    large = members.where(f"size > {SMALL_BUCKET}").join(company, "text_id")
    centres = large.groupBy("bucket").agg(
        F.max_by("text_id", F.struct("company", "text_id")).alias("centre")
    )
    found = _dealt(large, "text_id").join(_copied(centres), ["bucket", "salt"])
    return found.select("text_id", "centre").distinct()


def _candidates(members: DataFrame, centred: DataFrame) -> DataFrame:
    """Pairs to verify first: all pairs of small buckets, members of large ones with their centres.

    Columns: a, b, centred; b is a centre if centred, and otherwise neither has many partners.
    """
    few = members.where(f"size <= {SMALL_BUCKET}")
    pair = few.alias("x").join(few.alias("y"), "bucket").where("x.text_id < y.text_id")
    small = pair.selectExpr("x.text_id AS a", "y.text_id AS b", "CAST(NULL AS string) AS centre")
    star = centred.where("text_id <> centre").selectExpr("text_id AS a", "centre AS b", "centre")
    once = small.union(star).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return once.agg(F.max("centre").alias("centre")).selectExpr(
        "if(x <=> centre, y, x) AS a", "if(x <=> centre, x, y) AS b", "centre IS NOT NULL AS centred"
    )


def _sets(pairs: DataFrame, texts: DataFrame, documents: DataFrame) -> DataFrame:
    """Columns: text_id, elements; the multisets of all texts in `pairs`."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct()
    # One document stands for a text. Its id is part of the key, so that copies spread out.
    wanted = wanted.join(texts.select("text_id", "doc_id"), "text_id")
    found = documents.alias("d").join(
        wanted.alias("w"),
        F.expr("d.text_id = w.text_id AND d.doc_id <=> w.doc_id"),
        "left_semi",
    )
    sets = found.select("text_id", "text").mapInArrow(
        _elements, "text_id string, elements array<long>"
    )
    return stored(sets.dropDuplicates(["text_id"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose multisets overlap by SIMILARITY or more: a, b."""
    beside = pairs.join(sets.toDF("a", "x"), "a")
    few = beside.where("NOT centred").join(sets.toDF("b", "y"), "b")
    centres = pairs.where("centred").select(F.col("b").alias("text_id")).distinct()
    held = sets.join(centres, "text_id", "left_semi").toDF("b", "y")
    many = _dealt(beside.where("centred"), "a").join(_copied(held), ["b", "salt"])
    shared = "size(array_intersect(x, y))"
    columns = ["a", "b", f"{shared} AS shared", "size(x) + size(y) AS total"]
    return (
        few.selectExpr(*columns)
        .union(many.selectExpr(*columns))
        .where(f"shared / (total - shared) >= {SIMILARITY}")
        .select("a", "b")
    )


def _leftovers(centred: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that no centre showed: the members a centre left out against all that share it.

    The members outside the class of their centre are the queries; they and the members are cut into
    blocks of BLOCK texts, and each pair of blocks is compared exactly in a task of its own. Only
    links between different classes leave it, one for each text and class. Columns: a, b.
    """
    root = labels.withColumnRenamed("node", "text_id")
    rows = centred.join(root, "text_id", "left").select(
        "centre", "text_id", F.coalesce("root", "text_id").alias("root")
    )
    parts = rows.groupBy("centre", "root").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.expr("text_id = centre")).alias("main")
    )
    sizes = parts.groupBy("centre").agg(
        F.sum("n").alias("n"),
        F.expr("sum(if(main, 0, n))").alias("out"),
        F.expr("max(if(main, root, NULL))").alias("main"),
    )
    blocks_of = sizes.where("out > 0").select(
        "centre",
        "main",
        F.expr(f"cast(ceil(out / {BLOCK}) AS int)").alias("asked"),
        F.expr(f"cast(ceil(n / {BLOCK}) AS int)").alias("held"),
    )
    rows = _dealt(rows, "text_id").join(_copied(blocks_of), ["centre", "salt"])
    rows = rows.withColumn("left_out", F.expr("root <> main")).join(sets, "text_id")
    number = "pmod(xxhash64(text_id), {n})"
    asked = rows.where("left_out").select(
        "centre", "text_id", "root", "elements", F.lit(True).alias("asked"),
        F.expr(number.format(n="asked")).alias("i"),
        F.explode(F.expr("sequence(0L, held - 1L)")).alias("j"),
    )
    held = rows.select(
        "centre", "text_id", "root", "elements", F.lit(False).alias("asked"),
        F.explode(F.expr("sequence(0L, asked - 1L)")).alias("i"),
        F.expr(number.format(n="held")).alias("j"),
    )
    links = asked.unionByName(held).groupBy("centre", "i", "j").applyInArrow(
        _compare, "a string, b string"
    )
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _compare(table: pa.Table) -> pa.Table:
    """Links between the asked and the other texts of one pair of blocks."""
    asked = table.column("asked").to_numpy()
    ids = np.array(table.column("text_id").to_pylist(), object)
    roots = np.array(table.column("root").to_pylist(), object)
    lists = table.column("elements").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    owner, value = np.repeat(np.arange(len(ids)), sizes), lists.flatten().to_numpy()
    rows, columns = np.flatnonzero(asked), np.flatnonzero(~asked)
    place = np.zeros(len(ids), np.int64)
    place[rows], place[columns] = np.arange(len(rows)), np.arange(len(columns))
    both = np.intersect1d(value[asked[owner]], value[~asked[owner]])
    which = np.searchsorted(both, value)
    which[which == len(both)] = 0
    shared = np.zeros((len(rows), len(columns)), np.float32)
    if len(both):
        hit = both[which] == value
        owner, which = owner[hit], which[hit]
        for start in range(0, len(both), 4096):
            now = (which >= start) & (which < start + 4096)
            held = np.zeros((len(ids), min(4096, len(both) - start)), np.float32)
            held[owner[now], which[now] - start] = 1
            shared += held[rows] @ held[columns].T
    total = sizes[rows][:, None] + sizes[columns][None, :] - shared
    x, y = np.nonzero(shared >= SIMILARITY * total - 1e-4)
    exact = shared[x, y].astype(np.float64) / total[x, y].astype(np.float64) >= SIMILARITY
    x, y = rows[x[exact]], columns[y[exact]]
    links = {}
    for a, b in zip(x, y):
        if roots[a] != roots[b]:
            links.setdefault((a, roots[b]), b)
    pairs = [(ids[a], ids[b]) for (a, _), b in links.items()]
    return pa.table(
        {
            "a": pa.array([p[0] for p in pairs], pa.string()),
            "b": pa.array([p[1] for p in pairs], pa.string()),
        }
    )


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Columns: doc_id, class_id, text_id, n_links; one row per row of `documents`.

    `class_id` is the smallest doc_id of all documents joined by a chain of exact copies and of
    texts with a weighted Jaccard similarity of 0.8 or more. `n_links` counts the different texts
    whose link to this one was verified; links that would join one class with itself need not be. A null text is alone in its class: its
    class is its own doc_id, its text_id null. Texts without words, like texts of fewer than five
    words, are near-duplicates of equal ones only: the former of the same bytes, the latter of the
    same words. A null doc_id stays null and never names a class that has another id. Rows that
    repeat altogether are all returned. Other columns are ignored. Where a doc_id repeats with texts
    that are no near-duplicates, the classes it names have the same class_id.
    """
    return _classes(documents).drop("root")


def _classes(documents: DataFrame) -> DataFrame:
    """`near_duplicates` with `root`: a text_id that tells the classes apart, null for null texts."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    named = rows.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("text_id"), "text")
    signed = stored(named.mapInArrow(_sign, "doc_id long, text_id string, signature array<int>"))
    # Copies of a text have the same signature; they are put together first.
    texts = stored(
        signed.groupBy("text_id").agg(
            F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")
        )
    )
    members = _members(texts)
    centred = stored(_with_centres(members))
    pairs = stored(_candidates(members, centred))
    sets = _sets(pairs, texts, named)
    links = stored(_verified(pairs, sets))
    labels = stored(components(links))
    more = stored(_leftovers(centred, labels, sets))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("text_id"))
        .groupBy("text_id")
        .agg(F.count(F.lit(1)).alias("n_links"))
    )
    rooted = (
        texts.select("text_id", "doc_id")
        .join(labels.withColumnRenamed("node", "text_id"), "text_id", "left")
        .join(degree, "text_id", "left")
        .select("text_id", "doc_id", F.coalesce("root", "text_id").alias("root"), "n_links")
    )
    classes = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named_texts = rooted.join(classes, "root").select("text_id", "class_id", "n_links", "root")
    return (
        signed.select("doc_id", "text_id")
        .join(named_texts, "text_id")
        .select(
            "doc_id",
            "class_id",
            "text_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "root",
        )
        .unionByName(
            rows.where("text IS NULL").selectExpr(
                "doc_id",
                "doc_id AS class_id",
                "CAST(NULL AS string) AS text_id",
                "0L AS n_links",
                "CAST(NULL AS string) AS root",
            )
        )
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """`documents` with one row of each near-duplicate class: the one that names it.

    Of rows that repeat with the same doc_id and text one stays, and so does one of a class without
    any doc_id. Classes that a repeated doc_id names alike keep one each. Rows with a null text all
    stay. All columns are kept.
    """
    found = stored(_classes(documents).where("text_id IS NOT NULL"))
    named = found.where("doc_id <=> class_id")
    # A class has one class_id, and may share it with others.
    kept = named.groupBy("root", "class_id").agg(F.min("text_id").alias("kept_text"))
    rows = documents.select(
        F.struct("*").alias("document"),
        F.col("doc_id").cast("long").alias("id"),
        F.md5(F.col("text").cast("string")).alias("text_id"),
    )
    texts = rows.join(kept, F.expr("id <=> class_id AND text_id = kept_text"), "left_semi")
    if not named.groupBy("doc_id", "text_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id", "text_id"])
    return texts.unionByName(rows.where("text_id IS NULL")).select("document.*")
