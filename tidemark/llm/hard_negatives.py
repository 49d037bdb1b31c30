"""Hard negatives by inner product: rows of other labels that score nearly as high as a positive.

Rows with the same vector and label have the same score with every anchor, so only the smallest ids
of them can be returned: they become one candidate. Candidates are put in order of a few pivots of a
bounded sample and cut into blocks, each with a cover tree of its own, and the trees are searched for
batches of anchors, two times: for the positives, then for the windows that their scores open.
Results are exact whatever the sample: the bounds come from the covering radii of the trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cover_tree import Forest, Tree, Windows, build
from tidemark.session import stored

SAMPLE, PIVOTS = 4096, 64
BLOCK = 8192
# Blocks searched together, and anchors that search together.
GROUP, BATCH = 8, 64


def quantised(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component as array<long>; null unless all are finite numbers."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: (x.cast("double") < infinite) & (x.cast("double") > -infinite))
    return F.when(F.coalesce(finite, F.lit(False)), scaled)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column; shorter ones end in zeros, which no inner product sees."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def pivots(candidates: DataFrame) -> np.ndarray:
    """Vectors far from each other, of a sample of `SAMPLE` candidates, the first by hash."""
    sample = candidates.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE)
    rows = _matrix(pa.array([r.vector for r in sample.collect()], pa.list_(pa.int64())))
    if not len(rows):
        return rows.astype(np.float64)
    rows, chosen = rows.astype(np.float64), [0]
    away = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(rows)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _located(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the squared distance from it."""

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector")).astype(np.float64)
            width = max(vectors.shape[1], centres.shape[1])
            x, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, centres))
            away = (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)
            cell = away.argmin(axis=1)
            near = away[np.arange(len(x)), cell]
            yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column(
                "away", pa.array(near, pa.float64())
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(locate, f"{schema}, cell int, away double")


def _in_place(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Neighbours side by side: rows by pivot and by their distance from it."""
    keys = ("cell", "away", "label", "vector")
    return _located(rows, centres).repartitionByRange(*keys).sortWithinPartitions(*keys)


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One packed tree per `BLOCK` candidates in the order in which they come."""
    waiting: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting).combine_chunks()
        vectors = _matrix(table.column("vector").combine_chunks())
        labels = table.column("label").to_numpy()
        tree = build(vectors, labels, table.column("ids").to_pylist())
        waiting.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([tree.pack()], pa.binary()), pa.array([len(labels)], pa.int32())],
            names=["tree", "size"],
        )

    for batch in batches:
        while len(batch):
            room = BLOCK - sum(map(len, waiting))
            waiting.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(map(len, waiting)) == BLOCK:
                yield packed()
    if waiting:
        yield packed()


def _search(best_of: int, same_label: bool):
    def run(unit: pa.Table) -> pa.Table:
        trees = [Tree.unpack(t) for t in unit.column("tree").to_pylist()]
        anchors = pa.Table.from_struct_array(unit.column("anchors").combine_chunks()[0].values)
        vectors = _matrix(anchors.column("vector").combine_chunks())
        labels, ids = (anchors.column(c).to_numpy() for c in ("label", "vec_id"))
        forest = Forest(trees, vectors, labels, ids)
        keys, windows = anchors.column("key").to_pylist(), anchors.column("windows").to_pylist()
        flat = [(at, w["low"], w["high"]) for at, ws in enumerate(windows) for w in ws]
        query, low, high = zip(*flat) if flat else ((), (), ())
        unbounded = [-np.inf if x is None else x for x in low], [np.inf if x is None else x for x in high]
        bounds = Windows(np.array(query, np.int64), *map(np.array, unbounded))
        found = forest.search(bounds, best_of, same_label)
        rows = [
            {"key": keys[at], "high": top, "score": score, "vec_id": vec_id}
            for (at, _, top), best in zip(flat, found)
            for score, vec_id in best
        ]
        return pa.Table.from_pylist(rows, _FOUND)

    return run


_FOUND = pa.schema([(c, pa.int64()) for c in ("key", "high", "score", "vec_id")])


def _best(anchors: DataFrame, blocks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The first `k` rows of each anchor's windows over all blocks: key, high, rank, vec_id, score."""
    groups = max(1, -(-blocks.count() // GROUP))
    batches = anchors.groupBy(F.shiftright("key", 6).alias("batch")).agg(
        F.collect_list(F.struct("key", "vec_id", "label", "vector", "windows")).alias("anchors")
    )
    # Every batch meets every group of blocks once: a stated set of queries against all rows.
    meeting = batches.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    dealt = blocks.select("tree", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))
    units = meeting.join(dealt, "group").groupBy("batch", "group")
    found = units.applyInArrow(
        _search(k, same_label), "key long, high long, score long, vec_id long"
    )
    order = Window.partitionBy("key", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    *,
    n_positives: int = 5,
    n_negatives: int = 5,
    lowest: tuple[int, int] = (4, 5),
) -> DataFrame:
    """Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` have vec_id, label and vector (array of integers); `anchors` is a condition on them that
    chooses the anchors. The score of two rows is their inner product. An anchor's positives are the
    first `n_positives` rows of its label with another id, by score and then by smaller id. The
    negatives of a positive are the first `n_negatives` rows of other labels that score at most as
    high as the positive and at least `lowest` (a fraction) of it; a positive that scores below 0
    has none.

    Rows with a null id, label or vector take no part. A row that repeats altogether counts once; rows
    that share an id but differ are different rows. Shorter vectors count as ending in zeros, so an
    empty one scores 0. Ties go to smaller ids. Other columns are ignored, and an empty table, or one
    without anchors, gives an empty result. Scores that do not fit a long raise an error.
    """
    known = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<long>").alias("vector"),
        anchors.alias("is_anchor"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    distinct = stored(known.groupBy("vec_id", "label", "vector").agg(F.bool_or("is_anchor").alias("is_anchor")))
    # Copies are cut to the ids that can matter before they are shuffled.
    copies = Window.partitionBy("label", "vector").orderBy("vec_id")
    few = distinct.withColumn("n", F.row_number().over(copies)).where(
        F.col("n") <= max(n_positives + 1, n_negatives)
    )
    candidates = stored(
        few.groupBy("label", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    centres = pivots(candidates)
    blocks = stored(
        _in_place(candidates, centres)
        .select("vector", "label", "ids")
        .mapInArrow(_trees, "tree binary, size int")
        .withColumn("block", F.monotonically_increasing_id())
    )
    chosen = distinct.where("is_anchor").drop("is_anchor")
    everything = F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    # Numbered once: the number of an anchor also says which batch it belongs to.
    asking = stored(
        _in_place(chosen, centres)
        .drop("cell", "away")
        .withColumn("key", F.monotonically_increasing_id())
    )
    positives = stored(_best(asking.withColumn("windows", everything), blocks, n_positives, True))
    over, under = lowest
    # Not below a fraction of the positive's score, as a whole number.
    low = F.ceil(F.col("score").cast("decimal(20,0)") * over / F.lit(under)).cast("long").alias("low")
    window = F.struct(low, F.col("score").alias("high"))
    opened = positives.where("score >= 0").groupBy("key").agg(F.collect_set(window).alias("windows"))
    negatives = _best(asking.join(opened, "key"), blocks, n_negatives, False)
    return (
        positives.select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("high"))
        .join(negatives, ["key", "high"])
        .join(asking.select("key", F.col("vec_id").alias("anchor_id")), "key")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            F.col("high").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
