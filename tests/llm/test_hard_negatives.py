"""Hard negatives and the trees below them against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import rows
from tidemark.llm import hard_negatives
from tidemark.llm.cover_tree import Forest, Tree, Windows, build
from tidemark.llm.queries import queries

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(data, is_anchor, k=5):
    """`data` is a list of (vec_id, label, vector), all distinct."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for anchor_id, label, q in data:
        if not is_anchor(anchor_id):
            continue
        scored = sorted((-dot(q, v), i, lab) for i, lab, v in data)
        positives = [(-s, i) for s, i, lab in scored if lab == label and i != anchor_id][:k]
        for high, positive in positives:
            fits = [(-s, i) for s, i, lab in scored if lab != label and 80 * high <= -100 * s <= 100 * high][:k]
            out += [(anchor_id, positive, n + 1, i, high, s) for n, (s, i) in enumerate(fits)]
    return sorted(out, key=repr)


def clustered(n, dims, seed, labels=4, size=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, size, (12, dims))
    vectors = np.floor(centres[rng.integers(0, 12, n)] + rng.normal(0, size / 4, (n, dims)))
    return [(k, int(rng.integers(0, labels)), [int(x) for x in v]) for k, v in enumerate(vectors)]


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, label int, vector array<long>")


@pytest.mark.parametrize("dims, seed", [(2, 0), (8, 1), (64, 2)])
def test_tree_covers_and_separates(dims, seed):
    data = clustered(900, dims, seed)
    vectors = np.array([v for *_, v in data])
    tree = Tree.unpack(build(vectors, np.array([lab for _, lab, _ in data]), [[k] for k, *_ in data]).pack())
    x = tree.vectors.astype(float)
    lifted = np.column_stack([x, np.sqrt(np.maximum(tree.length**2 - (x**2).sum(1), 0))])
    assert sorted(map(tuple, tree.vectors.tolist())) == sorted(map(tuple, vectors.tolist()))
    assert len(tree.centre) > 5
    for node, (a, b) in enumerate(tree.members):
        away = np.linalg.norm(lifted[a:b] - lifted[tree.centre[node]], axis=1)
        assert away.max() <= tree.radius[node] + 1e-6
        first, last = tree.children[node]
        if first < last:
            assert tree.members[first][0] == a and tree.members[last - 1][1] == b
            assert tree.radius[first:last].max() <= 0.7 * tree.radius[node] + 1e-6
            centres = lifted[tree.centre[first:last]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
            assert apart[~np.eye(len(centres), dtype=bool)].min() > 0.7 * tree.radius[node] - 1e-6


def test_descent_skips_most_of_clustered_vectors():
    data = clustered(6000, 8, 3)
    vectors, labels = np.array([v for *_, v in data]), np.array([lab for _, lab, _ in data])
    tree = build(vectors, labels, [[k] for k, *_ in data])
    forest = Forest([tree], vectors[:20], labels[:20], np.arange(20))
    found = forest.search(Windows(np.arange(20), np.full(20, -np.inf), np.full(20, np.inf)), 5, True)
    for q, best in enumerate(found):
        scores = vectors @ vectors[q]
        order = sorted((-int(s), k) for k, s in enumerate(scores) if labels[k] == labels[q] and k != q)
        assert best == [(-s, k) for s, k in order[:5]]
    assert forest.seen < 0.5 * 20 * len(data)


@pytest.mark.parametrize("dims, n, seed", [(1, 80, 0), (3, 400, 1), (16, 700, 2)])
def test_equals_brute_force(spark, monkeypatch, dims, n, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK", 150)
    monkeypatch.setattr(hard_negatives, "GROUP", 2)
    data = clustered(n, dims, seed)
    found = hard_negatives.hard_negatives(frame(spark, data), F.col("vec_id") % 20 == 0)
    assert rows(found, *COLUMNS) == brute(data, lambda i: i % 20 == 0)


def test_large_groups_of_copies(spark):
    rng = random.Random(1)
    data = clustered(200, 4, 4)
    data += [(1000 + k, rng.randrange(2), [30, -8, 5, 1]) for k in range(500)]
    found = hard_negatives.hard_negatives(frame(spark, data), F.col("vec_id") % 100 == 0)
    assert rows(found, *COLUMNS) == brute(data, lambda i: i % 100 == 0)


def test_edge_cases(spark):
    data = [(0, 1, [2, 0]), (0, 1, [2, 0]), (1, 1, [3, 0]), (2, 2, [3, 0]), (3, 2, [])]
    data += [(None, 2, [3, 0]), (4, None, [3, 0]), (5, 2, None), (6, 1, [-9, 0]), (7, 2, [-9, 0])]
    df = frame(spark, data).selectExpr("*", "1 AS key", "2 AS batch", "3 AS n", "4 AS cell")
    found = hard_negatives.hard_negatives(df, F.col("vec_id") == 0)
    # The second positive scores below 0 and opens no window.
    assert rows(found, *COLUMNS) == [(0, 1, 1, 2, 6, 6)]
    assert hard_negatives.hard_negatives(df, F.lit(False)).collect() == []
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).collect() == []
    large = [(0, 1, [1 << 29] * 4), (1, 1, [1 << 29] * 4), (2, 2, [(1 << 29) - 1, *[1 << 29] * 3])]
    found = hard_negatives.hard_negatives(frame(spark, large), F.col("vec_id") == 0)
    assert rows(found, *COLUMNS) == brute(large, lambda i: i == 0)


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    data = [([0.5, -0.001],), ([nan, 1.0],), ([inf],), ([-inf],), ([None],), (None,), ([],)]
    df = spark.createDataFrame(data, "x array<float>").select(hard_negatives.quantised("x", 256).alias("q"))
    assert [r.q for r in df.collect()] == [[128, -1], None, None, None, None, None, []]


def test_query_has_the_contract(spark):
    found = queries()["op11_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert found.columns == list(COLUMNS) and dict(found.dtypes)["rank"] == "int"
