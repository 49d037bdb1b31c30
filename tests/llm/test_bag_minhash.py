import random
import subprocess
import sys
from collections import Counter

import numpy as np

from tests.llm.frames import documents, edited, prose, rows
from tidemark.llm import bag_minhash
from tidemark.llm.components import components


def test_agreement_estimates_weighted_similarity():
    """Elements 0..39 with other weights on the two sides, over many independent codings."""
    rng = random.Random(5)
    weights = [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(40)]
    want = sum(min(w) for w in weights) / sum(max(w) for w in weights)
    agree = []
    for salt in range(60):
        value, owner = [], []
        for e, pair in enumerate(weights):
            for side in (0, 1):
                value += [(e + 1) * 1_000_003 + salt * 7_919_999] * pair[side]
                owner += [side] * pair[side]
        times = bag_minhash.signatures(np.array(value, np.uint64), np.array(owner), 2)
        agree.append((times[0] == times[1]).mean())
    assert abs(np.mean(agree) - want) < 0.02


def test_empty_multiset_has_no_signature():
    times = bag_minhash.signatures(np.array([3], np.uint64), np.array([1]), 2)
    assert np.isinf(times[0]).all() and np.isfinite(times[1]).all()


def classes(texts):
    """Smallest index of each text's class, by comparing all pairs."""
    bags = []
    for t in texts:
        w = t.split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else []))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            total = sum((bags[i] | bags[j]).values())
            if texts[i] == texts[j] or total and shared / total >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_classes_equal_brute_force(spark):
    base, other = prose(150, 1), prose(400, 2)
    texts = [edited(base, [3 * k % 140, 70 + k % 60], k) for k in range(40)]
    texts += [base, base, base + " end", other, edited(other, range(0, 400, 100)), edited(other, range(0, 400, 12))]
    texts += ["few words", "few  words", "few words here", "x y " * 40, "x y " * 41, "", "", " "]
    texts += [prose(80, 100 + k) for k in range(20)]
    df = documents(spark, list(enumerate(texts))).selectExpr("*", "1 AS text_id", "'q' AS document")
    want = classes(texts)
    got = dict(rows(bag_minhash.near_duplicates(df), "doc_id", "class_id"))
    assert [got[i] for i in range(len(texts))] == want
    kept = bag_minhash.keep_one(df)
    assert kept.columns == df.columns
    assert [r[0] for r in rows(kept, "doc_id")] == sorted(set(want), key=lambda x: repr((x,)))


def test_nulls_repeats_and_empty_table(spark):
    text = prose(30, 3)
    df = documents(spark, [(1, None), (2, None), (None, text), (4, text), (4, text), (None, "solo"), (None, "solo")])
    got = rows(bag_minhash.near_duplicates(df), "doc_id", "class_id")
    assert got == sorted([(1, 1), (2, 2), (None, 4), (4, 4), (4, 4), (None, None), (None, None)], key=repr)
    kept = rows(bag_minhash.keep_one(df), "doc_id", "text")
    assert kept == sorted([(1, None), (2, None), (4, text), (None, "solo")], key=repr)
    assert bag_minhash.near_duplicates(df.limit(0)).count() == 0
    assert bag_minhash.keep_one(df.limit(0)).count() == 0


def test_one_row_of_each_class_whatever_its_ids(spark):
    """Two classes named by the same doc_id; near copies without any doc_id, next to another text."""
    a, b, c, d = (prose(60, k) for k in (11, 12, 13, 14))
    found = [(5, a), (5, b), (8, edited(a, [30])), (9, edited(b, [30]))]
    bare = [(None, c), (None, c + " end"), (None, "end " + c), (None, d)]
    kept = rows(bag_minhash.keep_one(documents(spark, found + bare)), "doc_id", "text")
    assert [r for r in kept if r[0] is not None] == sorted([(5, a), (5, b)], key=repr)
    texts = [r[1] for r in kept if r[0] is None]
    assert len(texts) == 2 and d in texts and set(texts) < {t for _, t in bare}


def test_components(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 50), (50, 70), (100, 70), (9, 9), (None, 3), (30, 30)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(rows(components(df), "node", "root"))
    assert got == {k: 0 for k in range(21)} | {50: 50, 70: 50, 100: 50}
    assert components(df.limit(0)).count() == 0


def test_many_short_texts_take_little_memory():
    code = """
import resource
import pyarrow as pa
from tidemark.llm.bag_minhash import _sign
texts = pa.array([f"word{k}" for k in range(100_000)])
ids = pa.array(range(100_000))
batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["doc_id", "text_id", "text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(len(out) for out in _sign([batch])) == 100_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(grown.stdout) < 200 * 1024
