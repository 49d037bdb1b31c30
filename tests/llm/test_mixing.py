import re

import pytest

from tests.llm.frames import documents, prose, rows
from tidemark.llm import mixing
from pyspark.sql import functions as F


def water_levels(sizes):
    """Targets by repeated resharing, as a reader of the rule would do it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, target, full = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while len(full) < len(names):
        free = [s for s in names if s not in full]
        left = budget - sum(target[s] for s in full)
        for s in free:
            target[s] = left * weight[s] / sum(weight[f] for f in free)
        above = [s for s in free if target[s] > 2 * sizes[s]]
        if not above:
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            full.add(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 50, None: 400, "é": 7}, {"a": 0, "b": 9},
    {"x": 0}, {None: 5}, {f"s{k}": (k * 37) % 11 * 100 + k for k in range(30)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = dict(rows(mixing.targets(df), "source", "target"))
    want = water_levels(sizes)
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_apportionment_is_by_highest_quotients(spark):
    claims = {f"r{k}": (k * 7919 % 101) / 10 for k in range(25)}
    for seats in (0, 1, 7, 60, 300):
        df = spark.createDataFrame([("g", k, v, seats) for k, v in claims.items()],
                                   "g string, r string, claim double, seats long")
        got = dict(rows(mixing.apportion(df, ["g"], "claim", "seats", [F.asc("r")]), "r", "quota"))
        want = dict.fromkeys(claims, 0)
        for _ in range(seats):
            best = max(sorted(claims), key=lambda r: claims[r] / (2 * want[r] + 1))
            want[best] += 1
        assert got == want, seats


def corpus(spark):
    data = [(k, prose(20 + k * 13 % 90, k), None, ["a", "b", None, "c"][k % 4]) for k in range(120)]
    return documents(spark, data + [(500, None, None, "a"), (501, "", None, "d"), (502, " x ", None, "e")])


def test_taken_comes_near_targets_and_reruns_agree(spark):
    df = corpus(spark).selectExpr("*", "7 AS size", "'z' AS mark")
    out = mixing.mix(df, block_words=16, shard_words=500).collect()
    assert len(out) == 123
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    want = water_levels({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(rs[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(16, 0.02 * want[s])
    again = mixing.mix(df.repartition(5), block_words=16, shard_words=500)
    assert rows(again, "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in out), key=repr)


def test_documents_of_the_mix_hold_the_words_taken(spark):
    df = corpus(spark)
    taken = {r.doc_id: r.taken for r in mixing.mix(df, block_words=16, shard_words=500).collect()}
    mixed = mixing.mixed_documents(df, block_words=16, shard_words=500)
    assert mixed.schema.names == df.schema.names and dict(mixed.dtypes) == dict(df.dtypes)
    got = dict.fromkeys(taken, 0)
    texts = dict(rows(df, "doc_id", "text"))
    for doc_id, text, n in rows(mixed, "doc_id", "text", "n_chars"):
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert n == len(text) and set(found) <= set(texts[doc_id].split())
        got[doc_id] += len(found)
    assert got == taken


def test_empty_table(spark):
    assert mixing.mix(corpus(spark).limit(0)).count() == 0
    assert mixing.mixed_documents(corpus(spark).limit(0)).count() == 0
