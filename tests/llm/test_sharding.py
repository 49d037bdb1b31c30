"""Differencing against a plain version and against the best partition; shards by their law."""

import itertools
import random
import zlib

import pytest

from tests.llm.frames import documents, prose, rows
from tidemark.llm import sharding
from tidemark.llm.queries import queries


def plain(sizes, k):
    """Largest spreads first, on lists of lists, without any sharing."""
    parts = [[[] for _ in range(k - 1)] + [[s]] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: sum(p[-1]) - sum(p[0]))
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), key=sum))
    return sorted(map(sum, parts[0]))


def sums(sizes, shards, k):
    out = [0] * k
    for s, shard in zip(sizes, shards):
        out[shard] += s
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_differencing_equals_the_plain_version(seed):
    rng = random.Random(seed)
    k = rng.choice([2, 3, 5, 16])
    # Distinct powers leave no ties, which the two versions could break in other ways.
    sizes = rng.sample(range(1, 1 << 40), 60)
    assert sums(sizes, sharding.difference(sizes, k), k) == plain(sizes, k)


def test_differencing_beats_greedy_and_nears_the_best():
    rng = random.Random(3)
    worse = 0
    for _ in range(40):
        sizes = [rng.randrange(1, 1000) for _ in range(9)]
        spread = lambda s: s[-1] - s[0]
        best = min(spread(sums(sizes, p, 3)) for p in itertools.product(range(3), repeat=8) for p in [(0, *p)])
        greedy = [0, 0, 0]
        for s in sorted(sizes, reverse=True):
            greedy[greedy.index(min(greedy))] += s
        found = spread(sums(sizes, sharding.difference(sizes, 3), 3))
        assert best <= found
        worse += found > max(greedy) - min(greedy)
    assert worse <= 8


def test_differencing_of_few_sizes():
    assert sharding.difference([], 4) == []
    assert sums([5], sharding.difference([5], 4), 4) == [0, 0, 0, 5]
    assert sharding.difference([3, 9, 1], 1) == [0, 0, 0]
    assert sums([4] * 8, sharding.difference([4] * 8, 4), 4) == [8] * 4


def check(texts, found, n_shards=16):
    """The contract, from the texts by doc_id."""
    found = [tuple(r) for r in found.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert len(found) == len(texts)
    shard_of, slots, load = {}, {}, [0] * n_shards
    for (doc_id, size, crc, shard, slot) in found:
        text = (texts[doc_id] or "").encode()
        assert (size, crc) == (len(text) + 1, zlib.crc32(text))
        assert shard_of.setdefault(text, shard) == shard
        slots.setdefault(shard, []).append((slot, doc_id))
        load[shard] += size
    for numbered in slots.values():
        numbered.sort()
        assert [s for s, _ in numbered] == list(range(len(numbered)))
        assert [d for _, d in numbered] == sorted(d for _, d in numbered)
    return load


def test_shards_are_even_and_copies_stay_together(spark):
    rng = random.Random(1)
    texts = {k: prose(rng.randrange(1, 300), seed=k) for k in range(600)}
    texts |= {1000 + k: "a copy of this line" for k in range(400)}
    texts |= {2000: None, 2001: "", 2002: "é" * 9000, 2003: None}
    load = check(texts, sharding.shard_documents(documents(spark, list(texts.items()))))
    assert max(load) - min(load) <= 0.001 * sum(load)


def test_a_text_that_outweighs_a_shard_is_alone(spark):
    texts = {k: prose(20, seed=k) for k in range(300)} | {k: "hot " * 60 for k in range(500, 900)}
    found = sharding.shard_documents(documents(spark, list(texts.items())), 4)
    load = sorted(check(texts, found, 4))
    assert load[-1] == 400 * 241 and load[2] - load[0] <= 200


def test_edge_cases(spark, tmp_path):
    empty = sharding.shard_documents(documents(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    repeated = documents(spark, [(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, None)])
    found = rows(sharding.shard_documents(repeated), "doc_id", "size")
    assert found == sorted([(1, 2), (1, 2), (1, 2), (None, 2), (None, 1)], key=repr)
    clashing = documents(spark, [(1, "x"), (2, "y")]).selectExpr(
        "*", "1 AS shard", "2 AS size", "3 AS lump", "4 AS slot", "5 AS text_key", "6 AS document"
    )
    assert rows(sharding.shard_documents(clashing), "doc_id", "size") == [(1, 2), (2, 2)]
    sharding.write_shards(clashing, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, *clashing.columns) == rows(clashing, *clashing.columns)
    assert {r.shard_ for r in back.collect()} == {0, 1}
    with pytest.raises(ValueError, match="positive"):
        sharding.plan_shards(repeated, 0)


def test_plan_is_bounded_and_texts_stay_where_they_are(spark):
    docs = documents(spark, [(k, prose(5, seed=k)) for k in range(50)])
    assigned = sharding.assign_shards(docs, 2)
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sharding.plan_shards(docs, 2).count() <= 2 * 2 * sharding.LUMPS_PER_SHARD


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    docs = documents(spark, [(k, prose(5, seed=k % 40)) for k in range(90)])
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "doc_id", "text") == rows(docs, "doc_id", "text")
    expected = sharding.shard_documents(docs, 3)
    assert rows(back, "doc_id", "shard") == rows(expected, "doc_id", "shard")


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries()["op13_sharding"](spark, sf_dir)
    assert dict(found.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
        "shard": "int", "slot": "bigint", "grown_shard": "int",
    }
    load = check(texts, found)
    assert max(load) - min(load) <= 0.05 * sum(load) / 16
    assert rows(found, "doc_id", "shard") == rows(queries()["op13_sharding"](spark, sf_dir), "doc_id", "shard")
