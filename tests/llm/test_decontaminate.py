from collections import Counter

from tests.llm.frames import documents, edited, prose, rows
from tidemark.llm import decontaminate


def brute(text, item):
    """Highest weighted similarity of a window of the item's length, and where it first reaches 0.8."""
    w, b = (text or "").split(), (item or "").split()
    size = min(len(w), len(b))
    if size < 5 or len(b) < 5:
        return None
    def bag(x):
        return Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    want, best, starts = bag(b), 0, []
    for s in range(len(w) - size + 1):
        have = bag(w[s : s + size])
        sim = sum((have & want).values()) / sum((have | want).values())
        best = max(best, sim)
        if sim >= 0.8:
            starts.append(s)
    return (round(best, 9), starts[0], len(starts)) if starts else None


def test_equals_brute_force(spark):
    items = [prose(30, 1), prose(60, 2), prose(60, 3), "a b c d e " * 8, "a b c", "", None, "p q r s t", prose(30, 1)]
    texts = [
        prose(50, 10) + " " + items[0] + " " + prose(40, 11),
        edited(items[1], [30]), edited(items[1], [20, 40]), edited(items[2], [0, 59]) + " " + prose(9, 5),
        " ".join(items[0].split()[:27]), " ".join(items[0].split()[:20]), "x " * 20 + "a b c d e " * 7, "a b c d e " * 30,
        None, "", "a b c", "p q r s t", "z p q r s t z", prose(300, 20), items[2] + " " + items[1] + " " + items[2],
    ]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, prose(40, 9))], "item_id long, text string")
    df = documents(spark, list(enumerate(texts)) + [(0, texts[0])]).selectExpr("*", "1 AS n", "2 AS mark", "'i' AS item_id")
    got = {
        (d, i): (round(s, 9), start, n)
        for d, i, s, start, n in rows(
            decontaminate.contamination(df, bench), "doc_id", "item_id", "similarity", "start", "n_windows"
        )
    }
    want = {
        (d, i): found
        for d, t in enumerate(texts) for i, x in enumerate(items) if (found := brute(t, x))
    }
    assert got == want
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {r[0] for r in rows(kept, "doc_id")} == set(range(len(texts))) - {d for d, _ in want}


def test_blocks_find_all_within_the_radius():
    """Any two fingerprints within the radius share a listed block value."""
    import random
    rng = random.Random(3)
    masks = [set(decontaminate._flips(b)) for b in decontaminate.BLOCK_BITS]
    assert sum(decontaminate.BLOCK_BITS) == 64
    for _ in range(500):
        flipped = sum(1 << k for k in rng.sample(range(64), decontaminate.RADIUS))
        shift, hit = 0, False
        for bits, mask in zip(decontaminate.BLOCK_BITS, masks):
            hit |= (flipped >> shift) & ((1 << bits) - 1) in mask
            shift += bits
        assert hit


def test_parts_give_the_same_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(1, prose(30, 1)), (2, prose(25, 2))], "item_id long, text string")
    df = documents(spark, [(1, prose(20, 4) + " " + prose(30, 1)), (2, prose(25, 2)), (3, prose(50, 7)), (None, prose(25, 2))])
    whole = rows(decontaminate.contamination(df, bench), "doc_id", "item_id", "similarity")
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 10)
    assert rows(decontaminate.contamination(df, bench), "doc_id", "item_id", "similarity") == whole
    assert {r[:2] for r in whole} == {(1, 1), (2, 2), (None, 2)}
    assert rows(decontaminate.clean(df, bench), "doc_id") == [(3,)]
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == 4
