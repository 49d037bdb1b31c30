import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tests.llm.frames import documents, prose
from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import COVERS, remove_repeats


def brute(texts, length=100):
    """(kept, spans) of each text, given in document order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        covered = [False] * len(data)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                covered[p : p + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(c and (not i or not covered[i - 1]) for i, c in enumerate(covered))
        out.append((kept, spans))
    return out


@pytest.mark.parametrize("modulus", COVERS)
def test_covers_hold_every_difference(modulus):
    cover = COVERS[modulus]
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


@pytest.mark.parametrize("length", [100, 60])
def test_equals_brute_force(spark, length):
    shared, line = prose(60, 1), "é" * 70
    texts = [
        prose(200, 2), None, "", prose(10, 3) + " " + shared, shared + prose(40, 4), prose(200, 2),
        prose(50, 5) + shared[7:150] + prose(50, 6), line * 5, line, shared[3:102], shared[3:103],
        "a" * 1000, "b" + "a" * 150, prose(200, 2)[:-1] + "x", shared + shared,
    ]
    df = documents(spark, [(i * 7, t) for i, t in enumerate(texts)]).selectExpr("*", "1 AS tie", "2 AS did")
    out = {r.doc_id: r for r in remove_repeats(df, length).collect()}
    for i, (kept, spans) in enumerate(brute(texts, length)):
        row = out[i * 7]
        assert hashlib.sha256(row.kept).digest() == hashlib.sha256(kept).digest(), i
        assert len(row.spans) == spans and row.n_bytes == len((texts[i] or "").encode())


@pytest.mark.parametrize("packet", [1, 400, 1 << 20])
def test_many_buckets_and_a_string_in_a_third_of_all_documents(spark, monkeypatch, packet):
    """Whatever the packets, also with rows that repeat within one and across several."""
    monkeypatch.setattr(suffix_dedup, "PACKET", packet)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1000)
    shared = prose(40, 1)
    texts = [
        prose(20, 100 + k) + (" " + shared + " " if k % 3 == 0 else " ") + prose(20, 200 + k)
        for k in range(60)
    ]
    found = [(i, t) for i, t in enumerate(texts)]
    df = documents(spark, found[::-1] + found[:9] + found[:3]).repartition(3)
    out = {}
    for r in remove_repeats(df).collect():
        out.setdefault(r.doc_id, set()).add((bytes(r.kept), len(r.spans)))
    assert out == {i: {row} for i, row in enumerate(brute(texts))}


def test_marks_are_one_row_a_packet_and_bucket(spark):
    """Rows between the passes do not grow with the documents that share a packet."""
    cover = suffix_dedup._Cover(100)
    text = prose(100, 1)
    ids = pa.array(range(50))
    batch = pa.RecordBatch.from_arrays(
        [ids, ids, pa.array([f"{k} {text}" for k in range(50)])], names=["did", "tie", "text"]
    )
    packed = pa.Table.from_batches(suffix_dedup._samples(cover, 7)([batch]))
    assert sorted(packed.column("bucket").to_pylist()) == list(range(7))
    marks = pa.concat_tables(
        suffix_dedup._rank_samples(packed.filter(pc.equal(packed["bucket"], b))) for b in range(7)
    )
    assert len(marks) <= 7
    merged = suffix_dedup._merge_marks(marks)
    assert merged.column("did").to_pylist() == sorted(set(merged.column("did").to_pylist()))


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = prose(100, 9)
    df = documents(spark, [(5, text), (5, text), (None, text), (6, text)])
    out = sorted(((r.doc_id or -1), len(r.kept)) for r in remove_repeats(df).collect())
    assert out == [(-1, len(text)), (5, 0), (5, 0), (6, 0)]
    assert remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(df, 20)
