import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.frames import prose
from tidemark.llm import textbytes
from tidemark.llm.textbytes import PIECE_BYTES, blocks, fingerprints, multiset, shingles

TEXTS = ["", None, " \t\n", "a", " a b\x0bc ", "é x y", "a b a b a b a b", prose(300), "x " * 50]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").encode())


def test_words_match_the_pattern():
    for _, block in blocks(pa.array(TEXTS)):
        starts, ends, counts = block.words()
        found = [block.data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert found == [w for t in TEXTS for w in split(t)]
        assert counts.tolist() == [len(split(t)) for t in TEXTS]


def test_blocks_cover_all_texts_and_slices():
    texts = pa.array(TEXTS * 3).slice(2, 20)
    for limit in (1, 50, 10_000):
        seen = [
            block.data[a:b].tobytes().decode()
            for _, block in blocks(texts, limit)
            for a, b in zip(block.offsets, block.offsets[1:])
        ]
        assert seen == [t.as_py() or "" for t in texts]
    assert list(blocks(pa.array([], pa.string()))) == []


def test_fingerprints_depend_on_bytes_only():
    _, block = next(blocks(pa.array(["abcabc", "xabc"])))
    sums = block.sums()
    starts = np.array([0, 3, 7, 1])
    codes = fingerprints(sums, starts, starts + 3)
    assert codes[0] == codes[1] == codes[2] != codes[3]


def test_shingles_as_multisets():
    value, owner, count = multiset(*shingles(next(blocks(pa.array(TEXTS)))[1], 5))
    names = {}
    for v, o, c in zip(value.tolist(), owner.tolist(), count.tolist()):
        names.setdefault(o, Counter())[v] = c
    for k, text in enumerate(TEXTS):
        w = split(text)
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        assert sorted(names.get(k, {}).values()) == sorted(Counter(runs).values())


def test_crafted_strings_differ():
    """Strings whose polynomials differ by a product of many even factors, and one with its pieces in
    another order."""
    turned = {"a": "b", "b": "a"}
    text = "a"
    while len(text) < 4096:
        text += "".join(turned[c] for c in text)
    pieces = [prose(40, k)[:PIECE_BYTES] for k in range(8)]
    pairs = [(text[:n], "".join(turned[c] for c in text[:n])) for n in (64, 128, 1024, 2048, 4096)]
    pairs.append(("".join(pieces), "".join(pieces[::-1])))
    for x, y in pairs:
        (_, block), = blocks(pa.array([x, y, x]))
        for lane in (0, 1):
            found = fingerprints(block.sums(lane), block.offsets[:-1], block.offsets[1:])
            assert found[0] == found[2] != found[1]


def test_a_task_gives_its_powers_back():
    def run(batches):
        for batch in batches:
            textbytes._POWERS.reach(1 << 16)
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array(["a"])], names=["text"])
    tasks = textbytes.tidy(run)([batch])
    assert next(tasks) is batch and len(textbytes._POWERS.up) > 1
    assert list(tasks) == [] and len(textbytes._POWERS.up) == 1
