"""Alignment against a plain version that uses the tokenizer libraries and no windows."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from tests.llm.frames import documents, prose, rows
from tidemark.llm import alignment
from tidemark.llm.queries import PIECES, TOKENIZER, queries
from tidemark.session import stored

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Plain:
    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(TOKENIZER)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=PIECES)
        # The same vocabulary is given as bytes and ranks in another file.
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as ranks:
            entries = [line.split() for line in ranks]
        self.bytes_a = {int(k): base64.b64decode(t) for t, k in entries}

    def tokens(self, text):
        """Lists of (id, bytes) of both, or None if one does not give the text back."""
        if not text:
            return None
        a = [(k, self.bytes_a[k]) for k in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in self.b.encode(text):
            piece = self.b.id_to_piece(k)
            byte = bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else None
            b.append((k, byte or piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        same = b"".join(t for _, t in a) == b"".join(t for _, t in b) == whole
        return (a, b) if same else None

    def corpus(self, texts):
        aligned = {}
        for doc_id, text in texts.items():
            both = self.tokens(text)
            if both is None:
                aligned[doc_id] = (0, 0, [], [], "")
                continue
            ends = []
            for tokens in both:
                at, out = 0, {}
                for n, (_, t) in enumerate(tokens):
                    at += len(t)
                    out[at] = n
                ends.append(out)
            groups, links, i, j = [], [], 0, 0
            for end in sorted(ends[0].keys() & ends[1].keys()):
                to_i, to_j = ends[0][end] + 1, ends[1][end] + 1
                sides = both[0][i:to_i], both[1][j:to_j]
                groups.append("|".join(",".join(str(k) for k, _ in side) for side in sides))
                links.append((sides[0][-1][0], sides[1][-1][0]))
                i, j = to_i, to_j
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            aligned[doc_id] = (len(both[0]), len(both[1]), groups, links, digest)
        count = Counter(link for *_, links, _ in aligned.values() for link in links)
        best = Counter()
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        return sorted(
            (
                (
                    doc_id, n_a, n_b, len(groups), len(links),
                    sum(count[link] == best[link[1]] for link in links),
                    sum(count[link] for link in links), digest,
                )
                for doc_id, (n_a, n_b, groups, links, digest) in aligned.items()
            ),
            key=repr,
        )


@pytest.fixture(scope="module")
def plain():
    return Plain()


def odd_texts():
    rng = random.Random(5)
    alphabet = [" ", " ", "\n", "\t", "a", "the", "é", "ß", "中文", "🙂", "<s>", "</s>", "<0x41>", "0", "12", "…", " ", "'s", "."]
    texts = {k: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for k in range(150)}
    texts |= {
        200: None, 201: "", 202: " ", 203: "  two  blanks  ", 204: "\n", 205: "a▁b", 206: "<|endoftext|> x <|endoftext|>",
        207: "\x00\x01 nul", 208: "x" * 5000, 209: "é" * 3000 + " end", 210: prose(4000, 1), 211: "end ", 212: "<unk> <s> </s>",
        213: "ﬁ ligature ①", 214: "word " * 700,
    }
    return texts


def test_equals_the_plain_version(spark, plain):
    texts = odd_texts()
    found = alignment.align_corpus(documents(spark, list(texts.items())), TOKENIZER, PIECES)
    assert rows(found, *COLUMNS) == plain.corpus(texts)


def test_joined_pairs_give_what_broadcast_pairs_give(spark):
    texts = {k: prose(50, seed=k % 7, vocabulary=30) for k in range(40)} | {99: None}
    aligned = alignment.align(documents(spark, list(texts.items())), TOKENIZER, PIECES)
    kept = stored(aligned.selectExpr("*", "monotonically_increasing_id() AS place"))
    pairs = stored(alignment.pair_counts(kept))
    joined = alignment.with_corpus_counts(kept, pairs, broadcast_pairs=0)
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    sent = alignment.with_corpus_counts(kept, pairs)
    assert rows(joined, "doc_id", "n_best", "count_sum") == rows(sent, "doc_id", "n_best", "count_sum")


def test_windows_are_remembered_by_their_ids():
    aligner = alignment._Aligner(TOKENIZER, PIECES)
    for text in ("over and over and over", "and over again"):
        aligner(text, aligner.b.encode(text))
    # " over", " and" and " again": nothing else was aligned.
    assert len(aligner.memory) == 3
    text = "a" * 3000
    aligner(text, aligner.b.encode(text))
    assert len(aligner.memory) == 3


def test_windows_of_regular_texts_are_tokenized_once(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_PARTS", 6)
    monkeypatch.setattr(alignment, "LASTING_PARTS", 3)
    aligner, whole = alignment._Aligner(TOKENIZER, PIECES), alignment._Aligner(TOKENIZER, PIECES)
    texts = [text or "" for text in odd_texts().values()]
    for _ in range(2):
        for text, found in zip(texts, aligner.several(texts), strict=True):
            want = whole(text, whole.b.encode(text))
            assert found[:3] == want[:3] and found[3].tolist() == want[3].tolist(), text
    aligner = alignment._Aligner(TOKENIZER, PIECES)
    list(aligner.several(["over and over", "and over again", "a" * 3000, "two  blanks"]))
    assert aligner.parts.keys() == {" over", " and", " again"}


def test_groups_and_edge_cases(spark):
    docs = documents(spark, [(1, "on and on"), (1, "on and on"), (None, "on"), (2, None)])
    clashing = docs.selectExpr("*", "1 AS place", "2 AS pairs", "3 AS pair", "4 AS salt", "5 AS links")
    found = alignment.align_corpus(clashing, TOKENIZER, PIECES, keep_groups=True).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 4 and by_id[2].groups == "" and by_id[2].groups_sha256 == ""
    assert len(by_id[1].groups.split(";")) == 3 == by_id[1].n_links
    assert by_id[1].count_sum == 5 + 2 + 5
    nothing = alignment.align_corpus(documents(spark, []), TOKENIZER, PIECES)
    assert nothing.collect() == []


def test_query(spark, plain):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries()["op12_alignment"](spark, sf_dir)
    assert rows(found, *COLUMNS) == plain.corpus(texts)
