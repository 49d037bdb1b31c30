"""Alignment of two tokenizations of the same text by anchors at white space.

Where a token that begins with a blank starts at the same byte in both, and so the tokens before it
end together, the text is cut. The pieces between such anchors are windows, a word or two each.

Both tokenizers begin a token at every lone blank between visible characters, whatever is around it,
so texts whose white space is regular are cut there before they are tokenized: each such window goes
through both tokenizers once, and is remembered by its text. Other texts go through both as a whole.
The tuple of ids in both vocabularies decides how a window of theirs aligns, so its alignment is
computed once and remembered by that tuple.

A group is what lies between two byte offsets where tokens of both end. A link is a pair of tokens
that end together. How often a pair of ids is linked is counted over the whole corpus.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.token_files import byte_alphabet, regular
from tidemark.session import stored

# Windows of more tokens are not remembered, and a full memory is emptied.
REMEMBERED_TOKENS, REMEMBERED = 64, 400_000
# Windows cut by their text have up to so many characters. Of those remembered, the earliest outlast a
# full memory.
PART_CHARACTERS, REMEMBERED_PARTS, LASTING_PARTS = 256, 400_000, 200_000
# Up to so many id pairs, at 16 bytes each, are sent to every executor; more are joined.
BROADCAST_PAIRS = 1_000_000
# Into how many parts the join deals each pair, as one pair can occur in every document.
SALTS = 16

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string,"
    " pairs array<long>, times array<int>"
)

_NAMES = [column.split()[0] for column in ALIGNED.split(", ")]

# Fixed value: the cutting pattern of byte-level tokenizers.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "We'll test  it:\n\n\t«Ünïcödé» 12345, 日本語!  <|endoftext|> don't\r\n"

# Added to ids of B in the key of a window.
_OF_B = 1 << 31
# Stands for a window whose bytes differ; no text has this byte.
_UNEQUAL = (b"\xff", "", b"")


def _byte_level_tokens(path: str) -> dict[bytes, int]:
    """Ids of the tokens of a byte-level tokenizer file, without the added ones, by their bytes."""
    from tokenizers import Tokenizer

    byte_of = {c: b for b, c in byte_alphabet().items()}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    # Added tokens may be listed with the others; they are not made of merged bytes.
    added = {t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()}
    return {bytes(byte_of[c] for c in t): k for t, k in vocabulary.items() if t not in added}


def _byte_level(path: str, tokens: dict[bytes, int]):
    """The tokenizer of the file as a tiktoken encoding, which takes less than half the time.

    Merges are tried in the order of ids there, so the file has to number its tokens as it merges them.
    """
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    encoding = Encoding(path, pat_str=_PATTERN, mergeable_ranks=tokens, special_tokens={})
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    if encoding.encode_ordinary(_PROBE) != library.encode(_PROBE, add_special_tokens=False).ids:
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    return encoding


class _Aligner:
    """Tokens of A, a byte-level tokenizer file, and B, a sentencepiece model, and their windows."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        tokens_a = _byte_level_tokens(a_path)
        self.a = _byte_level(a_path, tokens_a)
        self.b = SentencePieceProcessor(model_file=b_path)
        self.bytes_a = [b""] * (max(tokens_a.values()) + 1)
        for token, k in tokens_a.items():
            self.bytes_a[k] = token
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.size_a, self.blank_a = self._shape(self.bytes_a)
        self.size_b, self.blank_b = self._shape(self.bytes_b)
        # Size and decimal text of each id, as plain lists, which single look-ups are faster in.
        self.known_a, self.known_b = (
            [(len(t), str(k)) for k, t in enumerate(tokens)] for tokens in (self.bytes_a, self.bytes_b)
        )
        self.memory: dict[bytes, tuple[bytes, str, bytes]] = {}
        # Numbers of tokens, groups and linked pairs of windows by their text, and the windows that B
        # does not give back.
        self.parts: dict[str, tuple[int, int, str, bytes]] = {}
        self.unequal: set[str] = set()
        # No piece of B goes on behind the start of a word, so no merge crosses a blank.
        pieces = (self.b.id_to_piece(k).lstrip("▁") for k in range(len(self.bytes_b)))
        self.cuts_at_blanks = not any("▁" in x for x in pieces)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @staticmethod
    def _shape(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(t) for t in tokens]), np.array([t[:1] == b" " for t in tokens])

    def _window(self, key: bytes) -> tuple[bytes, str, bytes]:
        """Bytes, groups as text, and linked id pairs of a window, given by its ids in A and B."""
        found = self.memory.get(key)
        if found is None:
            ids = array("I", key).tolist()
            found = self._aligned([k for k in ids if k < _OF_B], [k - _OF_B for k in ids if k >= _OF_B])
            if len(ids) <= REMEMBERED_TOKENS:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[key] = found
        return found

    def _aligned(self, a: list[int], b: list[int]) -> tuple[bytes, str, bytes]:
        whole = b"".join(map(self.bytes_a.__getitem__, a))
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return _UNEQUAL
        known_a, known_b, groups, pairs = self.known_a, self.known_b, [], array("q")
        rest_a, rest_b = iter(a), iter(b)
        for i in rest_a:
            j = next(rest_b)
            (end_a, left), (end_b, right) = known_a[i], known_b[j]
            while end_a != end_b:
                if end_a < end_b:
                    i = next(rest_a)
                    size, text = known_a[i]
                    end_a, left = end_a + size, f"{left},{text}"
                else:
                    j = next(rest_b)
                    size, text = known_b[j]
                    end_b, right = end_b + size, f"{right},{text}"
            groups.append(f"{left}|{right}")
            pairs.append(i << 32 | j)
        return whole, ";".join(groups), pairs.tobytes()

    def _learn(self, parts: list[str]) -> None:
        for part, b in zip(parts, self.b.encode([p[1:] for p in parts], num_threads=1)):
            a = self.a.encode_ordinary(part)
            whole, groups, pairs = self._aligned(a, b)
            if whole != part.encode():
                self.unequal.add(part)
            self.parts[part] = len(a), len(b), groups, pairs

    def _cut(self, text: str) -> list[str]:
        """Windows of a text with a blank ahead; none if it has to be tokenized as a whole."""
        text = " " + text
        if not self.cuts_at_blanks or len(text) == 1 or not regular(text):
            return []
        parts = text.replace(" ", "\0 ").split("\0")[1:]
        return parts if max(map(len, parts)) <= PART_CHARACTERS else []

    def several(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """What a call gives for each of the texts."""
        cut = list(map(self._cut, texts))
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts = dict(islice(self.parts.items(), LASTING_PARTS))
            self.unequal &= self.parts.keys()
        needed = set().union(*cut)
        self._learn([p for p in needed if p not in self.parts])
        unequal = needed & self.unequal
        cut = [parts if unequal.isdisjoint(parts) else [] for parts in cut]
        rest = [text for text, parts in zip(texts, cut) if not parts]
        whole = iter(self.b.encode(rest, num_threads=1))
        for text, parts in zip(texts, cut):
            if parts:
                n_a, n_b, groups, pairs = zip(*map(self.parts.__getitem__, parts))
                yield sum(n_a), sum(n_b), ";".join(groups), np.frombuffer(b"".join(pairs), np.int64)
            else:
                yield self(text, next(whole))

    def __call__(self, text: str, b: list[int]) -> tuple[int, int, str, np.ndarray]:
        """Numbers of tokens, groups and linked pairs of a text, whose ids in B are given."""
        a = self.a.encode_to_numpy(" " + text, disallowed_special=())
        b = np.array(b, np.uint32)
        sizes_a, sizes_b = self.size_a[a], self.size_b[b]
        starts_a, starts_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
        marked_a, marked_b = np.flatnonzero(self.blank_a[a]), np.flatnonzero(self.blank_b[b])
        at_a, at_b = starts_a[marked_a], starts_b[marked_b]
        place = np.searchsorted(at_b, at_a)
        # A text begins a window even where no blank is marked, so an anchor at 0 adds none.
        shared = at_a == np.append(at_b, -1)[place]
        shared &= at_a > 0
        cuts_a = np.concatenate([[0], marked_a[shared], [len(a)]])
        cuts_b = np.concatenate([[0], marked_b[place[shared]], [len(b)]])
        # The ids of each window side by side, those of A first: its key is one slice.
        ids = np.empty(len(a) + len(b), np.uint32)
        ids[np.arange(len(a)) + np.repeat(cuts_b[:-1], np.diff(cuts_a))] = a
        ids[np.arange(len(b)) + np.repeat(cuts_a[1:], np.diff(cuts_b))] = b + _OF_B
        whole, cuts = ids.tobytes(), (4 * (cuts_a + cuts_b)).tolist()
        keys = [whole[i:j] for i, j in zip(cuts, cuts[1:])]
        windows = list(map(self.memory.get, keys))
        if None in windows:
            windows = [w or self._window(key) for w, key in zip(windows, keys)]
        # Windows cut both token lists at the same places, so where each has the same bytes in both
        # and all of them make up the text, both tokenizers give it back.
        if b"".join([w[0] for w in windows]) != b" " + text.encode():
            return 0, 0, "", np.zeros(0, np.int64)
        linked = np.frombuffer(b"".join([w[2] for w in windows]), np.int64)
        return len(a), len(b), ";".join([w[1] for w in windows]), linked


@cache
def _aligner(a_path: str, b_path: str) -> _Aligner:
    """One memory per worker process, which serves all of its tasks."""
    return _Aligner(a_path, b_path)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _align(a_path: str, b_path: str, keep_groups: bool):
    def aligned(aligner: _Aligner, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, at = batch.column(1), 0
        while at < len(batch):
            # Rows of about 2 MB of text go through together.
            part, size = [], 0
            while at + len(part) < len(batch) and size < 2 << 20:
                part.append(texts[at + len(part)].as_py() or "")
                size += len(part[-1])
            rows, digests, pairs, times = [], [], [], []
            for n_a, n_b, groups, linked in aligner.several(part):
                digests.append(hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
                # Tokens have a byte at least, so at each shared end one token of each is linked.
                rows.append((n_a, n_b, len(linked), groups if keep_groups else None))
                distinct, n = np.unique(linked, return_counts=True)
                pairs.append(distinct)
                times.append(n)
            n_a, n_b, n_groups, groups = zip(*rows)
            columns = [
                batch.column(0).slice(at, len(part)),
                *[pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups)],
                pa.array(digests, pa.string()),
                pa.array(groups, pa.string()),
                _lists(pairs, pa.int64()),
                _lists(times, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
            at += len(part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        # Nothing here makes cycles, and looking for them among the windows takes a tenth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                yield from aligned(aligner, batch)
        finally:
            if collecting:
                gc.enable()

    return run


def align(documents: DataFrame, a_path: str, b_path: str, *, keep_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups_sha256, groups, pairs, times.

    `a_path` is a byte-level tokenizer file, `b_path` a sentencepiece model that puts a blank before
    the text; A encodes the text behind a blank as well. Strings of special tokens are plain text.
    `groups` reads `a1,a2|b1;a3|b2,b3`: ids of A and B up to each shared end; it is null unless
    `keep_groups` is set. `pairs` holds the linked id pairs, id of A times 2**32 plus id of B, in
    ascending order, and `times` how many links of the document hold each.

    A text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens:
    zeros, empty lists, and an empty digest. Other columns are ignored; repeated rows and doc_ids
    each give their row, an empty table none. A long text without blanks is one window, aligned in
    one pass over its tokens.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_align(a_path, b_path, keep_groups), ALIGNED)


def _links(aligned: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per document and linked pair: the columns to keep, pair, n."""
    entry = F.explode(F.arrays_zip("pairs", "times")).alias("link")
    return aligned.select(*keep, entry).select(
        *[c for c in keep], F.col("link.pairs").alias("pair"), F.col("link.times").alias("n")
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Columns: pair, a_id, b_id, links, is_best, over the whole corpus.

    `links` is the number of links that hold the pair, `is_best` whether no pair with this id of B
    has more. Pairs are summed before they are shuffled, and an id of B meets at most the vocabulary
    of A.
    """
    counts = _links(aligned).groupBy("pair").agg(F.sum("n").alias("links")).select(
        "pair",
        F.shiftright("pair", 32).cast("int").alias("a_id"),
        F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"),
        "links",
    )
    return counts.withColumn("is_best", F.expr("links = max(links) OVER (PARTITION BY b_id)"))


def with_corpus_counts(
    aligned: DataFrame, pairs: DataFrame, *, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Adds n_best and count_sum to the rows of `aligned`; `place` must tell its rows apart.

    `n_best` counts a document's links whose pair is the best of its id of B, `count_sum` adds up
    `links` of all its links. Both are 0 without links. `pairs` are counted first: up to
    `broadcast_pairs` are sent to the executors, more are joined, dealt by salt.
    """
    known = pairs.select("pair", "links", "is_best")
    links = _links(aligned, "place")
    if known.count() <= broadcast_pairs:
        found = links.join(F.broadcast(known), "pair")
    else:
        dealt = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salt = F.pmod("place", F.lit(SALTS)).cast("int").alias("salt")
        found = links.select("*", salt).join(dealt.hint("merge"), ["pair", "salt"])
    sums = found.groupBy("place").agg(
        F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("links")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "place", "left").withColumns({
        "n_best": F.coalesce("n_best", zero),
        "count_sum": F.coalesce("count_sum", zero),
    })


def align_corpus(documents: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """`align` with n_links, n_best and count_sum; the alignments are stored in between."""
    aligned = align(documents, a_path, b_path, **options)
    # Written once, so that the number of a row is the same wherever it is read.
    kept = stored(aligned.withColumn("place", F.monotonically_increasing_id()))
    pairs = stored(pair_counts(kept))
    return with_corpus_counts(kept, pairs).withColumn("n_links", F.col("n_groups")).drop("place")
