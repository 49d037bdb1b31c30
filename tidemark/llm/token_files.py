"""Token ids of documents in Parquet, for selective reads of ids and of metadata.

One row per document in ascending order, with the ids as a list column. Ids are dictionary or delta
encoded by the Parquet writer, row groups have a set size, and page indexes let a reader skip to the
pages that hold the wanted documents. The metadata columns can be read without touching the ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.textbytes import Block, blocks, tidy
from tidemark.session import shared_folder, small_batches, stored

END = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
# Texts of so many bytes are encoded together.
BLOCK_BYTES = 1 << 20
# Parts whose ids are remembered, and how many of them, the earliest, outlast a full memory.
_REMEMBERED, _LASTING = 500_000, 250_000
_CUT = re.compile(r" (?=\S)")
# A word of Latin letters and the marks behind it, which are a piece each.
_WORD = re.compile(r"( ?[^\W\d_\u0250-\U0010ffff]+)([^\w\s'\u0250-\U0010ffff]*)")
# Byte-level alphabet: bytes without a printable character of their own follow after 255.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
_ALPHABET = {b: 256 + k for k, b in enumerate(_HIDDEN)}

# Kinds of bytes that tell where a text may be cut. Beyond ASCII, white space begins with one of `_LEAD`.
_LETTER, _MARK, _BLANK, _LINE, _LEAD, _CONTROL = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(32), 127]] = _CONTROL
_KIND[[b for b in range(33, 127) if b != ord("'")]] = _MARK
_KIND[ord("0") : ord("9") + 1] = 0
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KIND[[ord(" "), ord("\n")]] = _BLANK, _LINE
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD


def _irregular(block: Block, kind: np.ndarray) -> np.ndarray:
    """Which texts hold white space other than lone blanks and line feeds, or control characters."""
    data, offsets = block.data, block.offsets - block.offsets[0]
    white = (kind == _BLANK) | (kind == _LINE)
    # Two side by side, but not the end of a text and the start of the next.
    double = white[:-1] & white[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    double[inner - 1] = False
    lead = np.flatnonzero(kind == _LEAD)
    first, second, third = (data[np.minimum(lead + k, len(data) - 1)] for k in range(3))
    wide = (
        (first == 0xC2) & (second <= 0xA0)
        | (first == 0xE1) & ((second == 0x9A) | (second == 0xA0))
        | (first == 0xE2) & (second == 0x80) & ((third <= 0x8F) | (third >= 0xA8) & (third <= 0xAF))
        | (first == 0xE2) & (second == 0x81) & (third >= 0x9F)
        | (first == 0xE3) & (second == 0x80) & (third == 0x80)
    )
    at = np.concatenate([np.flatnonzero(double), lead[wide], np.flatnonzero(kind == _CONTROL)])
    found = np.zeros(len(block.sizes), bool)
    found[np.searchsorted(offsets, at, "right") - 1] = True
    return found


def _parts_of(block: Block, kind: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Parts of regular texts, in order, and how many each text has.

    A piece begins at each blank, at each line feed and behind it, and at a mark behind a letter.
    """
    begins = (kind == _BLANK) | (kind == _LINE)
    begins[1:] |= (kind[:-1] == _LINE) | (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
    offsets = block.offsets - block.offsets[0]
    begins[offsets[:-1][block.sizes > 0]] = True
    starts = np.flatnonzero(begins)
    ends = pa.py_buffer(np.append(starts, len(block.data)).astype(np.int32))
    data = pa.py_buffer(np.ascontiguousarray(block.data))
    parts = pa.StringArray.from_buffers(len(starts), ends, data).dictionary_encode()
    return parts, np.diff(np.searchsorted(starts, offsets))


class _Parts(dict):
    """Place of each known part in `ends`; a new part is encoded when it is asked for.

    The ids of the part at place k are `ids[ends[k]:ends[k + 1]]`.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        if tokenizer.pre_tokenizer.add_prefix_space or not tokenizer.pre_tokenizer.use_regex:
            raise ValueError("texts must be cut by the usual pattern, without a blank put ahead")
        if tokenizer.truncation or tokenizer.padding:
            raise ValueError("a tokenizer that cuts or pads texts does not encode them whole")
        self.pieces, self.model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.tokenizer, self.added = tokenizer, tokenizer.get_added_tokens_decoder()
        # The empty part, and the id behind each document, which is no part of a text.
        self.ids, self.ends = array("I", [END]), array("q", [0, 0, 1])
        self[""], self[None] = 0, 1

    def _encode(self, part: str) -> list[int]:
        if part.isalpha() and part.isascii():
            return [x.id for x in self.model(part)]
        if part[0] == " " and part[1:].isalpha() and part.isascii():
            return [x.id for x in self.model("\u0120" + part[1:])]
        word = _WORD.fullmatch(part)
        if word is None:
            return [x.id for piece, _ in self.pieces(part) for x in self.model(piece)]
        if not word[2]:
            piece = part.encode().decode("latin-1").translate(_ALPHABET)
            return [x.id for x in self.model(piece)]
        ids = []
        for k in (self[word[1]], self[word[2]]):
            ids += self.ids[self.ends[k] : self.ends[k + 1]]
        return ids

    def __missing__(self, part: str) -> int:
        self.ids.extend(self._encode(part))
        self[part] = place = len(self.ends) - 1
        self.ends.append(len(self.ids))
        return place

    def trim(self) -> None:
        if len(self) > _REMEMBERED:
            lasting = list(islice(self.items(), _LASTING))
            self.clear()
            self.update(lasting)
            del self.ids[self.ends[_LASTING] :], self.ends[_LASTING + 1 :]


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    return {b: chr(_ALPHABET.get(b, b)) for b in range(256)}


@cache
def _parts(path: str) -> _Parts:
    """One memory per worker process, which serves all of its tasks."""
    return _Parts(path)


def regular(text: str) -> bool:
    """Whether all white space is lone blanks and line feeds, so that plain replacement can cut.

    Other white space and control characters count as not printable.
    """
    return text.replace("\n", "").isprintable() and not (
        "  " in text or " \n" in text or "\n " in text or "\n\n" in text
    )


class _Encoder:
    """Ids of texts by the tokenizer file.

    A byte-level tokenizer begins a new piece at every blank before a visible character and at
    every lone line feed, so a text may be cut there and its parts encoded one by one. Before that,
    it is split at the added tokens of the file, which have ids of their own.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True) -> None:
        self.parts = _parts(path)
        self.special_as_text = encode_special_tokens
        added = {
            k: t
            for k, t in self.parts.added.items()
            if t.content and not (encode_special_tokens and t.special)
        }
        self.ids = {t.content: np.array([k], np.uint32) for k, t in added.items()}
        # The longest of several that begin at the same place is meant.
        contents = sorted(self.ids, key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, contents))})") if contents else None
        # Tokens that take blanks with them or stand alone only, and two kinds, are left to the library.
        self.plain = len({t.normalized for t in added.values()}) < 2 and not any(
            t.lstrip or t.rstrip or t.single_word for t in added.values()
        )

    def __call__(self, text: str) -> np.ndarray:
        if self.added is None or not self.added.search(text):
            return self._between(text)
        if not self.plain:
            self.parts.tokenizer.encode_special_tokens = self.special_as_text
            whole = self.parts.tokenizer.encode(text, add_special_tokens=False)
            return np.array(whole.ids, np.uint32)
        # Every second section is an added token.
        sections = enumerate(self.added.split(text))
        return np.concatenate([self.ids[x] if k % 2 else self._between(x) for k, x in sections if x])

    def _between(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens."""
        if regular(text):
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        else:
            first, *rest = _CUT.split(text)
            cut = [first, *[" " + x for x in rest]]
        self.parts.trim()
        return self._ids(self._places(cut))[0]

    def _places(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts at the places `at`, one after the other, and where each part ends."""
        ids, ends = np.frombuffer(self.parts.ids, np.uint32), np.frombuffer(self.parts.ends, np.int64)
        starts = ends[at]
        sizes = ends[at + 1] - starts
        until = np.cumsum(sizes)
        total = int(until[-1]) if len(until) else 0
        return ids[np.arange(total) + np.repeat(starts - (until - sizes), sizes)], until

    def together(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, each with `END` behind it, and how many ids each text has."""
        kind = _KIND[block.data]
        apart = _irregular(block, kind)
        if self.ids:
            offsets = pa.py_buffer(block.offsets - block.offsets[0])
            data = pa.py_buffer(np.ascontiguousarray(block.data))
            texts = pa.LargeStringArray.from_buffers(len(apart), offsets, data)
            for content in self.ids:
                apart |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not apart.any():
            return self._regular_texts(block, kind)
        held, start = np.repeat(~apart, block.sizes), block.offsets[0]
        sizes = block.sizes[~apart]
        ids, counts = self._regular_texts(
            Block(block.data[held], np.append(0, np.cumsum(sizes))), kind[held]
        )
        others = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        each = []
        for k, own in enumerate(apart):
            a, b = block.offsets[k : k + 2] - start
            text = block.data[a:b].tobytes().decode() if own else None
            each.append(np.append(self(text), np.uint32(END)) if own else next(others))
        return np.concatenate(each), np.array([len(x) for x in each])

    def _regular_texts(self, block: Block, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = _parts_of(block, kind)
        self.parts.trim()
        # No part holds the character that joins them, so the distinct ones become text in one go.
        distinct = pa.ListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary)
        known = pc.binary_join(distinct, "\0")[0].as_py().split("\0") if len(parts) else []
        at = self._places(known)[parts.indices.to_numpy()]
        behind = np.cumsum(counts)
        ids, until = self._ids(np.insert(at, behind, self.parts[None]))
        return ids, np.diff(until[behind + np.arange(len(behind))], prepend=0)


def _encode(path: str, encode_special_tokens: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path, encode_special_tokens)
        written = 0
        for batch in batches:
            for at, block in blocks(batch.column(1), BLOCK_BYTES):
                ids, counts = encoder.together(block)
                until = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(
                    pa.array(np.append(0, until), pa.int32()), pa.array(ids.view(np.int32))
                )
                ahead = written + until - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(counts)),
                        pa.array(counts, pa.int64()),
                        pa.array(ahead, pa.int64()),
                        tokens,
                    ],
                    names=["doc_id", "n_tokens", "ahead", "tokens"],
                )
                written += int(until[-1])

    return tidy(run)


def write_tokens(
    documents: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    encode_special_tokens: bool = True,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode `documents` (doc_id, text) and write the ids below `folder`.

    Files hold ascending ranges of (doc_id, fingerprint of the text); `shard` is the file's place in
    that order, and `ahead` the number of ids of the documents before this one in the file. There are
    at most `spark.sql.shuffle.partitions` shards. The text is shuffled once, before it is encoded. Id 0 ends every document, also an
    empty or null text, which has no other id. Null doc_ids come first, rows with the same doc_id
    stay side by side, and rows that repeat altogether are all written. Other columns are ignored.

    `encode_special_tokens` is that of the tokenizers library: if set, a special token that a text
    spells out, like <|endoftext|>, is encoded as any other text; if not, as its own id, which is what
    a tokenizer left at its defaults does.
    """
    keyed = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "tie"
    )
    rows = ordered.select("doc_id", "text").mapInArrow(
        _encode(tokenizer, encode_special_tokens),
        "doc_id long, n_tokens long, ahead long, tokens array<int>",
    )
    with small_batches(documents.sparkSession):
        (
            rows.select(F.spark_partition_id().alias("shard"), "*")
            .write.option("parquet.block.size", row_group_bytes)
            .option("parquet.page.size", page_bytes)
            .option("parquet.enable.dictionary", "true")
            # Version 2 pages fall back from the dictionary to delta encoding.
            .option("parquet.writer.version", "PARQUET_2_0")
            .option("compression", "zstd")
            .parquet(folder)
        )


def _bases(files: DataFrame) -> DataFrame:
    """Columns: shard, base; the ids in all shards before. One row per shard, see `write_tokens`."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Columns: doc_id, shard, n_tokens, start. Reads no ids, and moves no document.

    `start` counts the ids of all documents before this one.
    """
    files = spark.read.parquet(folder)
    return files.join(F.broadcast(_bases(files)), "shard").select(
        "doc_id", "shard", "n_tokens", (F.col("base") + F.col("ahead")).alias("start")
    )


@tidy
def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A worker that has encoded the files does not need its parts any more.
    _parts.cache_clear()
    for batch in batches:
        tokens = batch.column(3)
        offsets = tokens.offsets.to_numpy()
        values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        data, ends = memoryview(values).cast("B"), (4 * offsets).tolist()
        sums = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "shard", "ahead", "n_tokens", "ids_crc32"],
        )


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Columns: doc_id, shard, ahead, n_tokens, ids_crc32; the last two from the ids in the files."""
    return spark.read.parquet(folder).select("doc_id", "shard", "ahead", "tokens").mapInArrow(
        _checksums, "doc_id long, shard int, ahead long, n_tokens long, ids_crc32 long"
    )


def token_files(
    documents: DataFrame, tokenizer: str, *, encode_special_tokens: bool = True
) -> DataFrame:
    """Write the token files of `documents` to a shared folder and describe them from what is read.

    Columns: doc_id, start, n_tokens, ids_crc32 (of all ids as little-endian unsigned 32-bit
    integers). An empty table gives an empty result. `encode_special_tokens` is as in `write_tokens`.
    One scan of the files gives the rows, which are stored before they are returned, so that ids go
    through the tasks in small batches; the starts of the shards come from the metadata alone.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark) + "/tokens"
    write_tokens(documents, folder, tokenizer, encode_special_tokens=encode_special_tokens)
    bases = F.broadcast(_bases(spark.read.parquet(folder)))
    sums = stored(read_checksums(spark, folder))
    return sums.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32"
    )
