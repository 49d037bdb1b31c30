"""Removal of repeated byte strings, by difference-cover suffix buckets.

Whole suffix orders are too large to hold, but only suffixes that agree in their first `length`
bytes matter. A difference cover modulo v is a set of residues such that any two positions reach
the cover at once after fewer than v steps. So the sampled suffixes, about one byte in eight, are
put in buckets and ranked first, one bucket at a time. For two equal strings of `length` bytes the
samples in their common offset tie in rank. Two cases follow:

* The samples agree in all bytes that any string around them can hold. Then the tie settles every
  one of those strings at once: each repeats the string around the bucket's first sample.
* The samples tie in rank only, as happens around the ends of a repeated passage. Then the suffixes
  near them go into buckets of their own and are ranked by `length` bytes, those behind the middle
  of the common offset only if the samples also agree in all that such strings hold to the right,
  those ahead of it only if they agree in what those hold to the left.

Buckets are ordered by fingerprints of the bytes, not by the bytes: equality is all that counts.
Samples are told apart by 80 fingerprint bits besides those of the bucket, strings by 88.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import BLOCK_BYTES, Block, blocks, fingerprints, mix
from tidemark.session import stored

LENGTH = 100
# Bytes of packed suffixes that one bucket holds on average, and what one suffix takes.
BUCKET_BYTES, PACKED = 10 << 20, 18
# Perfect difference sets (fixed values): every difference occurs once.
COVERS = {
    13: [0, 1, 3, 9],
    31: [1, 5, 11, 24, 25, 27],
    73: [1, 2, 4, 8, 16, 32, 37, 55, 64],
}
# Suffixes and documents that are packed together, so that a bucket gets few and long rows.
PACKET = 1 << 20
# Bytes at least that a sample's rank looks at.
LEAST_CONTEXT = 24

_U = np.uint64
# Bytes kept of a sample's rank, of all around it, and of what is ahead and behind; of a string's two.
_SAMPLE_WIDTHS, _STRING_WIDTHS = (4, 6, 2, 2), (5, 6)
_PACKED = (
    "bucket long, packet long, dids binary, ties binary, docs binary, places binary, tags binary,"
    " done binary"
)
# Marks of one bucket on the documents of one packet, and all marks of one document.
_MARKS = "packet long, dids binary, ties binary, settled binary, open binary"
_FLAGS = "did long, tie long, settled binary, open binary"


class _Cover:
    """Sample places for strings of `length` bytes, and the widest common offset."""

    def __init__(self, length: int) -> None:
        fitting = [v for v in COVERS if length - v + 1 >= LEAST_CONTEXT]
        if not fitting:
            raise ValueError(f"strings of {length} bytes are too short")
        self.length, self.modulus = length, max(fitting)
        self.left = self.modulus - 1
        self.middle = self.left // 2
        self.context = length - self.left
        self._places = np.zeros(0, np.int64)

    def places(self, size: int) -> np.ndarray:
        """Sampled places of a text of `size` bytes that have a whole context behind them."""
        if len(self._places) == 0 or self._places[-1] < size:
            rounds = np.arange(0, max(2 * size, 1 << 16), self.modulus)
            self._places = (rounds[:, None] + np.array(COVERS[self.modulus])).reshape(-1)
        return self._places[: np.searchsorted(self._places, size - self.context, "right")]


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unzip(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n]


def _from_low_bytes(rows: np.ndarray) -> np.ndarray:
    """64-bit words from rows of low bytes."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(_U).reshape(-1)


class _Packet:
    """Suffixes of consecutive texts, up to PACKET of them, on their way to the buckets."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = self.documents = 0

    def add(self, dids, ties, doc, place, tags) -> None:
        self.parts.append((dids, ties, doc + self.documents, place, *tags))
        self.documents += len(dids)
        self.size += len(dids) + len(doc)

    def rows(self, widths: tuple[int, ...], buckets: int) -> Iterator[tuple]:
        """One row per bucket, see `_packed`. Of equal suffixes the first goes on, the others are
        settled here. A document that repeats counts once."""
        if not self.parts:
            return
        dids, ties, doc, place, *tags = [np.concatenate(x) for x in zip(*self.parts)]
        self.__init__()
        order = np.lexsort((ties, dids))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(dids[order]) != 0) | (np.diff(ties[order]) != 0)
        number = np.full(len(order), -1)
        number[order[new]] = np.arange(new.sum())
        dids, ties, doc = dids[order[new]], ties[order[new]], number[doc]
        order = np.argsort(doc, kind="stable")
        order = order[np.searchsorted(doc[order], 0) :]
        doc, place, tags = doc[order], place[order], [x[order] for x in tags]
        both = mix(tags[0] ^ (tags[1] * _U(0x9FB21C651E98DF25)))
        order = np.argsort(both, kind="stable")
        later = np.zeros(len(both), bool)
        later[order[1:]] = np.logical_and.reduce(
            [x[order[1:]] == x[order[:-1]] for x in tags[:2]]
        )
        keep = ~later
        yield from _packed(
            dids, ties, doc[keep], place[keep], [x[keep] for x in tags], widths, buckets,
            (doc[later], place[later]),
        )


def _packed(dids, ties, doc, place, tags, widths, buckets, done) -> Iterator[tuple]:
    """One row per bucket. `tags` are fingerprints, cut to their low `widths` bytes.

    The high bits of the first choose the bucket. Entries are ordered by document and place. `done`
    (document, place) travels with one bucket.
    """
    if not len(dids):
        return
    bucket = ((tags[0] >> _U(40)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    # Marks come back by packet and name their documents, so two packets may share a number.
    packet = mix(np.array([dids[0]], np.int64).view(_U) ^ mix(np.array([ties[0]], np.int64).view(_U)))
    home, packet = int(packet[0] % _U(buckets)), int(packet.view(np.int64)[0])
    for b in range(buckets):
        at = order[cuts[b] : cuts[b + 1]]
        extra = done if b == home else (done[0][:0], done[1][:0])
        if not len(at) and not len(extra[0]):
            continue
        used, which = np.unique(np.concatenate([doc[at], extra[0]]), return_inverse=True)
        docs, more = which[: len(at)], which[len(at) :]
        low = np.concatenate([_low_bytes(x[at], n) for x, n in zip(tags, widths)], axis=1)
        yield (
            b,
            packet,
            _zip(np.diff(dids[used], prepend=np.int64(0))),
            _zip(ties[used]),
            _zip(np.diff(docs, prepend=0).astype(np.int32)),
            _zip(np.diff(place[at], prepend=0).astype(np.int32)),
            low.tobytes(),
            _zip(np.stack([more, extra[1]]).astype(np.int64)),
        )


def _by_document(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows in document order without repeats, with their keys."""
    did = batch.column(0).to_numpy(zero_copy_only=False)
    tie = batch.column(1).to_numpy(zero_copy_only=False)
    order = np.lexsort((tie, did))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(did[order]) != 0) | (np.diff(tie[order]) != 0)
    order = order[new]
    if len(order) < len(batch) or (np.diff(order) != 1).any():
        batch = batch.take(pa.array(order))
    return batch, did[order], tie[order]


def _rows(rows: Iterable[tuple], names: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows given as tuples; `names` is the schema in Spark's notation."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    schema = pa.schema([(n, kinds[k]) for n, k in fields])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 64:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _samples(cover: _Cover, buckets: int) -> Callable:
    """Ranks of the sampled suffixes: context behind the sample, and all bytes around it."""

    def of(block: Block) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        parts = [cover.places(int(n)) for n in block.sizes]
        counts = np.array([len(x) for x in parts])
        place = np.concatenate(parts) if counts.sum() else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = place + block.offsets[:-1][doc]
        left = np.minimum(place, cover.left)
        right = np.minimum(block.sizes[doc] - place, cover.length)
        sums = block.sums(1)
        rank = fingerprints(sums, at, at + cover.context)
        around = mix(fingerprints(block.sums(0), at - left, at + right) + left.astype(_U))
        room = block.sizes[doc] - place
        ahead = fingerprints(sums, at, at + np.minimum(cover.length - cover.middle, room))
        behind = fingerprints(sums, at - np.minimum(cover.middle + 1, place), at + cover.context)
        return doc, place, [rank, around, ahead, behind]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            packet = _Packet()
            for batch in batches:
                batch, dids, ties = _by_document(batch)
                for at, block in blocks(batch.column(2), BLOCK_BYTES // 2):
                    n = len(block.sizes)
                    packet.add(dids[at : at + n], ties[at : at + n], *of(block))
                    if packet.size >= PACKET:
                        yield from packet.rows(_SAMPLE_WIDTHS, buckets)
            yield from packet.rows(_SAMPLE_WIDTHS, buckets)

        yield from _rows(rows(), _PACKED)

    return run


def _sorted_bucket(table: pa.Table, widths: tuple[int, ...]):
    """Entries of one bucket in the order of rank, second fingerprint, document and place.

    Only entries that share their rank with another one are kept. Returns the document keys with the
    packet of each, the arrays document, place and all fingerprints, and the entries settled before.
    """
    dids, ties, packets, docs, places, packed, done = [], [], [], [], [], [], []
    base = 0
    for row in table.to_pylist():
        dids.append(np.cumsum(_unzip(row["dids"], "i8")))
        ties.append(_unzip(row["ties"], "i8"))
        packets.append(np.full(len(ties[-1]), row["packet"], np.int64))
        docs.append(np.cumsum(_unzip(row["docs"], "i4").astype(np.int64)) + base)
        places.append(np.cumsum(_unzip(row["places"], "i4").astype(np.int64)))
        packed.append(np.frombuffer(row["tags"], np.uint8).reshape(-1, sum(widths)))
        more = _unzip(row["done"], "i8").reshape(2, -1)
        done.append(np.stack([more[0] + base, more[1]]))
        base += len(dids[-1])
    dids, ties, packets = np.concatenate(dids), np.concatenate(ties), np.concatenate(packets)
    doc, place = np.concatenate(docs), np.concatenate(places)
    packed, cuts = np.concatenate(packed), np.cumsum((0, *widths))
    rank = _from_low_bytes(packed[:, : cuts[1]])
    order = np.argsort(rank)
    same = np.zeros(len(rank) + 1, bool)
    same[1:-1] = rank[order[1:]] == rank[order[:-1]]
    order = order[same[1:] | same[:-1]]
    doc, place, packed = doc[order], place[order], packed[order]
    tags = [_from_low_bytes(packed[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    # A document may come in several packets; its number is its place in the order of keys.
    number, named = _numbered(dids, ties)
    doc = number[doc]
    done = np.concatenate(done, axis=1)
    order = np.lexsort((place, doc, tags[1], tags[0]))
    entries = [x[order] for x in (doc, place, *tags)]
    again = np.zeros(len(order), bool)
    again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in entries[:4]])
    entries = [x[~again] for x in entries]
    keys = (dids[named], ties[named], packets[named])
    return keys, entries, (number[done[0]], done[1])


def _numbered(dids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in the order of the different ones, and where each of these is."""
    order = np.lexsort((ties, dids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(dids[order]) != 0) | (np.diff(ties[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _marks(keys, settled, open_) -> Iterator[tuple]:
    """One row per packet: the settled and the open places in its documents."""
    dids, ties, packets = keys
    used = np.zeros(len(dids), bool)
    used[settled[0]] = used[open_[0]] = True
    order = np.flatnonzero(used)
    order = order[np.argsort(packets[order], kind="stable")]
    number = np.empty(len(dids), np.int64)
    number[order] = np.arange(len(order))
    lists = []
    for doc, place in (settled, open_):
        by = np.lexsort((place, number[doc]))
        lists.append((number[doc][by], place[by]))
    names, cuts = np.unique(packets[order], return_index=True)
    for name, a, b in zip(names.tolist(), cuts, [*cuts[1:], len(order)]):
        found = []
        for doc, place in lists:
            lo, hi = np.searchsorted(doc, [a, b])
            found.append(_zip(np.stack([np.diff(doc[lo:hi], prepend=a), place[lo:hi]]).astype(np.int64)))
        yield name, _zip(np.diff(dids[order[a:b]], prepend=np.int64(0))), _zip(ties[order[a:b]]), *found


def _merge_marks(table: pa.Table) -> pa.Table:
    """The marks of all buckets on one packet, by document."""
    dids, ties, lists, base = [], [], ([], []), 0
    for row in table.to_pylist():
        dids.append(np.cumsum(_unzip(row["dids"], "i8")))
        ties.append(_unzip(row["ties"], "i8"))
        for found, name in zip(lists, ("settled", "open")):
            doc, place = _unzip(row[name], "i8").reshape(2, -1)
            found.append(np.stack([np.cumsum(doc) + base, place]))
        base += len(ties[-1])
    dids, ties = np.concatenate(dids), np.concatenate(ties)
    number, named = _numbered(dids, ties)
    settled, open_ = [np.concatenate(x, axis=1) for x in lists]
    return _table(
        _flags(
            (dids[named], ties[named]),
            (number[settled[0]], settled[1]),
            (number[open_[0]], open_[1]),
        ),
        _FLAGS,
    )


def _flags(keys, settled, open_) -> Iterator[tuple]:
    """One row per document: its settled and its open places."""
    lists = []
    for doc, place in (settled, open_):
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        cuts = np.searchsorted(doc, np.arange(len(keys[0]) + 1))
        lists.append((place, cuts))
    (a, ca), (b, cb) = lists
    for k in np.flatnonzero((np.diff(ca) > 0) | (np.diff(cb) > 0)):
        yield (
            int(keys[0][k]), int(keys[1][k]),
            _zip(a[ca[k] : ca[k + 1]]), _zip(b[cb[k] : cb[k + 1]]),
        )


def _rank_samples(table: pa.Table) -> pa.Table:
    """Settled samples (equal in all bytes around to an earlier one) and open ones of a bucket.

    An open place is four times the sample's, plus 1 if strings behind the middle are in question,
    plus 2 if those ahead of it are.
    """
    keys, (doc, place, rank, around, ahead, behind), done = _sorted_bucket(table, _SAMPLE_WIDTHS)
    new = np.ones(len(doc), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (around[1:] != around[:-1])
    settled = (np.concatenate([doc[~new], done[0]]), np.concatenate([place[~new], done[1]]))
    doc, place, rank = doc[new], place[new], rank[new]
    halves = np.zeros(len(doc), np.int64)
    for flag, side in ((1, ahead[new]), (2, behind[new])):
        key = (rank << _U(16)) | side
        order = np.argsort(key)
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[order[1:]] == key[order[:-1]]
        halves[order] |= np.where(same[1:] | same[:-1], flag, 0)
    open_ = halves > 0
    return _table(_marks(keys, settled, (doc[open_], 4 * place[open_] + halves[open_])), _MARKS)


def _rank_strings(table: pa.Table) -> pa.Table:
    """Strings of a bucket that equal an earlier one, as settled places."""
    keys, (doc, place, rank, second), done = _sorted_bucket(table, _STRING_WIDTHS)
    new = np.ones(len(doc), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (second[1:] != second[:-1])
    settled = (np.concatenate([doc[~new], done[0]]), np.concatenate([place[~new], done[1]]))
    return _table(_marks(keys, settled, (doc[:0], place[:0])), _MARKS)


def _table(rows: Iterator[tuple], names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in map(str.split, names.split(", "))])
    return pa.Table.from_batches(list(_rows(rows, names)), schema)


def _words(packets: list[bytes] | None) -> np.ndarray:
    found = [_unzip(x, "i8") for x in packets or []]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _around(places: np.ndarray, size: int, cover: _Cover, near: int, far: int) -> np.ndarray:
    """Flags of the starts of strings that fit and hold one of `places` at offset near ... far."""
    starts = np.zeros(max(size - cover.length + 1, 0) + 1, np.int64)
    if len(starts) > 1:
        last = len(starts) - 1
        np.add.at(starts, np.clip(places - far, 0, last), 1)
        np.add.at(starts, np.clip(places - near + 1, 0, last), -1)
    return np.cumsum(starts)[:-1] > 0


def _strings(cover: _Cover, buckets: int) -> Callable:
    """Ranks of the strings around open samples, without those that are settled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            packet = _Packet()
            for batch in batches:
                batch, dids, ties = _by_document(batch)
                settled, open_ = batch.column(3), batch.column(4)
                for at, block in blocks(batch.column(2), BLOCK_BYTES // 2):
                    parts = []
                    for k, size in enumerate(block.sizes):
                        marks, done = _words(open_[at + k].as_py()), _words(settled[at + k].as_py())
                        size, middle = int(size), cover.middle
                        wanted = _around(marks[marks & 1 > 0] >> 2, size, cover, 0, middle)
                        wanted |= _around(marks[marks & 2 > 0] >> 2, size, cover, middle + 1, cover.left)
                        wanted &= ~_around(done, size, cover, 0, cover.left)
                        parts.append(np.flatnonzero(wanted))
                    counts = np.array([len(x) for x in parts])
                    place = np.concatenate(parts)
                    doc = np.repeat(np.arange(len(counts)), counts)
                    start = place + block.offsets[:-1][doc]
                    packet.add(
                        dids[at : at + len(counts)], ties[at : at + len(counts)], doc, place,
                        [
                            fingerprints(block.sums(lane), start, start + cover.length)
                            for lane in (0, 1)
                        ],
                    )
                    if packet.size >= PACKET:
                        yield from packet.rows(_STRING_WIDTHS, buckets)
            yield from packet.rows(_STRING_WIDTHS, buckets)

        yield from _rows(rows(), _PACKED)

    return run


def _remove(cover: _Cover) -> Callable:
    """Spans of the bytes that settled strings cover, and the bytes outside them."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", spans), ("kept", pa.binary())]
    )

    def one(data: np.ndarray, samples: np.ndarray, strings: np.ndarray) -> dict:
        repeats = _around(samples, len(data), cover, 0, cover.left)
        repeats[strings] = True
        starts = np.flatnonzero(repeats)
        edge = np.zeros(len(data) + 1, np.int64)
        edge[starts] += 1
        edge[starts + cover.length] -= 1
        covered = np.cumsum(edge)[:-1] > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        return {
            "n_bytes": len(data),
            "spans": [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)],
            "kept": data[~covered].tobytes(),
        }

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, samples, strings = batch.column(0), batch.column(2), batch.column(3)
            for at, block in blocks(batch.column(1), BLOCK_BYTES // 2):
                rows = []
                for k, (a, b) in enumerate(zip(block.offsets, block.offsets[1:])):
                    row = one(
                        block.data[a:b],
                        _words(samples[at + k].as_py()),
                        _words(strings[at + k].as_py()),
                    )
                    rows.append({"doc_id": ids[at + k].as_py()} | row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Columns: doc_id, n_bytes, spans (array of start, end), kept (the bytes outside the spans).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with
    a smaller doc_id, or further ahead in the same one. Strings are taken from the whole UTF-8 text
    and never cross documents. `kept` may begin or end within a character. A null text is empty.
    Null doc_ids come first; documents with the same doc_id are ordered by a fingerprint of their
    text; rows that repeat altogether count as one document, so each gets the same result. Texts
    shorter than `length` keep everything. Other columns are ignored.
    """
    cover = _Cover(length)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    keyed = rows.select(
        F.expr(f"coalesce(doc_id, {-(1 << 63) + 1}L)").alias("did"),
        F.xxhash64("text").alias("tie"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = len(COVERS[cover.modulus]) / cover.modulus
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, int(size * share * PACKED / BUCKET_BYTES))

    samples = stored(
        keyed.select("did", "tie", "text")
        .mapInArrow(_samples(cover, buckets), _PACKED)
        .groupBy("bucket")
        .applyInArrow(_rank_samples, _MARKS)
        .groupBy("packet")
        .applyInArrow(_merge_marks, _FLAGS)
    )

    def lists(flags: DataFrame, *columns: str) -> DataFrame:
        return flags.groupBy("did", "tie").agg(*[F.collect_list(c).alias(c) for c in columns])

    marked = lists(samples, "settled", "open")
    strings = stored(
        keyed.select("did", "tie", "text")
        .join(marked, ["did", "tie"])
        .mapInArrow(_strings(cover, buckets), _PACKED)
        .groupBy("bucket")
        .applyInArrow(_rank_strings, _MARKS)
        .groupBy("packet")
        .applyInArrow(_merge_marks, _FLAGS)
    )
    found = lists(samples, "settled").join(
        lists(strings, "settled").withColumnRenamed("settled", "strings"), ["did", "tie"], "full"
    )
    return (
        keyed.join(found, ["did", "tie"], "left")
        .select("doc_id", "text", "settled", "strings")
        .mapInArrow(
            _remove(cover),
            "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
        )
    )
