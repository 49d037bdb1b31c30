"""Vectorised work on the UTF-8 bytes of many texts at once, for use inside Arrow tasks.

A polynomial prefix sum over the bytes gives the fingerprint of any substring in constant time. The
coefficients of the bytes are drawn once from a fixed seed, so fingerprints agree on all machines.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
# Sums modulo 2**64 tell short strings apart, but not all crafted ones of a thousand bytes, so longer
# strings are fingerprinted in pieces of this size.
PIECE_BYTES = 192

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words (the finaliser of the public SplitMix64 generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, extended on demand."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 1)
            self.up = self._series(_BASE, n)
            self.down = self._series(pow(_BASE, -1, 1 << 64), n)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, _U)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()
_COEFFICIENTS = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, size=(2, 256), dtype=_U
) * _U(2) + _U(1)


Batches = Iterable[pa.RecordBatch]


def tidy(run: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """An Arrow task that gives its memory back when it ends.

    Workers live on through the stages after theirs, which need the memory of the executor.
    """

    @wraps(run)
    def tidied(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            # The C library keeps what was freed; only glibc can be asked to return it.
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


class Block:
    """The bytes of consecutive texts; `offsets[i]:offsets[i + 1]` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.sizes = np.diff(offsets)

    def sums(self, lane: int = 0) -> np.ndarray:
        """Prefix sums from which `fingerprints` are taken; the two lanes are independent."""
        _POWERS.reach(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, _U)
        np.multiply(_COEFFICIENTS[lane][self.data], _POWERS.up[: len(self.data)], out=out[1:])
        np.cumsum(out, out=out)
        return out

    def words(self, members: np.ndarray = ~_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every maximal run of bytes in `members`, and the number per text.

        By default members are all but 0x20 and 0x09 to 0x0D: matches of `[^\\x20\\x09-\\x0D]+`.
        """
        full = members[self.data]
        before, after = np.zeros_like(full), np.zeros_like(full)
        before[1:], after[:-1] = full[:-1], full[1:]
        filled = self.sizes > 0
        before[self.offsets[:-1][filled]] = False
        after[self.offsets[1:][filled] - 1] = False
        starts = np.flatnonzero(full & ~before)
        ends = np.flatnonzero(full & ~after) + 1
        return starts, ends, np.diff(np.searchsorted(starts, self.offsets))


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the substrings `starts:ends`, equal for equal bytes wherever they are."""
    sizes = ends - starts
    value = _piece(sums, starts, np.minimum(ends, starts + PIECE_BYTES), sizes)
    long = np.flatnonzero(sizes > PIECE_BYTES)
    if len(long):
        pieces = -(-sizes[long] // PIECE_BYTES) - 1
        which = np.repeat(np.arange(len(long)), pieces)
        number = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
        at = starts[long][which] + number * PIECE_BYTES
        until = np.minimum(ends[long][which], at + PIECE_BYTES)
        part = mix(_piece(sums, at, until, until - at) ^ mix(number.astype(_U)))
        value[long] = mix(value[long] + np.add.reduceat(part, np.cumsum(pieces) - pieces))
    return value


def _piece(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of short strings; `sizes` are those of the strings they begin."""
    return mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + sizes.astype(_U) * _U(_BASE))


def blocks(
    texts: pa.Array, limit: int = BLOCK_BYTES, most: int | None = None
) -> Iterator[tuple[int, Block]]:
    """Consecutive texts of about `limit` bytes together, with the index of the first.

    Null counts as empty. A text above the limit makes a block of its own. No block has more than
    `most` texts, if given, which bounds what is kept per text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else []
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, at + most) if most else end
        part = offsets[at : end + 1]
        yield at, Block(raw[part[0] : part[-1]], part - part[0])
        at = end


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every run of `width` words, and the index of its text, in text order.

    A text of fewer words, but at least one, has a single shingle of all its words.
    """
    starts, ends, counts = block.words()
    word = fingerprints(block.sums(), starts, ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    short = (counts > 0) & (counts < width)
    # A short text counts as one run that ends early: words past its end leave the value as it is.
    first = np.flatnonzero(
        np.concatenate([owner[: -width + 1] == owner[width - 1 :], np.zeros(width - 1, bool)])
        if len(owner) >= width
        else np.zeros(len(owner), bool)
    )
    lone = (np.cumsum(counts) - counts)[short]
    first = np.sort(np.concatenate([first, lone]))
    last = np.cumsum(counts)[owner[first]] if len(first) else first
    value = np.zeros(len(first), _U)
    for k in range(width):
        inside = first + k < last
        step = mix(value[inside] * _U(_BASE) + word[first[inside] + k])
        value[inside] = step
    return value, owner[first]


def multiset(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each owner with their number, ordered by owner and value."""
    if not len(value):
        return value, owner, np.zeros(0, np.int64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return value[at], owner[at], np.diff(np.append(at, len(value)))
