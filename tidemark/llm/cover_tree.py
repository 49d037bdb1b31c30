"""Cover trees over integer vectors, searched by inner product, for use inside Arrow tasks.

Vectors get one more coordinate that brings all of them to the same length. Their inner product with
a query does not change by that, but now it falls with the angle between them, so the covering
radius of a node bounds the inner products of all vectors below it from both sides.
"""

from __future__ import annotations

import heapq
import io
from typing import NamedTuple

import numpy as np

LEAF = 128
# A child's vectors lie within this part of its parent's covering radius, and its centre is farther
# than that from the centres of its siblings.
SHRINK = 0.7


class Tree(NamedTuple):
    """Vectors in tree order, and nodes from the root down.

    The rows with vector k have the ids `ids[id_ends[k]:id_ends[k + 1]]` in ascending order. Node i has
    the vector `centre[i]`, the nodes `children[i, 0]:children[i, 1]` and, all in all, the vectors
    `members[i, 0]:members[i, 1]`, none farther than `radius[i]` from the centre once all are
    brought to `length`. Their labels lie between `least[i]` and `most[i]`.
    """

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    id_ends: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    members: np.ndarray
    least: np.ndarray
    most: np.ndarray
    length: np.ndarray

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self._asdict())
        return out.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> Tree:
        with np.load(io.BytesIO(packed), allow_pickle=False) as arrays:
            return cls(**{name: arrays[name] for name in cls._fields})


def _squared(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def build(vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]]) -> Tree:
    """A tree over the rows of `vectors` (n x d integers); row k has a label and ids."""
    n = len(vectors)
    plain = vectors.astype(np.float64)
    squares = _squared(plain)
    length = float(np.sqrt(squares.max(initial=1.0)))
    lifted = np.column_stack([plain, np.sqrt(np.maximum(length**2 - squares, 0))])

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(_squared(lifted[rows] - lifted[centre]))

    order = np.empty(n, np.int64)
    centre, radius, children, members = [0], [0.0], [[0, 0]], [[0, n]]
    first = distances(np.arange(n), 0)
    radius[0] = first.max(initial=0)
    # (node, its vectors, their distances from its centre); nodes are numbered level by level.
    waiting = [(0, np.arange(n), first)]
    for node, rows, away in waiting:
        begin = members[node][0]
        if len(rows) <= LEAF or radius[node] == 0:
            order[begin : begin + len(rows)] = rows
            continue
        reach = radius[node] * SHRINK
        parts, pivot, left, near = [], centre[node], rows, away
        while len(left):
            inside = near <= reach
            inside |= left == pivot
            parts.append((pivot, left[inside], near[inside]))
            # The vector farthest from the last centre begins the next part.
            left, near = left[~inside], near[~inside]
            if len(left):
                pivot = left[near.argmax()]
                near = distances(left, pivot)
        children[node] = [len(centre), len(centre) + len(parts)]
        for pivot, part, near in parts:
            waiting.append((len(centre), part, near))
            centre.append(pivot)
            radius.append(near.max())
            children.append([0, 0])
            members.append([begin, begin + len(part)])
            begin += len(part)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sorted_ids, labels = [ids[k] for k in order.tolist()], labels[order]
    extremes = [(labels[a:b].min(), labels[a:b].max()) if a < b else (0, -1) for a, b in members]
    return Tree(
        _small(vectors[order]),
        labels,
        np.array([i for row in sorted_ids for i in row], np.int64),
        np.cumsum([0, *map(len, sorted_ids)]),
        place[centre],
        np.array(radius),
        np.array(children),
        np.array(members),
        *np.array(extremes).T,
        np.array(length),
    )


def _small(vectors: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    top = np.abs(vectors).max(initial=0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return vectors.astype(kind)


class Windows(NamedTuple):
    """What is looked for: of query `query[i]`, scores from `low[i]` to `high[i]`."""

    query: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Forest:
    """Several trees with the scores of one batch of queries; finds the best rows of each window."""

    def __init__(self, trees: list[Tree], queries: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        self.query_labels, self.query_ids = labels, ids
        width = max([queries.shape[1], *[t.vectors.shape[1] for t in trees]])
        self.norms = np.sqrt(_squared(queries.astype(np.float64)))
        largest = self.norms.max(initial=0) * max([float(t.length) for t in trees], default=0)
        if largest >= 2**62:
            raise OverflowError("inner products do not fit a long")
        # Sums of products below 2**53 are exact in floating point, and much faster.
        self.kind = np.float64 if largest < 2**52 else np.int64
        self.queries = self._wide(queries, width)
        self.vectors = np.concatenate([self._wide(t.vectors, width) for t in trees])
        rows = np.cumsum([0, *[len(t.labels) for t in trees]])
        nodes = np.cumsum([0, *[len(t.centre) for t in trees]])
        ends = np.cumsum([0, *[len(t.ids) for t in trees]])
        self.labels = np.concatenate([t.labels for t in trees])
        self.ids = np.concatenate([t.ids for t in trees])
        self.id_starts = np.concatenate([t.id_ends[:-1] + e for t, e in zip(trees, ends)])
        self.id_ends = np.concatenate([t.id_ends[1:] + e for t, e in zip(trees, ends)])
        self.centre = np.concatenate([t.centre + r for t, r in zip(trees, rows)])
        self.children = np.concatenate([t.children + k for t, k in zip(trees, nodes)])
        self.members = np.concatenate([t.members + r for t, r in zip(trees, rows)])
        self.length = np.concatenate([np.full(len(t.centre), float(t.length)) for t in trees])
        chord = np.concatenate([t.radius for t in trees]) / (2 * self.length)
        self.angle = 2 * np.arcsin(np.minimum(chord, 1.0))
        self.roots = nodes[:-1]
        self.least = np.concatenate([t.least for t in trees])
        self.most = np.concatenate([t.most for t in trees])
        self.seen = 0

    def _wide(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), self.kind)
        out[:, : rows.shape[1]] = rows
        return out

    def _scores(self, rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of vectors with the queries of some windows, and each window's column."""
        queries, column = np.unique(self.windows.query[slots], return_inverse=True)
        return self.vectors[rows] @ self.queries[queries].T, column

    def search(self, windows: Windows, k: int, same_label: bool) -> list[list[tuple[int, int]]]:
        """Of each window the first `k` rows as (score, id): highest scores, then smallest ids.

        Rows have the query's label, its own id excepted, or any other label. One descent serves all
        windows: the node whose bound promises most to a window comes first, and a node goes down only
        with the windows that its bounds meet and that may still gain by it.
        """
        self.windows, self.k, self.same = windows, k, same_label
        self.best: list[list[tuple[int, int]]] = [[] for _ in windows.query]
        # The score that a row must reach to enter a window.
        self.needed = windows.low.astype(np.float64)
        self.heap: list[tuple] = []
        self.pushed = 0
        self._descend(self.roots, np.arange(len(windows.query)))
        while self.heap:
            _, _, node, slots, upper = heapq.heappop(self.heap)
            slots = slots[upper >= self.needed[slots]]
            if not len(slots):
                continue
            if self.children[node, 0] < self.children[node, 1]:
                self._descend(np.arange(*self.children[node]), slots)
            else:
                rows = np.arange(*self.members[node])
                scores, column = self._scores(rows, slots)
                self._verify(rows, scores[:, column], slots)
        return [[(-s, i) for s, i in rows] for rows in self.best]

    def _descend(self, nodes: np.ndarray, slots: np.ndarray) -> None:
        """Bounds of nodes for some windows; what may matter waits in the heap."""
        scores, column = self._scores(self.centre[nodes], slots)
        lone = self.members[nodes, 1] - self.members[nodes, 0] == 1
        if lone.any():
            self._verify(self.centre[nodes[lone]], scores[lone][:, column], slots)
            nodes, scores = nodes[~lone], scores[~lone]
        if not len(nodes):
            return
        queries = np.unique(self.windows.query[slots])
        reach = np.maximum(self.length[nodes][:, None] * self.norms[queries], 1e-9)
        theta = np.arccos(np.clip(scores / reach, -1.0, 1.0))
        angle = self.angle[nodes][:, None]
        # Scores are integers; the slack is far above what rounding can do.
        slack = 1e-7 * reach + 1e-3
        upper = (reach * np.cos(np.maximum(theta - angle, 0)) + slack)[:, column]
        lower = (reach * np.cos(np.minimum(theta + angle, np.pi)) - slack)[:, column]
        label = self.query_labels[self.windows.query[slots]]
        least, most = self.least[nodes][:, None], self.most[nodes][:, None]
        wanted = (least <= label) & (label <= most) if self.same else (least != label) | (most != label)
        high = self.windows.high[slots]
        wanted &= (lower <= high) & (upper >= self.needed[slots])
        promise = np.where(wanted, np.minimum(upper, high) / reach[:, column], -np.inf).max(axis=1)
        for at in np.flatnonzero(wanted.any(axis=1)).tolist():
            use = wanted[at]
            self.pushed += 1
            entry = (-promise[at], self.pushed, int(nodes[at]), slots[use], upper[at, use])
            heapq.heappush(self.heap, entry)

    def _verify(self, rows: np.ndarray, scores: np.ndarray, slots: np.ndarray) -> None:
        """Exact scores of rows enter the windows they fall into."""
        self.seen += scores.size
        label = self.query_labels[self.windows.query[slots]]
        fits = (self.labels[rows][:, None] == label) == self.same
        fits &= (scores >= self.needed[slots]) & (scores <= self.windows.high[slots])
        for at in np.flatnonzero(fits.any(axis=0)).tolist():
            slot = slots[at]
            own = self.query_ids[self.windows.query[slot]] if self.same else None
            chosen = np.flatnonzero(fits[:, at])
            best = self.best[slot]
            for row, score in zip(rows[chosen].tolist(), scores[chosen, at].tolist()):
                ids = self.ids[self.id_starts[row] : self.id_ends[row]].tolist()
                best += [(-int(score), i) for i in ids if i != own]
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                self.needed[slot] = max(self.needed[slot], -best[-1][0])
