"""Toxicity of texts by a linear classifier that swaps of identity terms may hardly move.

A text is the density of its words and of their beginnings. Those that tell toxic from other labelled
texts are features of a logistic regression. Where a labelled text names a group, a counterfactual
text names another one instead; the squared change of the raw score between the two is added to the
loss. So terms that only occur near toxic words don't become toxic themselves, and neutral mentions
stay neutral.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import Block, blocks, fingerprints, multiset

# Terms of one line may replace each other.
IDENTITY_TERMS = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["women", "men"],
    ["woman", "man"],
    ["girl", "boy"],
    ["gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"],
    ["black", "white", "asian", "latino", "african", "european", "american", "arab"],
    ["immigrant", "refugee", "native", "foreigner"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["blind", "deaf", "disabled"],
    ["old", "young"],
]
SAMPLE_ROWS = 4_000
FEATURES = 2_000
# Occurrences in labelled texts and standard deviations that make a feature.
LEAST_ROWS, LEAST_Z = 3, 5.0
RIDGE, SWAP_PENALTY = 3e-5, 1.0
STEPS = 800
THRESHOLD = 0.7
# Beginnings of so many bytes are features too, and the density of one is taken over so many words
# at least.
BEGINNINGS, LEAST_WORDS = (5, 6, 8), 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _counted(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text: text, fingerprint and number, by text; and the words of each text.

    Words are runs of letters, ASCII letters in lower case.
    """
    lower = Block(_LOWER[block.data], block.offsets)
    starts, ends, counts = lower.words(_LETTER)
    sums = lower.sums()
    owner = np.repeat(np.arange(len(counts)), counts)
    codes, owners = [fingerprints(sums, starts, ends)], [owner]
    for n in BEGINNINGS:
        long = ends - starts > n
        codes.append(fingerprints(sums, starts[long], starts[long] + n) ^ _U(n))
        owners.append(owner[long])
    codes, owner, number = multiset(np.concatenate(codes), np.concatenate(owners))
    return owner, codes, number, counts


def _densities(number: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(100 * number / np.maximum(words, LEAST_WORDS))


def _codes(word: str) -> np.ndarray:
    """Fingerprints of a word and of its beginnings."""
    return _counted(next(blocks(pa.array([word])))[1])[1]


@dataclass(frozen=True)
class Model:
    """Words as sorted fingerprints, their weights, and the score of a text without any of them."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, block: Block) -> np.ndarray:
        out = np.full(len(block.sizes), self.bias)
        if not len(self.words):
            return out
        owner, codes, number, counts = _counted(block)
        at = np.searchsorted(self.words, codes)
        at[at == len(self.words)] = 0
        hit = self.words[at] == codes
        at, owner = at[hit], owner[hit]
        np.add.at(out, owner, self.weights[at] * _densities(number[hit], counts[owner]))
        return out


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, block in blocks(batch.column(1)):
            owner, codes, number, counts = _counted(block)
            offsets = np.searchsorted(owner, np.arange(len(counts) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(counts)),
                    pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(codes.view(np.int64))
                    ),
                    pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()),
                        pa.array(_densities(number, counts[owner]).astype(np.float32)),
                    ),
                ],
                names=["label", "codes", "densities"],
            )


def draw(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `sample_rows` rows of `labels` (label and keys), drawn by a fingerprint of the row.

    So few rows can be broadcast to the texts they belong to. Labels other than 0 and 1 are left out.
    """
    rows = labels.where("label IN (0, 1)")
    n = rows.count()
    if n > sample_rows:
        cut = int(1.05 * sample_rows / n * (1 << 30))
        mark = F.xxhash64(*labels.columns, F.lit(2))
        rows = rows.where(mark.bitwiseAND(F.lit((1 << 30) - 1)) < cut)
    return rows.limit(sample_rows)


def fit(
    labelled: DataFrame,
    *,
    sample_rows: int = SAMPLE_ROWS,
    swap_penalty: float = SWAP_PENALTY,
    identity_terms: list[list[str]] = IDENTITY_TERMS,
) -> Model:
    """The classifier learnt from `labelled` (label 0 or 1, text), at most `sample_rows` of them.

    Where there are more, they are drawn by a fingerprint of all columns, so a column that tells
    copies apart keeps them from being drawn together. Rows with a null label or text teach nothing.
    With labels of one kind only, the score is constant.
    """
    rows = labelled.select(
        F.col("label").cast("int").alias("label"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(*labelled.columns, F.lit(1)).alias("mark"),
    ).where("label IN (0, 1) AND text IS NOT NULL")
    n = rows.count()
    drawn = rows
    if n > sample_rows:
        cut = int(1.05 * sample_rows / n * (1 << 30))
        drawn = drawn.where(F.col("mark").bitwiseAND(F.lit((1 << 30) - 1)) < cut)
    bags = drawn.select("label", "text").mapInArrow(
        _bags, "label int, codes array<long>, densities array<float>"
    )
    sample = bags.limit(sample_rows).toArrow().combine_chunks()
    if not len(sample):
        return Model(np.zeros(0, _U), np.zeros(0), -np.inf)
    label = sample.column("label").to_numpy().astype(float)
    lists = sample.column("codes").combine_chunks()
    owner = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    density = sample.column("densities").combine_chunks().flatten().to_numpy()
    return _train(
        lists.flatten().to_numpy().view(_U), owner, density, label, swap_penalty, identity_terms
    )


def _chosen(codes, owner, label) -> np.ndarray:
    """Features whose presence differs most between toxic and other texts."""
    found, which = np.unique(codes, return_inverse=True)
    share = label.mean()
    seen = np.bincount(which)
    toxic = np.bincount(which, label[owner])
    spread = seen * share * (1 - share) * (1 - seen / (len(label) + 1))
    z = np.abs(toxic - seen * share) / np.sqrt(spread + 1e-9)
    strength = np.where((seen >= LEAST_ROWS) & (z >= LEAST_Z), z, 0.0)
    best = np.argsort(-strength, kind="stable")[:FEATURES]
    return found[np.sort(best[strength[best] > 0])]


def _swaps(lines, chosen, cols, density) -> tuple[np.ndarray, np.ndarray]:
    """Change of the features by each swap of a term, and how much the texts' mentions weigh.

    Each mention of a term in a text is swapped for every other term of its line in turn.
    """
    mentions = np.bincount(cols, density.astype(float) ** 2, len(chosen))
    changes, weights = [], []
    for line in lines:
        parts = [np.searchsorted(chosen, _codes(t)) for t in line]
        words = [np.searchsorted(chosen, _word(t)) for t in line]
        for a, place in enumerate(words):
            for b in range(len(line)):
                if a != b and mentions[place]:
                    change = np.zeros(len(chosen))
                    change[parts[b]] += 1
                    change[parts[a]] -= 1
                    changes.append(change)
                    weights.append(mentions[place] / (len(line) - 1))
    return np.array(changes).reshape(-1, len(chosen)), np.array(weights)


def _word(term: str) -> np.uint64:
    """Fingerprint of the word itself."""
    _, block = next(blocks(pa.array([term])))
    return fingerprints(block.sums(), np.array([0]), np.array([len(block.data)]))[0]


def _train(codes, owner, density, label, swap_penalty, identity_terms) -> Model:
    n, share = len(label), label.mean()
    if share in (0.0, 1.0):
        return Model(np.zeros(0, _U), np.zeros(0), -20.0 if share == 0 else 20.0)
    terms = [t for line in identity_terms for t in line]
    chosen = np.unique(np.concatenate([_chosen(codes, owner, label), *[_codes(t) for t in terms]]))
    at = np.searchsorted(chosen, codes)
    at[at == len(chosen)] = 0
    hit = chosen[at] == codes
    rows, cols, value = owner[hit], at[hit], density[hit]
    changes, times = _swaps(identity_terms, chosen, cols, value)

    weights, bias = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        logit = bias + np.bincount(rows, weights[cols] * value, n)
        error = (1 / (1 + np.exp(-logit)) - label) / n
        slope = np.bincount(cols, error[rows] * value, len(chosen)) + RIDGE * weights
        slope += 2 * swap_penalty / n * ((times * (changes @ weights)) @ changes)
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(chosen, weights, bias)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `documents` in the struct `document`, with `score` and `predicted`.

    `score` is the probability of label 1 from the whole text. A null or empty text has the score of
    a text without any known word. `predicted` is 1 from `threshold` on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column("text")):
                with np.errstate(over="ignore"):
                    found = 1 / (1 + np.exp(-model.logits(block)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("document").slice(at, len(found)),
                        pa.array(found),
                        pa.array((found >= threshold).astype(np.int32)),
                    ],
                    names=["document", "score", "predicted"],
                )

    rows = documents.select(
        F.struct("*").alias("document"), F.col("text").cast("string").alias("text")
    )
    kind = rows.schema["document"].dataType.simpleString()
    return rows.mapInArrow(run, f"document {kind}, score double, predicted int")
