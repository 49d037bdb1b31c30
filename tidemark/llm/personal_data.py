"""Personal data in texts, by weak supervision over the votes of several labelers.

Strict patterns give the base spans, which always stay. Wider patterns give further candidates.
Regular-expression, gazetteer and context labelers vote on every candidate: yes, no, or no opinion.
How far each can be trusted is not given but estimated by expectation-maximisation from the votes
on all documents. Only the number of candidates per kind and vote pattern is needed for that, which
is a table of bounded size. The posterior of each pattern then trains the span classifier, a
logistic regression on kind, votes and shape, which decides what is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

KINDS = ["email", "ip", "card", "phone"]
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Wider patterns, per kind: spelled-out addresses, addresses of version 6, numbers in groups.
WIDE = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64} ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[A-Za-z0-9-]{1,63}){1,8}",
        re.IGNORECASE,
    ),
    "ip": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[. /][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ -]|\([0-9]{3}\) ?)"
        r"[0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}(?![0-9])"
    ),
}
_MAY_HOLD = re.compile(r"[0-9(\[{]")

# Gazetteers: endings of mail domains, private networks, leading digits of card issuers and
# country calling codes.
_ENDINGS = frozenset("com org net edu gov io info de fr es uk eu us ch at it nl example".split())
_ISSUERS = ("4", "5", "2", "34", "37", "6")
_CALLING = ("1", "7", "20", "27", "3", "4", "5", "6", "8", "9")
_CUES = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel|schreib", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|servidor|serveur", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|karte|tarjeta|carte|credit|kredit", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|fax|mobil|handy|ruf|llam|appel", re.IGNORECASE),
}
CUE_CHARS = 40
LABELERS = ["pattern", "checks", "gazetteer", "cue", "counter_cue"]
_COUNTER = re.compile(r"version|build|isbn|serial|page|seite|order|invoice|chapter", re.IGNORECASE)
ROUNDS = 50
ACCEPT = 0.9


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[re.Match]:
    """Matches of EMAIL. A match needs an `@`, so only the surroundings of each are looked at."""
    start, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > start and text[left - 1] in _LOCAL:
            left -= 1
        found = EMAIL.match(text, left) if left < at else None
        if found:
            yield found
            start = found.end()
        else:
            start = at + 1
        at = text.find("@", start)


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [x.lstrip("0") for x in found.split(".")]
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in parts)
    digits = _digits(found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Strict matches by kind and start, each with whether it passes the checks of its kind."""
    found = [("email", *m.span(), True) for m in _emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            found.append((kind, *m.span(), _passes(kind, m.group())))
    return found


def _gazetteer(kind: str, found: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^a-z]+", found.lower().rstrip(")]} "))[-1] in _ENDINGS else -1
    digits = _digits(found).lstrip("0")
    if kind == "card":
        return 1 if digits.startswith(_ISSUERS) else -1
    if kind == "phone":
        return 1 if digits.startswith(_CALLING) else -1
    return 0


def votes(kind: str, text: str, start: int, end: int, strict: bool, passes: bool) -> tuple[int, ...]:
    """What each of LABELERS says of a span: 1, -1, or 0 for no opinion."""
    found, ahead = text[start:end], text[max(0, start - CUE_CHARS) : start]
    if not strict and kind == "card":
        passes = _luhn(_digits(found))
    if not strict and kind == "phone":
        passes = 8 <= len(_digits(found)) <= 15
    # The wide forms of an address leave nothing to check.
    checks = 0 if not strict and kind in ("email", "ip") else 1 if passes else -1
    return (
        1 if strict else 0,
        checks,
        _gazetteer(kind, found),
        1 if _CUES[kind].search(ahead) else 0,
        -1 if _COUNTER.search(ahead) else 0,
    )


def _candidates(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and the other candidates with their votes. No candidate overlaps a base span."""
    strict = base_spans(text)
    base = [x[:3] for x in strict if x[3]]
    taken = sorted((a, b) for _, a, b in base)
    voted = [(k, a, b, votes(k, text, a, b, True, True)) for k, a, b in base]
    more = [(k, a, b, votes(k, text, a, b, True, False)) for k, a, b, ok in strict if not ok]
    if _MAY_HOLD.search(text):
        for kind, pattern in WIDE.items():
            for m in pattern.finditer(text):
                more.append((kind, *m.span(), votes(kind, text, *m.span(), False, True)))
    ends = np.array([b for _, b in taken])
    free = []
    for kind, a, b, v in more:
        at = int(np.searchsorted(ends, a, "right"))
        if at == len(taken) or taken[at][0] >= b:
            free.append((kind, a, b, v))
    return base, [(*x, True) for x in voted] + [(*x, False) for x in free]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_VOTED = pa.struct(
    [
        ("kind", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("votes", pa.list_(pa.int32())),
        ("base", pa.bool_()),
    ]
)


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, voted = [], []
        for text in batch.column(1):
            spans, candidates = _candidates(text.as_py() or "")
            base.append([dict(zip(("kind", "start", "end"), x)) for x in spans])
            voted.append(
                [dict(zip(("kind", "start", "end", "votes", "base"), x)) for x in candidates]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(voted, pa.list_(_VOTED))],
            names=["doc_id", "base", "candidates"],
        )


@dataclass(frozen=True)
class Model:
    """Reliability of each labeler, and the accepted patterns as (kind, votes)."""

    accuracy: dict[str, float]
    accepted: frozenset[tuple[str, tuple[int, ...]]]


def fit(counts: list[tuple[str, tuple[int, ...], int]]) -> Model:
    """Labeler accuracies by expectation-maximisation over counted vote patterns, and the classifier.

    Each labeler is right with its own probability whenever it votes; kinds have their own share of
    true candidates. The search starts from an accuracy of 0.8, which says that labelers are better
    than chance, and ends after ROUNDS. Without candidates nothing is accepted.
    """
    if not counts:
        return Model(dict.fromkeys(LABELERS, 0.8), frozenset())
    kinds = np.array([KINDS.index(c[0]) for c in counts])
    vote = np.array([c[1] for c in counts], float)
    n = np.array([c[2] for c in counts], float)
    right, share = np.full(len(LABELERS), 0.8), np.full(len(KINDS), 0.5)
    for _ in range(ROUNDS):
        odds = vote @ np.log(right / (1 - right)) + np.log(share / (1 - share))[kinds]
        truth = 1 / (1 + np.exp(-odds))
        agree = np.where(vote > 0, truth[:, None], np.where(vote < 0, 1 - truth[:, None], 0))
        # Two pseudo-counts on the starting value keep labelers that rarely vote near it.
        right = np.clip(
            (n @ agree + 8) / (n @ (vote != 0) + 10), 0.55, 0.99
        )
        held = np.bincount(kinds, n, len(KINDS))
        share = np.clip((np.bincount(kinds, n * truth, len(KINDS)) + 1) / (held + 2), 0.02, 0.98)
    features = np.concatenate([vote, vote[:, :1] * vote[:, 1:2], np.eye(len(KINDS))[kinds]], axis=1)
    weights = np.zeros(features.shape[1])
    share_of = n / n.sum()
    for _ in range(2000):
        guess = 1 / (1 + np.exp(-features @ weights))
        weights -= 2.0 * (features.T @ (share_of * (guess - truth)) + 1e-4 * weights)
    guess = 1 / (1 + np.exp(-features @ weights))
    # A failed check keeps a span out, however common its pattern is.
    accepted = {
        (counts[k][0], counts[k][1])
        for k in np.flatnonzero((guess >= ACCEPT) & (vote[:, 1] >= 0))
    }
    return Model(dict(zip(LABELERS, right.tolist())), frozenset(accepted))


def _decide(accepted: frozenset):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, candidates in zip(batch.column(1), batch.column(2)):
                kept = base.as_py()
                added = [
                    {k: c[k] for k in ("kind", "start", "end")}
                    for c in candidates.as_py()
                    if not c["base"] and (c["kind"], tuple(c["votes"])) in accepted
                ]
                spans.append(
                    sorted(kept + added, key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"]))
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN))],
                names=["doc_id", "base", "spans"],
            )

    return run


def personal_data(documents: DataFrame) -> DataFrame:
    """Columns: doc_id, base, spans; the last two are arrays of struct<kind, start, end>.

    Places are code points, ends exclusive, ordered by kind as in KINDS and then by start. `spans`
    holds all of `base` and what the classifier adds; an added span never overlaps a base span. A
    null or empty text has no span. doc_id may be null or repeat; every row gives a row. Other
    columns are ignored. The whole text is searched once; the votes are kept in the shared folder.
    """
    span = "struct<kind:string,start:long,end:long>"
    voted = "struct<kind:string,start:long,end:long,votes:array<int>,base:boolean>"
    found = stored(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
        ).mapInArrow(_find, f"doc_id long, base array<{span}>, candidates array<{voted}>")
    )
    patterns = (
        found.select(F.explode("candidates").alias("c"))
        .groupBy("c.kind", "c.votes")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", "votes")
        .collect()
    )
    model = fit([(r.kind, tuple(r.votes), r.n) for r in patterns])
    return found.mapInArrow(
        _decide(model.accepted), f"doc_id long, base array<{span}>, spans array<{span}>"
    )
