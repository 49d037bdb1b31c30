"""Small inputs of the corpus tests."""

from __future__ import annotations

import random

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, rows):
    """Rows are (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, None, None)[:4] for r in rows]
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1])) for r in full], DOCUMENT
    )


def prose(n, seed=0, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, places, seed=0):
    """`text` with the words at some places replaced."""
    words = text.split(" ")
    for k in places:
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
