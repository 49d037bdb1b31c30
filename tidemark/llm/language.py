"""Language by compression: the dictionary of the text's language makes it smallest.

Each language has a raw-content dictionary for zstandard, filled with text of that language. A text
is reduced to its letters in lower case, cut into blocks short enough for the dictionary to matter
in each, and compressed once per language. The smallest total names the language; the margin to the
second smallest tells how sure that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import tidy

UNDETERMINED = "und"
DICTIONARY_BYTES = 32 << 10
# Rows per language whose passages may enter its dictionary, and characters taken from each.
SAMPLE_ROWS, PASSAGE_CHARS = 200, 1000
BLOCK_BYTES = 4096
# Texts below the first are also compressed with slices of the second size.
SHORT_BYTES, SLICE_BYTES = 200, 4096
# Margin, as a share of the second smallest size, below which `rejected` is set.
LEAST_MARGIN = 0.005

_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str | None) -> str:
    """The letters of a text in lower case; everything between two runs of letters is one blank."""
    return _OTHER.sub(" ", text or "").strip().lower()


def dictionaries(
    labelled: DataFrame,
    *,
    dictionary_bytes: int = DICTIONARY_BYTES,
    sample_rows: int = SAMPLE_ROWS,
    passage_chars: int = PASSAGE_CHARS,
) -> dict[str, bytes]:
    """A dictionary per value of `lang` in `labelled` (lang, text), of `dictionary_bytes` at most.

    At most `sample_rows` rows per language go to the driver, chosen by a fingerprint of their text,
    each with a passage of `passage_chars` at a place that the fingerprint chooses. Rows whose text
    or lang is null, or whose text is empty, teach nothing. Repeated texts count once, also where
    the share of the texts to draw is set, so copies change nothing.
    """
    place = f"1 + pmod(shiftright(mark, 8), greatest(length(text) - {passage_chars}, 0) + 1)"
    rows = (
        labelled.selectExpr("CAST(lang AS string) AS lang", "CAST(text AS string) AS text")
        .where("lang IS NOT NULL AND text <> ''")
        .selectExpr("lang", "text", "xxhash64(text) AS mark")
    )
    texts = rows.select("lang", "mark").distinct()
    counts = {r[0]: r[1] for r in texts.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # A little more than enough by chance, cut to the smallest marks afterwards.
    share = F.create_map(
        *[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * sample_rows / n))]
    )
    drawn = (F.xxhash64("mark").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < share[
        F.col("lang")
    ]
    passages = (
        rows.where(drawn)
        .selectExpr("lang", "mark", f"substring(text, CAST({place} AS int), {passage_chars}) AS passage")
        .distinct()
        .collect()
    )
    found: dict[str, dict[int, str]] = {}
    for row in passages:
        found.setdefault(row.lang, {})[row.mark] = row.passage
    out = {}
    for lang, marked in found.items():
        chosen = [_letters(marked[m]) for m in sorted(marked)[:sample_rows]]
        out[lang] = " ".join(chosen).encode()[:dictionary_bytes]
    return {k: v for k, v in sorted(out.items()) if v.strip()}


def _compressor(content: bytes):
    settings = zstandard.ZstdCompressionParameters.from_level(
        6,
        min_match=4,
        strategy=zstandard.STRATEGY_LAZY2,
        window_log=17,
        write_checksum=False,
        write_content_size=False,
        write_dict_id=False,
    )
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=settings).compress


class _Sizes:
    """Compressed sizes of a text with every dictionary.

    Whole bytes tell little about a few words, so a short text is also compressed with each slice of
    the dictionaries.
    """

    def __init__(self, contents: dict[str, bytes]) -> None:
        self.whole = {lang: _compressor(content) for lang, content in contents.items()}
        self.slices = {
            lang: [
                _compressor(content[i : i + SLICE_BYTES])
                for i in range(0, len(content), SLICE_BYTES)
            ]
            for lang, content in contents.items()
        }

    def __call__(self, text: str) -> list[tuple[float, str]]:
        data = text.encode()
        cuts = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = {lang: sum(len(f(x)) for x in cuts) for lang, f in self.whole.items()}
        if len(data) < SHORT_BYTES:
            inner = b" " + data + b" "
            for lang, parts in self.slices.items():
                sizes[lang] += sum(len(f(inner)) for f in parts) / len(parts)
        return sorted((n, lang) for lang, n in sizes.items())


def identify(
    documents: DataFrame, contents: dict[str, bytes], least_margin: float = LEAST_MARGIN
) -> DataFrame:
    """All columns of `documents` in the struct `document`, with `lang_pred`, `score`, `rejected`.

    `lang_pred` is the language with the smallest size, the first by name if several are. `score`
    is 1 minus smallest size / second smallest size. `rejected` is set where the score is below
    `least_margin`. A text that is null or has no letter is `und` with score 0 and rejected, and so
    is every text if there are no dictionaries; with a single one the score is 1. Only `text` is
    looked at, all of it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(contents)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                letters = _letters(text.as_py())
                ranked = sizes(letters) if letters else []
                if not ranked:
                    found.append((UNDETERMINED, 0.0, True))
                    continue
                score = 1 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0
                found.append((ranked[0][1], score, score < least_margin))
            columns = list(zip(*found)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("document"),
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.float64()),
                    pa.array(columns[2], pa.bool_()),
                ],
                names=["document", "lang_pred", "score", "rejected"],
            )

    rows = documents.select(
        F.struct("*").alias("document"), F.col("text").cast("string").alias("text")
    )
    kind = rows.schema["document"].dataType.simpleString()
    return rows.mapInArrow(
        tidy(run), f"document {kind}, lang_pred string, score double, rejected boolean"
    )
