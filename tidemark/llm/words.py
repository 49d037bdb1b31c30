"""Words of texts as column expressions. A word is a match of `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"


def words(text: str) -> Column:
    """All words of column `text`, in order; none if it is null."""
    bare = F.btrim(F.col(text).cast("string"), F.lit(WHITE))
    return F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )
