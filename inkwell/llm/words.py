"""The word pattern that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` has the same white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
