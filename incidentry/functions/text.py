"""String helpers with the reference's Python semantics expressed as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode whitespace character, Spark's trim() only blanks.
_EDGE_WS = r"(?U)^\s+|\s+$"


def strip_ws(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, _EDGE_WS, "")


def lower_strip(c: Column | str) -> Column:
    return F.lower(strip_ws(c))


def contains_ci(text: Column, keyword: str | Column) -> Column:
    """Case-insensitive substring test: ``keyword.lower() in text.lower()`` (F1).

    ``text`` should already be lower-cased by the caller when it is tested against many keywords, so that the
    lower-casing is done once per row; the keyword side is lowered by Spark too (constant-folded for literals).
    """
    kw = F.lit(keyword) if isinstance(keyword, str) else keyword
    return F.contains(text, F.lower(kw))
