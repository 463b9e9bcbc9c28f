"""Predicates (F2-F9, U1). Each returns a Column or a filtered DataFrame; Catalyst pushes what it can to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.sources.rules import DEFAULT_ETL_TAGS, DEFAULT_EVENT_TAGS
from incidentry.constants import ERROR_WORD, FAILED_LOGIN_TYPE, SEVERITY_HIGH


def tags_overlap(tags: Column, allowed: list[str]) -> Column:
    """Tags ∩ allowed ≠ ∅ (an explicit empty list passes nothing)."""
    if not allowed:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in allowed])), F.lit(False))


def etl_filter(tagged: DataFrame, allowed_tags: list[str] | None = None, tags_col: str = "tags") -> DataFrame:
    """keep logs carrying an allowed tag; None → default ``error, warning``."""
    allowed = DEFAULT_ETL_TAGS if allowed_tags is None else list(allowed_tags)
    return tagged.where(tags_overlap(F.col(tags_col), allowed))


def etl_split(tagged: DataFrame, allowed_tags: list[str] | None = None, tags_col: str = "tags"):
    """F2 routing: (passed, not_passed)."""
    allowed = DEFAULT_ETL_TAGS if allowed_tags is None else list(allowed_tags)
    hit = tags_overlap(F.col(tags_col), allowed)
    return tagged.where(hit), tagged.where(~hit)


def model_match(tagged: DataFrame, event_tags: list[str] | None = None, tags_col: str = "tags") -> DataFrame:
    """keep logs whose tags meet the model's event tags; None → default ``error, critical``."""
    wanted = DEFAULT_EVENT_TAGS if event_tags is None else list(event_tags)
    return tagged.where(tags_overlap(F.col(tags_col), wanted))


def error_message(message: Column) -> Column:
    """F4 (+F6): ``'error' in message.lower()``, null messages never match."""
    return F.coalesce(F.contains(F.lower(message), F.lit(ERROR_WORD)), F.lit(False))


def of_type(events: DataFrame, event_type: str = FAILED_LOGIN_TYPE) -> DataFrame:
    """F5."""
    return events.where(F.col("type") == event_type)


def high_severity(events: DataFrame) -> DataFrame:
    """F9."""
    return events.where(F.col("severity") == SEVERITY_HIGH)
