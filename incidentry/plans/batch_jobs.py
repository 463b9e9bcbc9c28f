"""End-to-end batch jobs built from the operators (X0, X0b, X0c). All lazy: one Catalyst plan per job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from incidentry.operators.events import create_events
from incidentry.operators.filters import etl_filter, model_match
from incidentry.operators.incidents import DEFAULT_THRESHOLD, instant_and_accumulated
from incidentry.operators.normalize import normalize_logs
from incidentry.operators.tagging import tag_logs


def logs_to_incidents(raw_logs: DataFrame, rules=None, key: str = "log_id", threshold: int = DEFAULT_THRESHOLD,
                      carry: tuple = ()) -> DataFrame:
    """Normalise → tag → one event per log (no filter) → instant / accumulated incidents."""
    tagged = tag_logs(normalize_logs(raw_logs), rules)
    events = create_events(tagged, carry=carry)
    return instant_and_accumulated(events, key=key, threshold=threshold)


def filtered_events(raw_logs: DataFrame, rules=None, etl_tags=None, event_tags=None, carry: tuple = ()) -> DataFrame:
    """X0b up to the events: normalise + tag → ETL filter (F2) → model match (F3) → events (P5)."""
    tagged = tag_logs(normalize_logs(raw_logs), rules)
    return create_events(model_match(etl_filter(tagged, etl_tags), event_tags), carry=carry)


def filtered_incidents(raw_logs: DataFrame, rules=None, etl_tags=None, event_tags=None, key: str = "log_id",
                      threshold: int = DEFAULT_THRESHOLD, carry: tuple = ()) -> DataFrame:
    """Filtered events → instant / accumulated incidents."""
    events = filtered_events(raw_logs, rules, etl_tags, event_tags, carry=carry)
    return instant_and_accumulated(events, key=key, threshold=threshold)


def error_etl(raw_logs: DataFrame, rules=None) -> DataFrame:
    """Tag, keep error-tagged logs, emit their (high) events."""
    tagged = tag_logs(normalize_logs(raw_logs), rules)
    return create_events(etl_filter(tagged, ["error"]))
