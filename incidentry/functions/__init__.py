"""Column-expression helpers. Every helper returns a Catalyst expression, so they stay inside whole-stage codegen."""

from incidentry.functions.ids import det_id
from incidentry.functions.text import contains_ci, lower_strip, strip_ws
from incidentry.functions.timefmt import epoch_micros, iso_format, parse_event_time, to_json_iso

__all__ = ["det_id", "contains_ci", "lower_strip", "strip_ws", "epoch_micros", "iso_format", "parse_event_time",
           "to_json_iso"]
