"""Time helpers: ISO text in and out, epoch fallback, microsecond ordering keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats (Python isoformat(): the fraction is printed only when non-zero).
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def iso_format(c: Column | str) -> Column:
    """``datetime.isoformat()`` of a naive timestamp."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(None)).when(
        F.date_format(c, "SSSSSS") == F.lit("000000"), F.date_format(c, ISO_SECONDS)
    ).otherwise(F.date_format(c, ISO_MICROS))


def parse_event_time(c: Column | str) -> Column:
    """ISO text → timestamp; anything unparsable becomes the epoch (the reference returns 0 ms)."""
    c = _col(c)
    return F.coalesce(F.try_to_timestamp(c), F.to_timestamp(F.lit("1970-01-01 00:00:00")))


def epoch_micros(c: Column | str) -> Column:
    """Zone-free microsecond count for TIMESTAMP_NTZ or TIMESTAMP (monotone, used for chunking)."""
    c = _col(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def to_json_iso(c: Column) -> Column:
    """JSON text of a struct with microsecond ISO timestamps (Spark's default would cut to milliseconds)."""
    opts = {"timestampFormat": ISO_MICROS, "timestampNTZFormat": ISO_MICROS}
    return F.to_json(c, opts)
