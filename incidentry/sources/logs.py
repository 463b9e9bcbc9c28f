"""Log feeds in batch: JSON queue bodies / objects (S1, P3, P6) and in-memory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.functions import parse_event_time
from incidentry.operators.normalize import parse_json_logs
from incidentry.schemas import LOG_SUBMISSION


def read_log_files(spark: SparkSession, path: str, schema=LOG_SUBMISSION):
    """A folder of JSON log lines → (logs, corrupt). The text timestamp is kept, and ``event_time`` holds
    its parsed value with the epoch as fallback (P6), which is what event-time operators use."""
    lines = spark.read.text(path)
    good, bad = parse_json_logs(lines, "value", schema)
    return good.withColumn("event_time", parse_event_time("timestamp")), bad


def logs_from_rows(spark: SparkSession, rows: list[dict], schema=LOG_SUBMISSION) -> DataFrame:
    """An in-memory collection of log dicts as a DataFrame (small fixtures and demos only)."""
    return spark.createDataFrame(rows, schema)


def source_message(logs: DataFrame) -> DataFrame:
    """The (source, message) projection the aggregation jobs start from."""
    return logs.select(F.col("source"), F.col("message"))
