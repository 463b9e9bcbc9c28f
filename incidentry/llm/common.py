"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.session import ensure_checkpoint_dir, pickle_by_value

#: The characters the contracts call white space, as a regular expression of the others.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Tables of at most this many rows (a few fixed-width columns each) may be broadcast; above it joins shuffle.
BROADCAST_ROWS = 500_000


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII strings take Spark's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed narrow table: marked for broadcast when its counted rows are within ``limit``, else left to a
    shuffled join (which AQE splits when skewed)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_lists(df: DataFrame, column: str, limit: int = 3_000_000) -> DataFrame:
    """The same for a checkpointed table of lists of numbers, by the counted length of all lists."""
    total = df.agg(F.sum(F.size(column) + 1)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def fresh_name(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two long columns that identify each row, and their names (chosen not to clash).

    For files the key is (hash of the file's path, row position in it): the same in every job that reads them,
    whatever the split sizes or the executors. Other inputs get a number per row and are checkpointed, so that the
    number does not change between jobs.
    """
    part, row = fresh_name(docs, "_row_part"), fresh_name(docs, "_row_pos")
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(part),
                           F.col("_metadata.row_index").alias(row)), [part, row]
    except AnalysisException:
        return checkpointed(docs.select("*", F.lit(0).cast("long").alias(part),
                                        F.monotonically_increasing_id().alias(row))), [part, row]


def drop_rows(keyed: DataFrame, key: list[str], dropped: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not in ``dropped``, with the key columns gone."""
    dropped = small_side(checkpointed(dropped.select(*key)))
    return keyed.join(dropped, key, "left_anti").drop(*key)


def running_total(df: DataFrame, order: list[Column], value: str, into: str) -> DataFrame:
    """``into`` = sum of ``value`` over all rows before this one in ``order``, without one task seeing all rows.

    Rows are range-partitioned by ``order`` and checkpointed with their partition number; a total per partition (as
    many rows as partitions) gives each partition its offset, and a window inside the partition does the rest.
    """
    part = fresh_name(df, "_range")
    parted = checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    base = fresh_name(parted, "_base")
    totals = parted.groupBy(part).agg(F.sum(value).alias(base))
    offsets = totals.withColumn(base, F.coalesce(F.sum(base).over(_before(F.lit(0), F.col(part))), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(_before(F.col(part), *order)), F.lit(0))
    return (parted.withColumn(into, inside).join(F.broadcast(offsets), part)
            .withColumn(into, (F.col(into) + F.col(base)).cast("long")).drop(part, base))


def _before(by: Column, *order: Column):
    from pyspark.sql import Window
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def worker_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for caches that outlast a task. A worker holds one at a
    time: asking for another name drops the last one's, so that a job of many stages does not add them up."""
    holder = sys.modules.setdefault("_incidentry_memo", types.ModuleType("_incidentry_memo")).__dict__
    if holder.get("name") != name:
        holder["name"], holder["memo"] = name, {}
    return holder["memo"]


def trim_memory() -> None:
    """Give freed memory of this Python worker back to the system: workers outlive the stages they serve."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass


def slices(rows: int, size: int) -> Iterator[tuple[int, int]]:
    for start in range(0, rows, size):
        yield start, min(rows, start + size)


pickle_by_value(__name__)
