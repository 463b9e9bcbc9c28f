"""Latest row per key (T5): the outcome of keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Keep, per key, the row that is greatest in ``order`` (lexicographic; later columns break ties).

    ``max_by`` over a struct is a partial aggregate: each map task keeps one candidate per key before the shuffle,
    so a key with a third of all rows costs one row per map task, not a third of the data in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Keep, per key, the row that is least in ``order`` (e.g. the first copy of an exact duplicate)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
