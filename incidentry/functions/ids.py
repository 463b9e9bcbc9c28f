"""Deterministic ids: md5 of ``kind:natural key``; DuckDB's md5 gives the same hex string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def det_id(kind: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(kind + ":"), key.cast("string")))
