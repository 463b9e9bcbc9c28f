"""Parquet table access. Reads are lazy; Catalyst prunes columns and pushes filters into the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from incidentry.session import table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
