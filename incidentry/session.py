"""Spark session helpers.

Nothing here tunes Spark per query: the library only builds DataFrames. These helpers exist for tests, the bench
and local runs, and for the one piece of shared state the library needs: a folder for lineage cuts and streaming
checkpoints. That folder is read from ``spark.checkpoint.dir`` (the cluster names a shared location there); a local
default is set only when the session has none, as in tests.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Local-only fallback used when the session does not name a shared checkpoint folder.
_LOCAL_FALLBACK = "/tmp/incidentry-checkpoints"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "incidentry",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests / bench. Cluster jobs get their session from the platform instead."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        # checkpoints written to cut lineage (brute-force rule) are removed once their DataFrame is gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only if a local session names none."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = _LOCAL_FALLBACK
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for stream checkpoints and written intermediates)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/incidentry/{kind}/{uuid.uuid4().hex}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")



def pickle_by_value(module_name: str) -> None:
    """Let cloudpickle ship a module's functions and classes *by value* with the pandas functions / state processors
    that use them, so neither the Python workers nor Spark's driver-side Python runners have to import this package
    (it need not be installed on the cluster)."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
