"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet under the shared folder
of ``spark.checkpoint.dir`` and reads it again as the next stage's docs. All stages but the last return the columns
of ``documents``. Rows, not ids, are the unit: the mix repeats documents, and packing packs every copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from incidentry.llm.crf_language import keep_identified, keep_lettered, train_on
from incidentry.llm.exact_dedup import drop_exact_copies
from incidentry.llm.mixing import mix_sources
from incidentry.llm.packing import pack_documents
from incidentry.llm.simhash import drop_near_copies
from incidentry.session import scratch_path, table_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language in particular, go. Without labelled texts to learn from, no language
    can be judged and only those without letters go."""
    model = train_on(docs)
    return keep_lettered(docs) if model is None else keep_identified(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row of the largest doc_id stays."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints linked at 3 bits or fewer, the row of the smallest doc_id stays."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, with_ids=False)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("mixing", mix), ("packing", pack)]

#: Language ID, SimHash and tokenising are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None
BRUTE_FORCE_TEST = "tests/llm/test_pipeline.py::test_stages_equal_brute_force"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
