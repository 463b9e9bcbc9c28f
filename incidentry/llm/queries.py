"""The registered queries of this package: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm import exact_dedup as exact
from incidentry.llm import line_dedup, mixing
from incidentry.llm import level_dedup, nra_search
from incidentry.llm import fill_middle as fim
from incidentry.llm.crf_language import identify, train_on
from incidentry.llm.license_scan import scan_licenses
from incidentry.llm.packing import pack_documents
from incidentry.llm.permutation_index import nearest
from incidentry.llm.simhash import simhash_groups
from incidentry.llm.suffix_dedup import remove_repeats
from incidentry.llm.token_files import read_token_files, token_digest, write_token_files
from incidentry.session import scratch_path, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Queries that SQL cannot express, each with the test that holds it against brute force (or held-out accuracy).
BRUTE_FORCE_TESTS = {
    "op1_cost_balanced_packing": "tests/llm/test_first_ops.py::test_query_packs_every_id_with_little_padding",
    "op2_permutation_index": "tests/llm/test_ann_lines.py::test_recall_on_whole_tables",
    "op4_simhash_covering": "tests/llm/test_first_ops.py::test_query_simhash_equals_brute_force",
    "op5_orc_token_files": "tests/llm/test_first_ops.py::test_token_files_edges",
    "op6_suffix_array_dedup": "tests/llm/test_suffix_dedup.py::test_query_equals_brute_force",
    "op8_crf_language": "tests/llm/test_language_license.py::test_identify_equals_enumeration",
    "op9_patience_licenses": "tests/llm/test_language_license.py::test_license_query_finds_the_lines",
}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


@register("op1_cost_balanced_packing")
def op1(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), with_ids=False)


@register("op2_permutation_index")
def op2(spark, sf_dir):
    vectors = spark.read.parquet(table_path(sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@register("op3_source_mixing", mixing.oracle_sql())
def op3(spark, sf_dir):
    return mixing.mix_plan(documents(spark, sf_dir))


@register("op4_simhash_covering")
def op4(spark, sf_dir):
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@register("op5_orc_token_files")
def op5(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    return token_digest(read_token_files(spark, path))


@register("op6_suffix_array_dedup")
def op6(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"))  # a cut may fall within a character


@register("op7_progressive_exact_dedup", exact.SQL)
def op7(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir), digest_all=True).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op8_crf_language")
def op8(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs, train_on(docs))


@register("op9_patience_licenses")
def op9(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


@register("op10_site_spread_lines", line_dedup.oracle_sql())
def op10(spark, sf_dir):
    cleaned = line_dedup.drop_spread_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", F.size(line_dedup.lines_of(F.coalesce("text", F.lit("")))).cast("long").alias("n_lines"),
                          F.size("removed_lines").cast("long").alias("n_removed"),
                          F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op11_level_substring_dedup", level_dedup.oracle_sql())
def op11(spark, sf_dir):
    return level_dedup.remove_repeated_windows(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "kept")


@register("op12_nra_search", nra_search.oracle_sql())
def op12(spark, sf_dir):
    return nra_search.search(documents(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "benchmark")))


@register("op13_wavelet_fill_middle", fim.SQL)
def op13(spark, sf_dir):
    return fim.fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
