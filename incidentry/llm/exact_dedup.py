"""Exact dedup by progressive refinement, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import ascii_lower, checkpointed, drop_rows, small_side, text_or_empty, with_row_key


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256,
                digest_all: bool = False, key: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256 (and the row key).

    Texts are equal when identical after lower-casing A-Z. Rows are grouped by byte length, then by a hash of the
    first ``prefix_chars`` characters; only rows whose group still has company are read in full and grouped by
    SHA-256. Of equal texts the row with the largest id stays. ``text_sha256`` is null for rows that were never read
    in full, unless ``digest_all`` asks for every row's.

    Both refinements and the final grouping are partial aggregates (a hot group leaves each map task as one row), and
    the full texts are not shuffled while the crowded prefix groups fit a broadcast; beyond that they are joined by
    shuffle. The groups go back to their rows in the same way: by broadcast within a counted limit, else by a shuffled join
    of two checkpointed tables, whose skewed groups AQE splits.

    Edge cases: null text counts as empty, empty texts equal each other; null ids rank lowest (a group of null ids
    has a null keep_id); rows repeated with one id count one by one and exactly one of them stays; an empty table
    gives no rows; other columns of ``docs`` are ignored whatever their names.

    ``key``: columns that identify a row, if ``docs`` has them already (see ``with_row_key``).
    """
    if key is None:
        docs, key = with_row_key(docs)
    k1, k2 = "_k1", "_k2"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(key[0]).alias(k1), F.col(key[1]).alias(k2),
                       text_or_empty(text_col).alias("_text"))
    measured = rows.withColumn("_len", F.octet_length("_text")).withColumn(
        "_prefix", F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))))

    narrow = checkpointed(measured.select("_len", "_prefix"))
    counted = narrow.groupBy("_len", "_prefix").count()
    lengths = counted.groupBy("_len").agg(F.sum("count").alias("_rows")).where("_rows > 1").select("_len")
    crowded = checkpointed(counted.join(lengths, "_len", "left_semi").where("count > 1")
                           .select("_len", "_prefix", F.lit(True).alias("_crowded")))

    full = F.sha2(ascii_lower(F.col("_text")), 256)
    read = F.col("_crowded").isNotNull()
    digests = checkpointed(
        measured.join(small_side(crowded), ["_len", "_prefix"], "left")
        .select("_id", k1, k2, "_len", read.alias("_read"),
                (full if digest_all else F.when(read, full)).alias("_digest")))

    suspects = digests.where("_read")
    groups = checkpointed(suspects.groupBy("_len", "_digest")
                          .agg(F.max(F.struct("_id", k1, k2)).alias("_top"), F.count("*").alias("_size")).where("_size > 1"))
    paired = suspects.join(small_side(groups), ["_len", "_digest"], "left").select(
        "_id", k1, k2, "_digest",
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_top._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | (F.col(f"_top.{k1}") == F.col(k1)) & (F.col(f"_top.{k2}") == F.col(k2)))
        .alias("kept"))
    alone = digests.where("NOT _read").select("_id", k1, k2, "_digest", F.col("_id").alias("keep_id"),
                                              F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return paired.unionByName(alone).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256"),
        F.col(k1).alias(key[0]), F.col(k2).alias(key[1]))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies that :func:`exact_dedup` rejects, columns unchanged."""
    keyed, key = with_row_key(docs)
    return drop_rows(keyed, key, exact_dedup(keyed, id_col, text_col, key=key).where("NOT kept"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
