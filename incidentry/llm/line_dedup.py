"""Removal of lines spread over many sites, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import checkpointed, fresh_name, small_lists, small_side, text_or_empty, with_row_key

#: log2 of an HLL sketch's registers (relative error about 1.04 / sqrt(2^12) = 1.6 %), and the errors around the
#: threshold within which sites are counted exactly.
LOG_REGISTERS, BAND_ERRORS = 12, 4.0


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def line_hash(line: Column) -> Column:
    """Identity of a line: SHA-256 of it without ASCII white space at its ends."""
    return F.unhex(F.sha2(trimmed(line), 256))


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Line hashes of ``lines`` (line, site) found on ``min_sites`` or more distinct sites.

    A HyperLogLog sketch of sites per line is built on the map side and merged by aggregation. Estimates clearly above
    the threshold decide; for those within ``BAND_ERRORS`` standard errors of it the sites are counted exactly.
    """
    error = BAND_ERRORS * 1.04 / 2 ** (LOG_REGISTERS / 2)
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    estimates = checkpointed(sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
                             .where(F.col("sites") >= F.floor(F.lit(min_sites * (1 - error)))))
    sure = F.col("sites") > F.ceil(F.lit(min_sites * (1 + error)))
    near = small_side(estimates.where(~sure).select("line"))
    exact = (lines.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n"))
             .where(F.col("n") >= min_sites).select("line"))
    return estimates.where(sure).select("line").unionByName(exact)


def drop_spread_lines(docs: DataFrame, min_sites: int = 10, min_chars: int | None = None, id_col: str = "doc_id",
                      text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with a column ``removed_lines`` (array of line numbers from 0) and ``kept_text``: the text without its
    lines that occur on ``min_sites`` or more sites.

    A line is what stands between line feeds, compared without ASCII white space at its ends. Every line takes part that
    is not blank, however short; ``min_chars`` can leave out, from counting and removal, those shorter than that
    without the white space at their ends. First (line, site) pairs are reduced on the map side, so a
    line on every page leaves each task once a site; the spread lines are found by :func:`spread_lines`; documents
    meet them as rows (row key, line number, hash), whole texts are not exploded in a shuffle.

    Edge cases: null text counts as empty and stays so; a null site is a site of its own; lines repeated within a
    document or site count once; rows repeated with one id are each cleaned; an empty table gives no rows; other
    columns stay, clashing names included (the two new columns then get leading underscores).
    """
    keyed, key = with_row_key(docs)
    text = text_or_empty(text_col)
    # a null site as a hash of its own: 0 is not the hash of any site's name in practice
    site = F.when(F.col(site_col).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(site_col).cast("string"))).cast("long")
    rows = keyed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], site.alias("site"),
                        F.posexplode(lines_of(text)).alias("at", "raw"))
    takes_part = F.char_length(trimmed(F.col("raw"))) >= max(1, min_chars or 1)
    rows = rows.where(takes_part).select("_k0", "_k1", "site", "at", line_hash(F.col("raw")).alias("line"))
    rows = checkpointed(rows)
    spread = small_side(checkpointed(spread_lines(rows.select("line", "site"), min_sites)))
    found = fresh_name(keyed, "_removed")
    removed = (rows.join(spread, "line", "left_semi").groupBy("_k0", "_k1")
               .agg(F.sort_array(F.collect_set("at")).alias(found)))
    removed = small_lists(checkpointed(removed.select(F.col("_k0").alias(key[0]), F.col("_k1").alias(key[1]),
                                                      found)), found)
    gone, left = fresh_name(docs, "removed_lines"), fresh_name(docs, "kept_text")
    numbers = F.coalesce(found, F.array().cast("array<int>"))
    kept = F.array_join(F.filter(lines_of(text), lambda line, i: ~F.array_contains(numbers, i)), "\n")
    return (keyed.join(removed, key, "left").withColumn(gone, numbers)
            .withColumn(left, F.when(F.size(numbers) == 0, text).otherwise(kept)).drop(found, *key))


def oracle_sql(min_sites: int = 10) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
h AS (SELECT *, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM l),
s AS (SELECT line FROM h WHERE line <> '' GROUP BY line
      HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= {min_sites}),
m AS (SELECT h.*, line IN (SELECT line FROM s) AS gone FROM h)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
