"""Mixing sources to target weights, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import WORD_PATTERN, checkpointed, fresh_name, running_total, small_side

#: Hex digits (4 bits each) of the MD5 that decides the Bernoulli copy.
COIN_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def coin(ident: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the id and the seed; a null id has one of its own."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, COIN_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** COIN_DIGITS))


def source_rates(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per source of ``sized`` (source, size): source, source_size, target, rate.

    Sources in code-point order, null last, take ``weights`` in turn and share all words by weight; no target
    exceeds ``cap`` times its source's size, and what is cut off is reshared by weight until none is above. Each round
    of resharing is one aggregate over the table of sources; only two sums and a count reach the driver.
    """
    sums = (sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
            .withColumn("_one", F.lit(1).cast("long")))
    placed = running_total(sums, [F.col("source").asc_nulls_last()], "_one", "_place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = checkpointed(placed.select(
        "source", "source_size", F.get(cycle, (F.col("_place") % len(weights)).cast("int")).alias("_weight")))
    limit = F.col("source_size") * F.lit(float(cap))
    total, all_weights = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)),
                                   F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
    share, capped = total / all_weights if all_weights else 0.0, 0
    while True:
        above = F.col("_weight") * F.lit(share) >= limit
        spent, open_weight, count = table.agg(
            F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("_weight"))), F.count_if(above)).first()
        if count == capped or not open_weight:
            break
        share, capped = (total - spent) / open_weight, count
    target = F.least(F.col("_weight") * F.lit(share), limit)
    return table.select("source", "source_size", target.alias("target"),
                        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _with_copies(rows: DataFrame, source: str, ident: str, rates: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their source's columns of ``rates`` and ``_copies``: floor(rate), plus one if the coin falls below
    the rest."""
    rates = small_side(checkpointed(rates.withColumnRenamed("source", "_rate_source")))
    joined = rows.join(rates, F.col(source).eqNullSafe(F.col("_rate_source")), "left").drop("_rate_source")
    whole = F.floor("rate")
    extra = (coin(F.col(ident), seed) < F.col("rate") - whole).cast("int")
    return joined.withColumn("_copies", (whole + extra).cast("int"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, source_size, target, copies, taken (copies times size).

    Size is the number of words (runs of characters other than ASCII white space). A document is taken floor(rate)
    times, and once more with probability rate - floor(rate), rate being its source's target over its size; the coin
    is a hash of id and seed, so reruns agree.

    Edge cases: null text has size 0; null source is a source of its own, the last; a source without words has
    target and rate 0 and its documents are not taken; rows repeated with one id share a coin; an empty table gives no
    rows; other columns of ``docs`` are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                       word_count(F.col(text_col)).alias("size"))
    rates = source_rates(rows.select(F.col("_source").alias("source"), "size"), weights, cap)
    return _with_copies(rows, "_source", "_id", rates, seed).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("size")).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_plan` takes it, columns unchanged.

    The documents are not shuffled: they meet a table of one row per source (broadcast once its size is checked) and
    repeat in place. Documents without words go with their source's rate like any other.
    """
    row = fresh_name(docs, "_row")
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rates = source_rates(sized, weights, cap)
    packed = docs.select(F.col(source_col).alias("_source"), F.col(id_col).alias("_id"), F.struct("*").alias(row))
    taken = _with_copies(packed, "_source", "_id", rates, seed).where("_copies > 0")
    return (taken.select(row, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
            .select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def oracle_sql(weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 42) -> str:
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(weights)} {cases} END::DOUBLE AS w
      FROM d GROUP BY source),
p AS (SELECT *, {cap} * source_size AS lim, {cap}::DOUBLE * source_size / w AS ratio FROM s),
k AS (SELECT *, row_number() OVER o AS k, coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             ::DOUBLE AS spent,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
      FROM p WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
l AS (SELECT ((SELECT sum(source_size) FROM s)::DOUBLE - spent) / open_w AS share FROM k
      WHERE w * (((SELECT sum(source_size) FROM s)::DOUBLE - spent) / open_w) < lim ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM l) = 0 THEN lim::DOUBLE
             ELSE least(w * (SELECT share FROM l), lim::DOUBLE) END AS target FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
             ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, {COIN_DIGITS}))::BIGINT
             / {float(16 ** COIN_DIGITS)} AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (floor(rate) + (u < rate - floor(rate))::INT)::INT AS copies,
       ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken
FROM c
"""
