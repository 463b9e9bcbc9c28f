"""Rules tables (S7) and their normalisation.

A rules table is any DataFrame with ``tag`` and ``keywords`` columns (``keywords`` either a comma string or an
array of strings; both shapes may be mixed through a ``keywords_text`` string column next to an array
``keywords`` column) and an optional ``rule_order`` column giving scan order. Normalisation runs on Spark; only the
normalised rules (one row per tag, configuration that every worker holds) come to the driver, to become literals.
"""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from incidentry.constants import DEFAULT_ETL_TAGS, DEFAULT_EVENT_TAGS, DEFAULT_TAG_RULES  # noqa: F401


_WS = r"(?U)^\s+|\s+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _WS, "")


def _keyword_shapes(df: DataFrame) -> tuple[Column, Column]:
    """(text keywords or null, list keywords or null) whatever the input shape is."""
    kw_type = df.schema["keywords"].dataType if "keywords" in df.columns else None
    text = F.lit(None).cast("string")
    lst = F.lit(None).cast("array<string>")
    if isinstance(kw_type, StringType):
        text = F.col("keywords")
    elif isinstance(kw_type, ArrayType):
        lst = F.col("keywords").cast("array<string>")
    if "keywords_text" in df.columns:
        text = F.coalesce(F.col("keywords_text"), text)
    return text, lst


def _ordered(df: DataFrame) -> DataFrame:
    if "rule_order" in df.columns:
        return df.withColumn("rule_order", F.col("rule_order").cast("bigint"))
    # Without an explicit scan order (a key-value table scan has none) all rules share one position and ties are
    # broken by the normalised tag name wherever an order is needed.
    return df.withColumn("rule_order", F.lit(0).cast("bigint"))


def normalize_tag_rules(df: DataFrame) -> DataFrame:
    """P7 (tagger flavour) → (rule_order, tag, keywords ARRAY<STRING>), one row per tag.

    tag: text, stripped, lower-cased; empty tags skipped. Text keywords are split on ',', stripped, blanks dropped,
    and a rule whose text yields no keyword is skipped. List keywords keep their spelling (not stripped) but blank
    ones are dropped; a non-empty list whose keywords are all blank stays as a rule that never matches. A tag seen
    again replaces the earlier keywords but keeps the earlier position.
    """
    df = _ordered(df)
    text, lst = _keyword_shapes(df)
    from_text = F.filter(F.transform(F.split(text, ","), lambda k: _strip(k)), lambda k: k != "")
    from_list = F.filter(lst, lambda k: _strip(k) != "")
    usable = F.when(text.isNotNull(), F.size(from_text) > 0).otherwise(
        lst.isNotNull() & (F.size(lst) > 0))
    rows = df.select(
        F.col("rule_order"),
        F.lower(_strip(F.col("tag").cast("string"))).alias("tag"),
        F.when(text.isNotNull(), from_text).otherwise(from_list).alias("keywords"),
        usable.alias("usable"),
    ).where(F.col("usable") & F.col("tag").isNotNull() & (F.col("tag") != ""))
    return rows.groupBy("tag").agg(
        F.min("rule_order").alias("rule_order"),
        F.max_by("keywords", "rule_order").alias("keywords"),
    ).select("rule_order", "tag", "keywords")


def normalize_model_rules(df: DataFrame) -> DataFrame:
    """P7 (matcher flavour) → (rule_order, tag): the tags of usable rules, first position kept."""
    df = _ordered(df)
    text, lst = _keyword_shapes(df)
    from_text = F.filter(F.transform(F.split(text, ","), lambda k: _strip(k)), lambda k: k != "")
    usable = F.when(text.isNotNull(), F.size(from_text) > 0).otherwise(lst.isNotNull() & (F.size(lst) > 0))
    rows = df.select("rule_order", F.lower(_strip(F.col("tag").cast("string"))).alias("tag"), usable.alias("ok")) \
        .where(F.col("ok") & F.col("tag").isNotNull() & (F.col("tag") != ""))
    return rows.groupBy("tag").agg(F.min("rule_order").alias("rule_order")).select("rule_order", "tag")


def tag_rules_from_table(df: DataFrame | None) -> list[tuple[str, list[str]]]:
    """Normalised rules as an ordered Python list, defaults when nothing usable."""
    if df is None:
        return DEFAULT_TAG_RULES
    rows = normalize_tag_rules(df).collect()
    rules = [(r["tag"], list(r["keywords"])) for r in sorted(rows, key=lambda r: (r["rule_order"], r["tag"]))]
    return rules or DEFAULT_TAG_RULES


def event_tags_from_table(df: DataFrame | None) -> list[str]:
    """Normalised tags of the matcher in order, defaults when nothing usable."""
    if df is None:
        return DEFAULT_EVENT_TAGS
    rows = normalize_model_rules(df).collect()
    tags = [r["tag"] for r in sorted(rows, key=lambda r: (r["rule_order"], r["tag"]))]
    return tags or DEFAULT_EVENT_TAGS


def read_rules_table(spark, path: str, fmt: str = "parquet"):
    """The rules table at ``path``, or None when it cannot be read (missing path, unreadable footer or data), in which
    case the tagger and the matcher use their default rules, as the application does when its rules store fails.

    Rules are configuration and come to the driver whole in any case (``tag_rules_from_table``), so they are read here
    once: a damaged data file shows here, not in the job that tags the logs."""
    try:
        df = spark.read.format(fmt).load(path)
        return spark.createDataFrame(df.collect(), df.schema)
    except (PySparkException, Py4JJavaError) as failure:
        logging.getLogger(__name__).warning("rules table %s not readable, default rules: %s", path,
                                                str(failure).splitlines()[0])
        return None
