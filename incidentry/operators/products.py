"""Product table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.functions import iso_format
from incidentry.operators.upsert import latest_per_key
from incidentry.constants import PRICE_TYPE, SEED_PRODUCTS



def to_price(c: Column) -> Column:
    """``Decimal(str(x))`` into NUMERIC(12,2): the shortest text of the double, rounded half-up to cents."""
    return c.cast("string").cast(PRICE_TYPE)


def seed_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_PRODUCTS, "id STRING, name STRING, price STRING") \
        .withColumn("price", F.col("price").cast(PRICE_TYPE))


def seed_products(existing: DataFrame, seed: DataFrame, only_if_empty: bool = False,
                  as_of: Column | None = None) -> DataFrame:
    """Insert seed rows whose id is not present (``ON CONFLICT (id) DO NOTHING``); with ``only_if_empty`` the
    seeds go in only when the table has no rows at all (A4: one bounded count). Seeds without an ``updated_at`` get
    ``as_of`` (default: now, as the table's column does)."""
    if "updated_at" not in seed.columns:
        now = F.current_timestamp() if as_of is None else as_of
        seed = seed.withColumn("updated_at", now.cast(existing.schema["updated_at"].dataType))
    if only_if_empty:
        return existing.unionByName(seed) if existing.isEmpty() else existing
    return existing.unionByName(seed.join(existing.select("id"), "id", "left_anti"))


def validate_prices(updates: DataFrame):
    """F8: (valid, rejected); a missing or negative price is rejected before any update is applied."""
    bad = F.col("price").isNull() | (F.col("price") < 0)
    rejected = updates.where(bad).withColumn("reject_reason", F.lit("negative price"))
    return updates.where(~bad), rejected


def apply_price_updates(products: DataFrame, updates: DataFrame, order: list[str] = ("ts",)):
    """Validated updates, the latest per id (T5), merged onto the products (J4). Returns (products, rejected):
    rejected = negative prices plus valid updates for unknown ids (the 404 case), each update reported once."""
    valid, rejected_neg = validate_prices(updates)
    latest = latest_per_key(valid, "id", list(order))
    merged = products.alias("p").join(latest.alias("u"), "id", "left").select(
        "id", F.col("p.name").alias("name"),
        F.coalesce(to_price(F.col("u.price")), F.col("p.price")).alias("price"),
        F.coalesce(F.col("u.ts").cast(products.schema["updated_at"].dataType), F.col("p.updated_at"))
        .alias("updated_at"))
    unknown = valid.join(products.select("id"), "id", "left_anti").withColumn("reject_reason", F.lit("unknown id"))
    return merged, rejected_neg.unionByName(unknown)


def product_view(products: DataFrame) -> DataFrame:
    """API view, price as float and ``updated_at`` as ISO text."""
    return products.select("id", "name", F.col("price").cast("double").alias("price"),
                           iso_format("updated_at").alias("updated_at"))


def list_products(products: DataFrame) -> DataFrame:
    """S10 + O1: the product list ordered by id."""
    return product_view(products).orderBy("id")


def get_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    """F7 as a batch: each requested id with its product, or nulls and ``found = false`` (the 404 case)."""
    wanted = requests.select("id").distinct()
    view = product_view(products).withColumn("found", F.lit(True))
    return wanted.join(view, "id", "left").withColumn("found", F.coalesce(F.col("found"), F.lit(False)))
