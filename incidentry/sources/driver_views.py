"""Views that turn the driver's tables into the application's inputs.

The driver tables carry no application logs, so ``events`` stands in for the log feed, ``part`` for the product
table, ``lineitem`` for the price-update feed, and error / signup events for failed / successful logins. The SQL text
of each view is kept next to the DataFrame code because the DuckDB oracles run the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.sources.tables import read_table

# Fixed values of the log stand-in: message text per event_type.
LOG_MESSAGE_BY_TYPE = {
    "error": " ERROR: request failed ",
    "purchase": "WARNING: slow checkout",
    "signup": "INFO: new user",
    "view": "page view",
}
CLICK_EXCEPTION = "Unhandled Exception in click handler"
CLICK_PLAIN = "click"

LOG_VIEW_SQL = """
SELECT 'log-' || CAST(event_id AS VARCHAR) AS id, ts AS timestamp,
       '  SVC-' || CAST(user_id % 20 AS VARCHAR) || ' ' AS source,
       CASE event_type WHEN 'error' THEN ' ERROR: request failed '
                       WHEN 'purchase' THEN 'WARNING: slow checkout'
                       WHEN 'signup' THEN 'INFO: new user'
                       WHEN 'view' THEN 'page view'
                       ELSE CASE WHEN event_id % 10 = 0 THEN 'Unhandled Exception in click handler'
                                 ELSE 'click' END END AS message,
       props, user_id, event_id
FROM events
"""


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs: id, timestamp, source (un-normalised), message, metadata, plus user_id / event_id."""
    return logs_from_events(read_table(spark, sf_dir, "events"))


def logs_from_events(ev: DataFrame) -> DataFrame:
    """The log projection of an ``events`` frame, batch or streaming."""
    msg = F.col("event_type")
    message = F.when(msg == "error", LOG_MESSAGE_BY_TYPE["error"]) \
        .when(msg == "purchase", LOG_MESSAGE_BY_TYPE["purchase"]) \
        .when(msg == "signup", LOG_MESSAGE_BY_TYPE["signup"]) \
        .when(msg == "view", LOG_MESSAGE_BY_TYPE["view"]) \
        .otherwise(F.when(F.col("event_id") % 10 == 0, CLICK_EXCEPTION).otherwise(CLICK_PLAIN))
    metadata = F.map_concat(
        F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")),
        F.create_map(F.lit("ip"), F.col("user_id").cast("string")),
    )
    return ev.select(
        F.concat(F.lit("log-"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("  SVC-"), (F.col("user_id") % 20).cast("string"), F.lit(" ")).alias("source"),
        message.alias("message"),
        metadata.alias("metadata"),
        "props", "user_id", "event_id",
    )


def submissions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log submissions with bad rows for P2 / X6: the message is null where event_id % 50 = 0, and a second
    arrival time ``received_at = ts + (event_id % 7) seconds`` feeds the latency report (X4)."""
    logs = log_view(spark, sf_dir)
    return logs.select(
        "id", "timestamp", "source",
        submitted_message().alias("message"),
        "metadata", "user_id", "event_id",
        (F.col("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 7).cast("decimal(18,6)")))
        .alias("received_at"),
    )


def submitted_message() -> Column:
    """The message as submitted: null where event_id % 50 = 0."""
    return F.when(F.col("event_id") % 50 != 0, F.col("message"))


def products_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products: every row of ``part``, id ``'p' || p_partkey``, price DECIMAL(12,2)."""
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast("string").cast("decimal(12,2)").alias("price"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


def price_updates_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price updates from ``lineitem``: id ``'p' || l_partkey``, or the unknown id ``'x' || l_partkey`` where l_partkey
    is a multiple of 10; a negative price where l_quantity >= 49; time l_shipdate; ties broken by (l_orderkey,
    l_linenumber)."""
    li = read_table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_quantity") >= 49, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    letter = F.when(F.col("l_partkey") % 10 == 0, "x").otherwise("p")
    return li.select(
        F.concat(letter, F.col("l_partkey").cast("string")).alias("id"),
        price.alias("price"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").cast("bigint").alias("seq2"),
    )


def login_attempts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login attempts: error events are wrong passwords, signup events are successful logins; user
    :func:`attempted_username`."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return ev.select(
        attempted_username().alias("username"),
        F.col("ts"),
        (F.col("event_type") == "signup").alias("password_ok"),
        F.col("event_id").alias("attempt_id"),
    )


def users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered users: every user seen in ``events``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username")).distinct()


def attempted_username() -> Column:
    """The name typed at a login: ``u<user_id>``, misspelt as ``x<user_id>`` (an unknown username, J3) by users whose
    id is a multiple of 25."""
    return F.concat(F.when(F.col("user_id") % 25 == 0, "x").otherwise("u"), F.col("user_id").cast("string"))
