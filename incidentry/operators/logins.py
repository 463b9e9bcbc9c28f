"""Failed-login counter (T4) and username membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.operators.scan import segmented_running_sum
from incidentry.constants import LOGIN_OK, LOGIN_TTL_SECONDS, UNKNOWN_USER, WRONG_PASSWORD

DEFAULT_TTL_SECONDS = LOGIN_TTL_SECONDS


def mark_known_users(attempts: DataFrame, users: DataFrame, user_col: str = "username") -> DataFrame:
    """Adds ``known``. ``users`` is reduced to distinct names first, so the left join never multiplies rows."""
    names = users.select(F.col(user_col).alias(user_col)).distinct().withColumn("_known", F.lit(True))
    return attempts.join(names, user_col, "left").withColumn("known", F.coalesce(F.col("_known"), F.lit(False))) \
        .drop("_known")


def login_attempt_counts(attempts: DataFrame, users: DataFrame, ttl_seconds: int | None = DEFAULT_TTL_SECONDS,
                         order: tuple[str, str] = ("ts", "attempt_id"), ranges: int | None = None) -> DataFrame:
    """T4: per known user in time order, a wrong password increments the counter, which lapses ``ttl_seconds``
    after the previous attempt (``None``: never); a correct password clears it and answers 0; an unknown username
    answers 0 and never counts. Output adds ``success``, ``attempts`` and the answer ``message``."""
    marked = mark_known_users(attempts, users)
    # unknown users go through the same scan with no increment (their answer is always 0), so the attempts are
    # neither split nor unioned back
    failure = (F.col("known") & ~F.col("password_ok")).cast("int")
    both = segmented_running_sum(
        marked, "username", list(order), failure, "attempts",
        reset=F.col("password_ok"),
        gap_micros=None if ttl_seconds is None else int(ttl_seconds) * 1_000_000,
        ranges=ranges)
    both = both.withColumn("attempts", F.when(F.col("password_ok") | ~F.col("known"), F.lit(0).cast("bigint"))
                           .otherwise(F.col("attempts")))
    message = F.when(~F.col("known"), F.lit(UNKNOWN_USER)) \
        .when(F.col("password_ok"), F.lit(LOGIN_OK)) \
        .otherwise(F.concat(F.lit(WRONG_PASSWORD), F.col("attempts").cast("string")))
    success = F.col("known") & F.col("password_ok")
    return both.withColumns({"success": success, "message": message})
