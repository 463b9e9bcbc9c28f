"""Fixed record shapes as Spark StructTypes."""

from pyspark.sql.types import (ArrayType, BooleanType, DecimalType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampType)

METADATA = MapType(StringType(), StringType())
TAGS = ArrayType(StringType())

RAW_LOG = StructType([
    StructField("id", StringType(), False),
    StructField("timestamp", TimestampType()),
    StructField("source", StringType()),
    StructField("message", StringType()),
    StructField("metadata", METADATA),
])

TAGGED_LOG = StructType(RAW_LOG.fields + [StructField("tags", TAGS)])

# Permissive read schema for submissions / queue bodies: everything nullable, timestamp kept as text so that
# validation (P2) and the epoch fallback (P6) can see what was sent.
LOG_SUBMISSION = StructType([
    StructField("id", StringType()),
    StructField("timestamp", StringType()),
    StructField("source", StringType()),
    StructField("message", StringType()),
    StructField("metadata", METADATA),
])

EVENT = StructType([
    StructField("id", StringType(), False),
    StructField("timestamp", TimestampType()),
    StructField("log_id", StringType()),
    StructField("type", StringType()),
    StructField("severity", StringType()),
    StructField("description", StringType()),
    StructField("metadata", METADATA),
])

INCIDENT = StructType([
    StructField("id", StringType(), False),
    StructField("timestamp", TimestampType()),
    StructField("events", TAGS),
    StructField("status", StringType()),
    StructField("summary", StringType()),
    StructField("owner", StringType()),
    StructField("rule", StringType()),
])

# Claim-check message published after a tagged log is stored.
CLAIM_CHECK = StructType([
    StructField("s3_key", StringType()),
    StructField("log_id", StringType()),
    StructField("timestamp", StringType()),
    StructField("tags", TAGS),
])

RULE = StructType([
    StructField("tag", StringType()),
    StructField("keywords", StringType()),  # either a comma string or a JSON-ish list; see sources.rules
])

PRODUCT = StructType([
    StructField("id", StringType(), False),
    StructField("name", StringType(), False),
    StructField("price", DecimalType(12, 2), False),
    StructField("updated_at", TimestampType()),
])

PRICE_UPDATE = StructType([
    StructField("id", StringType()),
    StructField("price", StringType()),
    StructField("ts", TimestampType()),
])

LOGIN_ATTEMPT = StructType([
    StructField("username", StringType()),
    StructField("ts", TimestampType()),
    StructField("password_ok", BooleanType()),
])

ERROR_COUNT = StructType([
    StructField("source", StringType()),
    StructField("error_count", IntegerType()),
])

COUNT = LongType()
