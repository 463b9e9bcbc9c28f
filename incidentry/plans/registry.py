"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver tables through the views of ``sources.driver_views`` and returns flat columns (arrays
are joined with ',') so the oracle comparison is exact. Names follow SURVEY §7.3.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.operators.events import create_events
from incidentry.operators.filters import etl_filter, model_match, tags_overlap
from incidentry.operators.incidents import instant_and_accumulated
from incidentry.operators.normalize import normalize_logs
from incidentry.operators.tagging import tag_logs
from incidentry.plans import batch_jobs
from incidentry.sources.driver_views import LOG_VIEW_SQL, log_view
from incidentry.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------------------------------------------------
# Shared oracle fragments (DuckDB). They restate the semantics in SQL; they are not used by the Spark code.

_NORM_SQL = f"""
norm AS (SELECT id, timestamp, lower(trim(source)) AS source, trim(message) AS message, user_id, event_id, props
         FROM ({LOG_VIEW_SQL}))"""

_DEFAULT_TAGS_SQL = """list_filter([
    CASE WHEN contains(lower(message), 'error') OR contains(lower(message), 'exception') THEN 'error' END,
    CASE WHEN contains(lower(message), 'warn') OR contains(lower(message), 'warning') THEN 'warning' END,
    CASE WHEN contains(lower(message), 'info') THEN 'info' END], lambda x: x IS NOT NULL)"""

_TAGGED_SQL = f"""{_NORM_SQL},
tagged AS (SELECT *, {_DEFAULT_TAGS_SQL} AS tags FROM norm)"""

_EVENTS_OF = """SELECT md5('event:' || id) AS id, timestamp, id AS log_id, 'log_event' AS type,
       CASE WHEN list_contains(tags, 'error') THEN 'high' ELSE 'medium' END AS severity,
       'Event from log: ' || message AS description, user_id, source"""


def _t2_sql(events_cte: str, key: str, threshold: int, since: str | None = None, days: int | None = None) -> str:
    """T2 oracle: row_number per key + CASE; optionally only incidents in [since - days, since)."""
    span = "" if since is None else (f"timestamp >= TIMESTAMP '{since}' - INTERVAL {days} DAYS AND "
                                     f"timestamp < TIMESTAMP '{since}' AND ")
    return f"""WITH {events_cte},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, id) AS rn FROM ev)
SELECT md5('incident:instant:' || id) AS id, timestamp, id AS events, 'open' AS status,
       'Instant incident from event: ' || description AS summary, CAST(NULL AS VARCHAR) AS owner,
       'instant' AS rule, id AS event_id, CAST({key} AS VARCHAR) AS key
FROM ranked WHERE {span}severity = 'high'
UNION ALL
SELECT md5('incident:accumulated:' || id), timestamp, id, 'open',
       'Accumulated incident from log ' || CAST({key} AS VARCHAR), CAST(NULL AS VARCHAR),
       'accumulated', id, CAST({key} AS VARCHAR)
FROM ranked WHERE {span}severity <> 'high' AND rn >= {threshold}"""


def _flat_incidents(df: DataFrame) -> DataFrame:
    return df.select("id", "timestamp", F.array_join("events", ",").alias("events"), "status", "summary", "owner",
                     "rule", "event_id", "key")


def _tags_flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.array_join("tags", ",").alias("tags"))


# ---------------------------------------------------------------------------------------------------------------------
# P1 normalise

@register("normalize_logs", f"""WITH {_NORM_SQL}
SELECT id, timestamp, source, message, 'log_receiver' AS received_by, 'true' AS normalized,
       json_extract_string(props, '$.k') AS meta_k, CAST(user_id AS VARCHAR) AS meta_ip FROM norm""")
def q_normalize_logs(spark, sf_dir):
    n = normalize_logs(log_view(spark, sf_dir))
    return n.select("id", "timestamp", "source", "message",
                    F.col("metadata")["received_by"].alias("received_by"),
                    F.col("metadata")["normalized"].alias("normalized"),
                    F.col("metadata")["k"].alias("meta_k"),
                    F.col("metadata")["ip"].alias("meta_ip"))


# ---------------------------------------------------------------------------------------------------------------------
# F1 / J1 / P7 tagging

@register("tag_logs", f"""WITH {_TAGGED_SQL}
SELECT id, source, message, array_to_string(tags, ',') AS tags FROM tagged""")
def q_tag_logs(spark, sf_dir):
    return _tags_flat(tag_logs(normalize_logs(log_view(spark, sf_dir))), "id", "source", "message")


def messy_rules(spark: SparkSession) -> DataFrame:
    """A rules table as an operator would keep it: mixed text / list keywords, blanks, a repeated tag, an empty tag,
    a rule with only blank keywords. The driver ships no rules table, so this configuration is inline."""
    rows = [
        (1, " Critical ", "request failed, ,FAILED ", None),
        (2, "error", None, ["ERROR", "Exception"]),
        (3, "", "anything", None),
        (4, "WARNING", None, [" ", ""]),
        (5, "checkout", " , ", None),
        (6, "critical", "slow checkout", None),
        (7, "Info", None, ["INFO", "new "]),
    ]
    return spark.createDataFrame(rows, "rule_order INT, tag STRING, keywords_text STRING, keywords ARRAY<STRING>")


_MESSY_TAGS_SQL = """list_filter([
    CASE WHEN contains(lower(message), 'slow checkout') THEN 'critical' END,
    CASE WHEN contains(lower(message), 'error') OR contains(lower(message), 'exception') THEN 'error' END,
    CASE WHEN contains(lower(message), 'info') OR contains(lower(message), 'new ') THEN 'info' END],
    lambda x: x IS NOT NULL)"""


@register("tag_logs_rules_table", f"""WITH {_NORM_SQL}
SELECT id, message, array_to_string({_MESSY_TAGS_SQL}, ',') AS tags FROM norm""")
def q_tag_logs_rules_table(spark, sf_dir):
    tagged = tag_logs(normalize_logs(log_view(spark, sf_dir)), messy_rules(spark))
    return _tags_flat(tagged, "id", "message")


# Language-marker rules used to tag the text-heavy tables.
DOC_RULES = [("en", ["the", " and "]), ("es", ["que"]), ("de", ["und"]), ("fr", [" le ", " la "])]
_DOC_TAGS_SQL = """list_filter([
    CASE WHEN contains(lower(text), 'the') OR contains(lower(text), ' and ') THEN 'en' END,
    CASE WHEN contains(lower(text), 'que') THEN 'es' END,
    CASE WHEN contains(lower(text), 'und') THEN 'de' END,
    CASE WHEN contains(lower(text), ' le ') OR contains(lower(text), ' la ') THEN 'fr' END], lambda x: x IS NOT NULL)"""


@register("tag_documents", f"""SELECT doc_id, lang, array_to_string({_DOC_TAGS_SQL}, ',') AS tags FROM documents""")
def q_tag_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return _tags_flat(tag_logs(docs, DOC_RULES, text_col="text"), "doc_id", "lang")


@register("tag_conversations", f"""SELECT conv_id, turn, array_to_string({_DOC_TAGS_SQL}, ',') AS tags
FROM conversations""")
def q_tag_conversations(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return _tags_flat(tag_logs(conv, DOC_RULES, text_col="text"), "conv_id", "turn")


# ---------------------------------------------------------------------------------------------------------------------
# F2 / F3 / P5

@register("etl_filter", f"""WITH {_TAGGED_SQL}
SELECT id, array_to_string(tags, ',') AS tags FROM tagged WHERE list_has_any(tags, ['error', 'warning'])""")
def q_etl_filter(spark, sf_dir):
    tagged = tag_logs(normalize_logs(log_view(spark, sf_dir)))
    return _tags_flat(etl_filter(tagged), "id")


@register("model_match_events", f"""WITH {_TAGGED_SQL}
SELECT md5('event:' || id) AS id, timestamp, id AS log_id, 'log_event' AS type,
       CASE WHEN list_contains(tags, 'error') THEN 'high' ELSE 'medium' END AS severity,
       'Event from log: ' || message AS description
FROM tagged WHERE list_has_any(tags, ['error', 'warning']) AND list_has_any(tags, ['error', 'critical'])""")
def q_model_match_events(spark, sf_dir):
    tagged = tag_logs(normalize_logs(log_view(spark, sf_dir)))
    ev = create_events(model_match(etl_filter(tagged)))
    return ev.select("id", "timestamp", "log_id", "type", "severity", "description")


@register("error_etl", f"""WITH {_TAGGED_SQL}
SELECT md5('event:' || id) AS id, id AS log_id, 'high' AS severity, 'Event from log: ' || message AS description
FROM tagged WHERE list_contains(tags, 'error')""")
def q_error_etl(spark, sf_dir):
    ev = batch_jobs.error_etl(log_view(spark, sf_dir))
    return ev.select("id", "log_id", "severity", "description")


# ---------------------------------------------------------------------------------------------------------------------
# T2 / X0 / X0b

@register("incidents_instant_accumulated", _t2_sql(f"""{_TAGGED_SQL},
ev AS ({_EVENTS_OF} FROM tagged)""", "user_id", 3))
def q_incidents_instant_accumulated(spark, sf_dir):
    tagged = tag_logs(normalize_logs(log_view(spark, sf_dir)))
    events = create_events(tagged, carry=["user_id"])
    return _flat_incidents(instant_and_accumulated(events, key="user_id", threshold=3))


@register("logs_to_incidents", _t2_sql(f"""{_TAGGED_SQL},
ev AS ({_EVENTS_OF} FROM tagged)""", "log_id", 3))
def q_logs_to_incidents(spark, sf_dir):
    return _flat_incidents(batch_jobs.logs_to_incidents(log_view(spark, sf_dir)))


@register("incidents_shared_log_ids", f"""WITH {_NORM_SQL},
tagged AS (SELECT *, 'user-' || user_id || '-' || strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS log_id,
                  {_DEFAULT_TAGS_SQL} AS tags FROM norm),
ranked AS (SELECT *, md5('event:' || log_id) AS eid, list_contains(tags, 'error') AS high,
                  row_number() OVER (PARTITION BY log_id ORDER BY timestamp, event_id) AS rn FROM tagged)
SELECT md5('incident:' || CASE WHEN high THEN 'instant:' ELSE 'accumulated:' END || eid) AS id, timestamp, eid AS events,
       'open' AS status, CASE WHEN high THEN 'Instant incident from event: Event from log: ' || message
                              ELSE 'Accumulated incident from log ' || log_id END AS summary,
       CAST(NULL AS VARCHAR) AS owner, CASE WHEN high THEN 'instant' ELSE 'accumulated' END AS rule, eid AS event_id,
       log_id AS key
FROM ranked WHERE high OR rn >= 3""")
def q_incidents_shared_log_ids(spark, sf_dir):
    """T2 with the default key where the logs of a user and day share one log id (and so one event id)."""
    logs = normalize_logs(log_view(spark, sf_dir)).withColumn(
        "id", F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("timestamp", "yyyy-MM-dd")))
    events = create_events(tag_logs(logs), carry=["event_id"]).withColumnRenamed("event_id", "row_id")
    return _flat_incidents(instant_and_accumulated(events, order=("timestamp", "row_id")))


@register("filtered_incidents", _t2_sql(f"""{_TAGGED_SQL},
ev AS ({_EVENTS_OF} FROM tagged
       WHERE list_has_any(tags, ['error', 'warning']) AND list_has_any(tags, ['error', 'critical', 'warning']))""",
                                       "source", 3))
def q_filtered_incidents(spark, sf_dir):
    inc = batch_jobs.filtered_incidents(log_view(spark, sf_dir), event_tags=["error", "critical", "warning"],
                                      key="source", carry=["source"])
    return _flat_incidents(inc)


# ---------------------------------------------------------------------------------------------------------------------
# A1 / T1 error counts

from incidentry.operators.aggregates import running_error_counts, tumbling_error_counts  # noqa: E402


def _a1_sql(interval_sql: str) -> str:
    return f"""WITH {_NORM_SQL}
SELECT time_bucket({interval_sql}, timestamp) AS window_start,
       time_bucket({interval_sql}, timestamp) + {interval_sql} AS window_end,
       source, count(*) AS error_count
FROM norm WHERE contains(lower(message), 'error') GROUP BY ALL"""


@register("error_count_tumbling_5s", _a1_sql("INTERVAL 5 SECONDS"))
def q_error_count_tumbling_5s(spark, sf_dir):
    return tumbling_error_counts(normalize_logs(log_view(spark, sf_dir)), "5 seconds")


@register("error_count_tumbling_1d", _a1_sql("INTERVAL 1 DAY"))
def q_error_count_tumbling_1d(spark, sf_dir):
    return tumbling_error_counts(normalize_logs(log_view(spark, sf_dir)), "1 day")


@register("running_error_count", f"""WITH {_NORM_SQL}
SELECT id, timestamp, source,
       CAST(sum(CASE WHEN contains(lower(message), 'error') THEN 1 ELSE 0 END)
            OVER (PARTITION BY source ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS error_count
FROM norm""")
def q_running_error_count(spark, sf_dir):
    return running_error_counts(normalize_logs(log_view(spark, sf_dir))).select("id", "timestamp", "source",
                                                                                 "error_count")


# ---------------------------------------------------------------------------------------------------------------------
# T4 / J3 failed logins

from incidentry.operators.logins import login_attempt_counts  # noqa: E402
from incidentry.sources.driver_views import attempted_username, login_attempts_view, users_view  # noqa: E402

_ATTEMPTS_SQL = """attempts AS (SELECT CASE WHEN user_id % 25 = 0 THEN 'x' ELSE 'u' END || CAST(user_id AS VARCHAR) AS username, ts,
                         event_type = 'signup' AS password_ok,
                         event_id AS attempt_id FROM events WHERE event_type IN ('error', 'signup')),
users AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS username FROM events),
marked AS (SELECT a.*, u.username IS NOT NULL AS known FROM attempts a LEFT JOIN users u USING (username))"""


def _t4_sql(ttl_seconds: int) -> str:
    return f"""WITH {_ATTEMPTS_SQL},
k AS (SELECT *, lag(ts) OVER (PARTITION BY username ORDER BY ts, attempt_id) AS pts FROM marked WHERE known),
s AS (SELECT *, CASE WHEN password_ok OR (pts IS NOT NULL AND epoch_us(ts) - epoch_us(pts) >= CAST({ttl_seconds} AS BIGINT) * 1000000)
                     THEN 1 ELSE 0 END AS rst FROM k),
g AS (SELECT *, sum(rst) OVER (PARTITION BY username ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING) AS seg FROM s),
c AS (SELECT username, ts, attempt_id, password_ok, known,
             CASE WHEN password_ok THEN 0 ELSE CAST(sum(CASE WHEN password_ok THEN 0 ELSE 1 END)
                  OVER (PARTITION BY username, seg ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END
             AS attempts FROM g
      UNION ALL
      SELECT username, ts, attempt_id, password_ok, known, CAST(0 AS BIGINT) FROM marked WHERE NOT known)
SELECT username, ts, attempt_id, known AND password_ok AS success, attempts,
       CASE WHEN NOT known THEN 'Unknown username' WHEN password_ok THEN 'Login successful'
            ELSE 'Wrong password. Attempt #' || CAST(attempts AS VARCHAR) END AS message
FROM c"""


def _t4(spark, sf_dir, ttl):
    out = login_attempt_counts(login_attempts_view(spark, sf_dir), users_view(spark, sf_dir), ttl_seconds=ttl)
    return out.select("username", "ts", "attempt_id", "success", "attempts", "message")


@register("login_attempts_1h", _t4_sql(3600))
def q_login_attempts_1h(spark, sf_dir):
    return _t4(spark, sf_dir, 3600)


@register("login_attempts_2d", _t4_sql(172800))
def q_login_attempts_2d(spark, sf_dir):
    return _t4(spark, sf_dir, 172800)


# ---------------------------------------------------------------------------------------------------------------------
# T3 brute force (error events stand in for failed logins, user_id for the ip)

from incidentry.operators.bruteforce import brute_force_incidents  # noqa: E402


def failed_login_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return ev.select(F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("id"),
                     F.col("ts").alias("timestamp"), F.lit("login_failed").alias("type"),
                     F.create_map(F.lit("ip"), F.col("user_id").cast("string")).alias("metadata"))


def _t3_sql(window_seconds: int, threshold: int) -> str:
    return f"""WITH RECURSIVE s AS (
    SELECT CAST(user_id AS VARCHAR) AS key, ts, 'evt-' || CAST(event_id AS VARCHAR) AS id,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, 'evt-' || CAST(event_id AS VARCHAR)) AS rn
    FROM events WHERE event_type = 'error'),
r AS (SELECT key, rn, [{{'ts': ts, 'id': id}}] AS buf, CAST(NULL AS VARCHAR[]) AS fired, NULL::TIMESTAMP AS fts,
             NULL::VARCHAR AS fid
      FROM s WHERE rn = 1
      UNION ALL
      SELECT key, rn, CASE WHEN len(f) >= {threshold} THEN f[1:0] ELSE f END,
             CASE WHEN len(f) >= {threshold} THEN list_transform(f, lambda b: b.id) END, cts, cid
      FROM (SELECT s.key, s.rn, s.ts AS cts, s.id AS cid,
                   list_append(list_filter(r.buf, lambda b: b.ts > s.ts - INTERVAL {window_seconds} SECONDS),
                               {{'ts': s.ts, 'id': s.id}}) AS f
            FROM r JOIN s ON s.key = r.key AND s.rn = r.rn + 1))
SELECT md5('incident:brute_force:' || fid) AS id, fts AS timestamp, array_to_string(fired, ',') AS events,
       'open' AS status, 'Brute Force Attack: ' || CAST(len(fired) AS VARCHAR) || ' failed logins from ' || key AS summary,
       'auto-assigned' AS owner, 'brute_force' AS rule, fid AS event_id, key
FROM r WHERE fired IS NOT NULL"""


@register("incidents_brute_force", _t3_sql(86400, 3))
def q_incidents_brute_force(spark, sf_dir):
    inc, _ = brute_force_incidents(failed_login_events(spark, sf_dir), window_seconds=86400, threshold=3)
    return _flat_incidents(inc)


# ---------------------------------------------------------------------------------------------------------------------
# T5 latest per key, X9 / J4 / J5 / P11 / F7 products

from incidentry.operators import products as prod  # noqa: E402
from incidentry.operators.upsert import latest_per_key  # noqa: E402
from incidentry.sources.driver_views import price_updates_view, products_view  # noqa: E402


@register("latest_event_per_user", """SELECT user_id, event_id, ts, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_latest_event_per_user(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return latest_per_key(ev, "user_id", ["ts", "event_id"])


_PRODUCTS_SQL = """products AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
        CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(12,2)) AS price, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
    FROM part),
updates AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'x' ELSE 'p' END || CAST(l_partkey AS VARCHAR) AS id,
        CASE WHEN l_quantity >= 49 THEN -l_extendedprice ELSE l_extendedprice END AS price,
        l_shipdate AS ts, l_orderkey AS seq1, CAST(l_linenumber AS BIGINT) AS seq2 FROM lineitem),
valid AS (SELECT * FROM updates WHERE price >= 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq1 DESC, seq2 DESC) AS rn
                          FROM valid) WHERE rn = 1)"""


def _price_merge(spark, sf_dir):
    return prod.apply_price_updates(products_view(spark, sf_dir), price_updates_view(spark, sf_dir),
                                    order=["ts", "seq1", "seq2"])


@register("apply_price_updates", f"""WITH {_PRODUCTS_SQL}
SELECT p.id, p.name, CAST(COALESCE(CAST(CAST(l.price AS VARCHAR) AS DECIMAL(12,2)), p.price) AS DOUBLE) AS price,
       COALESCE(l.ts, p.updated_at) AS updated_at
FROM products p LEFT JOIN latest l USING (id)""")
def q_apply_price_updates(spark, sf_dir):
    # the table keeps DECIMAL(12,2); the report shows the price as a float, like the product API
    merged = _price_merge(spark, sf_dir)[0]
    return merged.withColumn("price", F.col("price").cast("double"))


@register("price_updates_rejected", f"""WITH {_PRODUCTS_SQL}
SELECT id, price, ts, seq1, seq2, 'negative price' AS reject_reason FROM updates WHERE price < 0
UNION ALL
SELECT id, price, ts, seq1, seq2, 'unknown id' FROM valid WHERE id NOT IN (SELECT id FROM products)""")
def q_price_updates_rejected(spark, sf_dir):
    return _price_merge(spark, sf_dir)[1]


@register("seed_products", f"""WITH {_PRODUCTS_SQL},
seed AS (SELECT * FROM (VALUES ('p1', 'Keyboard', CAST('49.99' AS DECIMAL(12,2))),
                               ('p2', 'Monitor', CAST('199.00' AS DECIMAL(12,2))),
                               ('p3', 'Mouse', CAST('24.50' AS DECIMAL(12,2)))) t(id, name, price))
SELECT id, name, CAST(price AS DOUBLE) AS price, updated_at FROM products
UNION ALL
SELECT id, name, CAST(price AS DOUBLE), TIMESTAMP '2024-01-02 00:00:00' FROM seed s
WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.id = s.id)""")
def q_seed_products(spark, sf_dir):
    as_of = F.lit("2024-01-02 00:00:00")
    return prod.seed_products(products_view(spark, sf_dir), prod.seed_rows(spark), as_of=as_of) \
        .select("id", "name", F.col("price").cast("double").alias("price"), "updated_at")


@register("list_products", f"""WITH {_PRODUCTS_SQL}
SELECT p.id, p.name, CAST(COALESCE(CAST(CAST(l.price AS VARCHAR) AS DECIMAL(12,2)), p.price) AS DOUBLE) AS price,
       CASE WHEN microsecond(COALESCE(l.ts, p.updated_at)) % 1000000 = 0
            THEN strftime(COALESCE(l.ts, p.updated_at), '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(COALESCE(l.ts, p.updated_at), '%Y-%m-%dT%H:%M:%S.%f') END AS updated_at
FROM products p LEFT JOIN latest l USING (id) ORDER BY p.id""")
def q_list_products(spark, sf_dir):
    return prod.list_products(_price_merge(spark, sf_dir)[0])


@register("get_product", f"""WITH {_PRODUCTS_SQL},
req AS (SELECT DISTINCT id FROM updates)
SELECT r.id, p.name, CAST(p.price AS DOUBLE) AS price,
       CASE WHEN p.id IS NULL THEN NULL ELSE strftime(p.updated_at, '%Y-%m-%dT%H:%M:%S') END AS updated_at,
       p.id IS NOT NULL AS found
FROM req r LEFT JOIN products p USING (id)""")
def q_get_product(spark, sf_dir):
    return prod.get_products(products_view(spark, sf_dir), price_updates_view(spark, sf_dir))


# ---------------------------------------------------------------------------------------------------------------------
# P2 / X6, P4 / J2, X1-X5, X8

from incidentry.operators.normalize import claim_check, validate_submissions  # noqa: E402
from incidentry.operators.events import resolve_claim_checks  # noqa: E402
from incidentry.plans import reports  # noqa: E402
from incidentry.sources.driver_views import submissions_view, submitted_message  # noqa: E402
from incidentry.sources.rules import DEFAULT_ETL_TAGS, DEFAULT_EVENT_TAGS  # noqa: E402


_SUBMISSIONS_SQL = f"""subs AS (SELECT id, timestamp, source,
                        CASE WHEN event_id % 50 = 0 THEN NULL ELSE message END AS message
                 FROM ({LOG_VIEW_SQL}))"""


@register("reject_invalid", f"""WITH {_SUBMISSIONS_SQL}
SELECT id, CASE WHEN source IS NULL THEN 'missing source' ELSE 'missing message' END
       AS reject_reason
FROM subs WHERE source IS NULL OR message IS NULL""")
def q_reject_invalid(spark, sf_dir):
    _, rejected = validate_submissions(submissions_view(spark, sf_dir))
    return rejected.select("id", "reject_reason")


@register("claim_check_resolve", f"""WITH {_TAGGED_SQL}
SELECT 'logs/' || id || '.json' AS s3_key, id AS log_id, message, array_to_string(tags, ',') AS tags
FROM tagged WHERE list_has_any(tags, ['error', 'warning'])""")
def q_claim_check_resolve(spark, sf_dir):
    tagged = tag_logs(normalize_logs(log_view(spark, sf_dir)))
    stored = tagged.withColumn("s3_key", F.concat(F.lit("logs/"), F.col("id"), F.lit(".json")))
    messages = claim_check(etl_filter(tagged))
    resolved, _ = resolve_claim_checks(messages, stored)
    return resolved.select("s3_key", F.col("id").alias("log_id"), "message", F.array_join("tags", ",").alias("tags"))


@register("fan_out_counts", f"""WITH {_TAGGED_SQL}
SELECT COALESCE(tags[1], 'untagged') AS route, count(*) AS n FROM tagged GROUP BY ALL""")
def q_fan_out_counts(spark, sf_dir):
    return reports.fan_out_counts(tag_logs(normalize_logs(log_view(spark, sf_dir))))


def conversation_logs(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"),
                                F.col("turn").cast("string")).alias("id"),
                       F.col("role").alias("source"), F.col("text").alias("message"), F.lit("chat").alias("feed"))


@register("fan_in", f"""WITH {_TAGGED_SQL},
conv AS (SELECT role AS source, text AS message FROM conversations),
conv_tagged AS (SELECT source, list_filter([
    CASE WHEN contains(lower(message), 'error') OR contains(lower(message), 'exception') THEN 'error' END,
    CASE WHEN contains(lower(message), 'warn') OR contains(lower(message), 'warning') THEN 'warning' END,
    CASE WHEN contains(lower(message), 'info') THEN 'info' END], lambda x: x IS NOT NULL) AS tags FROM conv)
SELECT feed, COALESCE(tags[1], 'untagged') AS route, count(*) AS n FROM (
    SELECT 'app' AS feed, tags FROM tagged UNION ALL SELECT 'chat', tags FROM conv_tagged) GROUP BY ALL""")
def q_fan_in(spark, sf_dir):
    app = log_view(spark, sf_dir).select("id", "timestamp", "source", "message").withColumn("feed", F.lit("app"))
    both = reports.fan_in(app, conversation_logs(spark, sf_dir))
    tagged = tag_logs(both)
    return tagged.groupBy("feed", reports.route_of(F.col("tags")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


# The 7 days before a fixed as-of time (a report parameter)
AS_OF = "2024-01-30 00:00:00"


@register("time_range_7d", _t2_sql(f"""{_TAGGED_SQL},
ev AS ({_EVENTS_OF} FROM tagged)""", "user_id", 3, since=AS_OF, days=7))
def q_time_range_7d(spark, sf_dir):
    tagged = tag_logs(normalize_logs(log_view(spark, sf_dir)))
    inc = instant_and_accumulated(create_events(tagged, carry=["user_id"]), key="user_id", threshold=3)
    return _flat_incidents(reports.time_range(inc, AS_OF, 7))


@register("latency_by_source", f"""WITH {_NORM_SQL},
lat AS (SELECT source, datediff('second', timestamp, timestamp + to_seconds(event_id % 7)) AS l FROM norm)
SELECT source, count(*) AS n, avg(l) AS avg_latency_s, max(l) AS max_latency_s,
       quantile_cont(l, 0.5) AS p50_latency_s, quantile_cont(l, 0.95) AS p95_latency_s FROM lat GROUP BY source""")
def q_latency_by_source(spark, sf_dir):
    logs = normalize_logs(submissions_view(spark, sf_dir))
    return reports.latency_by_source(logs, exact=True)


@register("stage_funnel", f"""WITH {_TAGGED_SQL}, {_SUBMISSIONS_SQL},
ev AS ({_EVENTS_OF} FROM tagged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) AS rn FROM ev)
SELECT 'received' AS stage, count(*) AS n FROM events
UNION ALL SELECT 'valid', count(*) FROM subs WHERE NOT (source IS NULL OR message IS NULL)
UNION ALL SELECT 'tagged', count(*) FROM tagged WHERE len(tags) > 0
UNION ALL SELECT 'passed', count(*) FROM tagged WHERE list_has_any(tags, ['error', 'warning'])
UNION ALL SELECT 'matched', count(*) FROM tagged
          WHERE list_has_any(tags, ['error', 'warning']) AND list_has_any(tags, ['error', 'critical'])
UNION ALL SELECT 'incidents', count(*) FROM ranked WHERE severity = 'high' OR rn >= 3""")
def q_stage_funnel(spark, sf_dir):
    """One scan: whether a row's submission was valid is marked before it is normalised and tagged."""
    logs = log_view(spark, sf_dir).withColumn("submitted", F.col("source").isNotNull() & submitted_message().isNotNull())
    tagged = tag_logs(normalize_logs(logs))
    passed, matched = tags_overlap(F.col("tags"), DEFAULT_ETL_TAGS), tags_overlap(F.col("tags"), DEFAULT_EVENT_TAGS)
    stages = {"received": F.lit(True), "valid": F.col("submitted"), "tagged": F.size("tags") > 0, "passed": passed,
              "matched": passed & matched}
    return reports.funnel_in_one_pass(tagged, stages, F.lit(True), F.array_contains("tags", "error"), "user_id",
                                      ["timestamp", "id"])


@register("open_incidents", f"""WITH {_TAGGED_SQL},
ev AS ({_EVENTS_OF} FROM tagged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) AS rn FROM ev)
SELECT CASE WHEN severity = 'high' THEN 'instant' ELSE 'accumulated' END AS rule,
       CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day,
       count(*) AS n
FROM ranked WHERE severity = 'high' OR rn >= 3 GROUP BY ALL""")
def q_open_incidents(spark, sf_dir):
    tagged = tag_logs(normalize_logs(log_view(spark, sf_dir)))
    inc = instant_and_accumulated(create_events(tagged, carry=["user_id"]), key="user_id", threshold=3)
    return reports.open_incidents(inc).withColumn("day", F.col("day").cast("string"))


# ---------------------------------------------------------------------------------------------------------------------
# Streaming (W1-W7): the events table replayed as a file stream

from incidentry.sources.driver_views import logs_from_events  # noqa: E402
from incidentry.streaming import jobs as sjobs  # noqa: E402
from incidentry.streaming.sources import events_stream  # noqa: E402


@register("stream_error_count_1d", _a1_sql("INTERVAL 1 DAY"))
def q_stream_error_count_1d(spark, sf_dir):
    logs = normalize_logs(logs_from_events(events_stream(spark, sf_dir)))
    counts = sjobs.stream_error_counts(logs, "1 day", "0 seconds")
    return sjobs.run_and_read(counts, "update", ["window_start", "source"]) \
        .select("window_start", "window_end", "source", "error_count")


@register("stream_filtered_incidents", _t2_sql(f"""{_TAGGED_SQL},
ev AS ({_EVENTS_OF} FROM tagged
       WHERE list_has_any(tags, ['error', 'warning']) AND list_has_any(tags, ['error', 'critical', 'warning']))""",
                                              "source", 3))
def q_stream_filtered_incidents(spark, sf_dir):
    ev = events_replay(spark, sf_dir)
    # the closing row counts as an error, so that it comes through the filters to the watermark
    raw = logs_from_events(ev.withColumn("event_type", F.coalesce("event_type", F.lit("error"))))
    inc = sjobs.stream_incident_chain(raw, event_tags=["error", "critical", "warning"], key="source", carry=["source"],
                                      reorder=REPLAY_DELAY)
    return _flat_incidents(sjobs.run_and_read(inc))


#: A replay's files may come in any order, so its streams wait for the closing row; and the test that lets it through.
REPLAY_DELAY = "36500 days"
CLOSING = "event_type IS NULL OR "


def events_replay(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """``events`` as a stream of several micro-batches."""
    return sjobs.replayed(read_table(spark, sf_dir, "events"), ["ts", "event_id"], files)


@register("stream_late_rows", """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS wave FROM events),
bar AS (SELECT max(ts) - INTERVAL 10 DAYS AS bar FROM e WHERE wave = 0)
SELECT event_id, wave = 1 AND ts < bar AS late,
       CASE WHEN wave = 1 AND ts < bar THEN 'late' END AS reject_reason FROM e, bar""")
def q_stream_late_rows(spark, sf_dir):
    """W3 / X6 on an out-of-order replay: every seventh event arrives in a second micro-batch; those more than ten days
    behind the newest of the first go to quarantine, the others on; together they are the input."""
    from incidentry.session import scratch_path
    from incidentry.streaming.late import route_late, split_late
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    path = scratch_path(spark, "late-replay")
    ev.where("event_id % 7 <> 0").coalesce(1).write.parquet(path)
    ev.where("event_id % 7 = 0").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", "1").parquet(path)
    on_time, late = split_late(sjobs.run_and_read(route_late(stream, "ts", 10 * 86400)))
    return late.select("event_id", F.lit(True).alias("late"), "reject_reason").unionByName(
        on_time.select("event_id", F.lit(False).alias("late"), F.lit(None).cast("string").alias("reject_reason")))


# ---------------------------------------------------------------------------------------------------------------------
# A2 events per key

from incidentry.operators.aggregates import events_per_key  # noqa: E402


@register("events_per_log_source", f"""WITH {_TAGGED_SQL}
SELECT source, count(*) AS n_events FROM tagged GROUP BY source""")
def q_events_per_log_source(spark, sf_dir):
    events = create_events(tag_logs(normalize_logs(log_view(spark, sf_dir))), carry=["source"])
    return events_per_key(events, "source")


@register("stream_running_error_count", ORACLES["running_error_count"])
def q_stream_running_error_count(spark, sf_dir):
    logs = normalize_logs(logs_from_events(events_replay(spark, sf_dir)))
    return sjobs.run_and_read(sjobs.stream_running_error_counts(logs, reorder=REPLAY_DELAY)) \
        .select("id", "timestamp", "source", "error_count")


@register("stream_brute_force", _t3_sql(86400, 3))
def q_stream_brute_force(spark, sf_dir):
    ev = events_replay(spark, sf_dir).where(CLOSING + "event_type = 'error'").select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("id"), F.col("ts").alias("timestamp"),
        F.lit("login_failed").alias("type"), F.create_map(F.lit("ip"), F.col("user_id").cast("string")).alias("metadata"))
    return _flat_incidents(sjobs.run_and_read(sjobs.stream_brute_force(ev, 86400, 3, reorder=REPLAY_DELAY)))


@register("stream_login_attempts_2d", f"""WITH base AS ({_t4_sql(172800)})
SELECT attempt_id, attempts FROM base WHERE message <> 'Unknown username'""")
def q_stream_login_attempts_2d(spark, sf_dir):
    ev = events_replay(spark, sf_dir).where(CLOSING + "event_type IN ('error', 'signup')")
    att = ev.select(attempted_username().alias("username"), "ts",
                    (F.col("event_type") == "signup").alias("password_ok"), F.col("event_id").alias("attempt_id"))
    return sjobs.run_and_read(sjobs.stream_login_counts(att, users_view(spark, sf_dir), 172800, reorder=REPLAY_DELAY))


@register("tag_pages", """SELECT page_id, array_to_string(list_filter([
    CASE WHEN contains(lower(html), 'error') OR contains(lower(html), 'exception') THEN 'error' END,
    CASE WHEN contains(lower(html), 'warn') OR contains(lower(html), 'warning') THEN 'warning' END,
    CASE WHEN contains(lower(html), 'info') THEN 'info' END,
    CASE WHEN contains(lower(html), '<script') THEN 'script' END,
    CASE WHEN contains(lower(html), '<form') OR contains(lower(html), 'password') THEN 'login_form' END],
    lambda x: x IS NOT NULL), ',') AS tags FROM pages""")
def q_tag_pages(spark, sf_dir):
    from incidentry.sources.rules import DEFAULT_TAG_RULES
    rules = DEFAULT_TAG_RULES + PAGE_RULES
    return _tags_flat(tag_logs(read_table(spark, sf_dir, "pages"), rules, text_col="html"), "page_id")


# Extra markers used on raw web pages, after the default log rules.
PAGE_RULES = [("script", ["<script"]), ("login_form", ["<form", "password"])]


@register("claim_check_messages", f"""WITH {_TAGGED_SQL}
SELECT 'logs/' || id || '.json' AS s3_key, id AS log_id,
       CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
       array_to_string(tags, ',') AS tags
FROM tagged""")
def q_claim_check_messages(spark, sf_dir):
    msgs = claim_check(tag_logs(normalize_logs(log_view(spark, sf_dir))))
    return msgs.withColumn("tags", F.array_join("tags", ","))
