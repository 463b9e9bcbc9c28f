"""Fixed values.

Every value here must equal the application's own for results to match; they are kept together, in the order the
application applies them, and imported where used.
"""

# Keyword tag rules (tag → keywords), in rule order.
DEFAULT_TAG_RULES: list[tuple[str, list[str]]] = [
    ("error", ["ERROR", "Exception"]),
    ("warning", ["WARN", "WARNING"]),
    ("info", ["INFO"]),
]
# Tags the ETL filter lets through, and tags the model matcher turns into events.
DEFAULT_ETL_TAGS: list[str] = ["error", "warning"]
DEFAULT_EVENT_TAGS: list[str] = ["error", "critical"]

# Receive-side normalisation.
UNKNOWN_SOURCE = "unknown"
RECEIVER_METADATA = {"received_by": "log_receiver", "normalized": "true"}
CLAIM_CHECK_PREFIX = "logs/"
CLAIM_CHECK_SUFFIX = ".json"

# Events.
EVENT_TYPE = "log_event"
DESCRIPTION_PREFIX = "Event from log: "
SEVERITY_HIGH = "high"
SEVERITY_MEDIUM = "medium"
ERROR_TAG = "error"

# Incidents.
STATUS_OPEN = "open"
INSTANT_PREFIX = "Instant incident from event: "
ACCUMULATED_PREFIX = "Accumulated incident from log "
ACCUMULATION_THRESHOLD = 3

# Brute-force rule.
FAILED_LOGIN_TYPE = "login_failed"
BRUTE_FORCE_WINDOW_SECONDS = 60
BRUTE_FORCE_THRESHOLD = 10
BRUTE_FORCE_SUMMARY_PREFIX = "Brute Force Attack: "
BRUTE_FORCE_SUMMARY_MIDDLE = " failed logins from "
BRUTE_FORCE_OWNER = "auto-assigned"

# Error counting jobs.
ERROR_WORD = "error"
TUMBLING_WINDOW = "5 seconds"

# Failed-login counter and login answers.
LOGIN_TTL_SECONDS = 3600
UNKNOWN_USER = "Unknown username"
LOGIN_OK = "Login successful"
WRONG_PASSWORD = "Wrong password. Attempt #"

# Product table seed rows and price type.
SEED_PRODUCTS = [("p1", "Keyboard", "49.99"), ("p2", "Monitor", "199.00"), ("p3", "Mouse", "24.50")]
PRICE_TYPE = "decimal(12,2)"
