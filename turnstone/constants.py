"""Vocabularies and settings that decide results."""

# Statuses, event names and presence settings.
AUTHORIZED = "AUTHORIZED"
BLACKLISTED = "BLACKLISTED"
UNKNOWN = "UNKNOWN"
DENIED = "DENIED"
NO_PLATE = "NO_PLATE"
RESTRICTED = (UNKNOWN, BLACKLISTED)

DAY_START_MINUTES = 9 * 60
LATE_MINUTES = 15
DEDUP_MINUTES = 5
LATE_CUTOFF_MINUTES = DAY_START_MINUTES + LATE_MINUTES
SUSPICIOUS = "Suspicious vehicle"

ANOMALY_KINDS = (
    "entry_without_exit",
    "incoherent",
    "duplicates",
    "unknown_plates",
    "blacklisted",
    "orphan_exit",
)

# Document types and acceptance limits.
DOC_TYPES = ("invoice", "bank_statement", "payment_receipt", "wire_transfer")
UNKNOWN_TYPE = "unknown"
MIN_CONFIDENCE = 0.55
MIN_SCORE = 2.2

# Other thresholds.
FUZZY_THRESHOLD = 85.0
ASSET_LINK_SECONDS = 900
MIN_TOKEN_CONF = 35
