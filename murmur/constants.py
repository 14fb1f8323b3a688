"""Parameters and fixed values.

Values in the FIXED VALUES blocks must equal the behaviour being reproduced
(thresholds, word lists, formats, column synonyms); they are written out
plainly, in their natural order.  Everything else is a default that callers
may override through function parameters.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: dimensions
# ---------------------------------------------------------------------------
# Dimension name -> complaint column, in processing order.
DIMENSIONS = {
    "Type": "sr_type",
    "Region": "region",
    "Exchange": "exc_id",
    "City": "city",
    "RCA": "rca",
}
TOTAL = "Total"
# Resolution / ageing dimensions (Total is added as dimension_key 'All').
RESOLUTION_DIMENSIONS = {
    "Region": "region",
    "City": "city",
    "Exchange": "exc_id",
}
# Drill-down hierarchy below Total.
HIERARCHY = ["region", "exc_id", "city"]

# ---------------------------------------------------------------------------
# FIXED VALUES: thresholds and windows
# ---------------------------------------------------------------------------
BASELINE_WINDOWS = (7, 14, 30)
TREND_WINDOWS = (7, 14, 30)
Z_EPSILON = 0.001
Z_WARNING = 2.0
Z_CRITICAL = 3.0
TREND_P_THRESHOLD = 0.05
TREND_MIN_DAYS = 3
VARIATION_THRESHOLD = 15.0
CORRELATION_MIN = 0.7
CORRELATION_HISTORY_DAYS = 30
CORRELATION_MIN_DAYS = 3
CORRELATION_TOP = 5
WIDESPREAD_REGION_ANOMALIES = 3
ROOT_CAUSES_KEPT = 3
SURGE_ALARMING = 20.0
SURGE_CRITICAL = 50.0
SURGE_INFINITE = 999.9
SURGE_MIN_VOLUME = {"Region": 15, "Exchange": 10, "City": 5}
REPEAT_HISTORY_DAYS = 30
REPEAT_ALARMING = 3
REPEAT_CRITICAL = 6
REPEAT_VERY_ALARMING = 10
REPEAT_TOP = 100
MTTR_MIN_SECONDS = 300
TREND_PLOT_DAYS = 30

# Age slabs: (label, lower bound in hours, strict >), checked in this order.
AGE_SLABS = [
    ("> 60 Days", 60 * 24),
    ("> 30 Days", 30 * 24),
    ("> 10 Days", 10 * 24),
    ("> 6 Days", 6 * 24),
    ("> 72 Hours", 72),
    ("> 48 Hours", 48),
    ("> 24 Hours", 24),
]
WITHIN_24_HOURS = "Within 24 Hours"
# Presentation order of the slabs (slab_rank).
SLAB_ORDER = ["> 24 Hours", "> 48 Hours", "> 72 Hours", "> 6 Days",
              "> 10 Days", "> 30 Days", "> 60 Days"]

SEVERITIES = ["INFO", "WARNING", "CRITICAL"]
TREND_DIRECTIONS = ["UP", "DOWN", "STABLE"]
VARIATION_TYPES = ["DOD", "WOW", "MOM"]

# ---------------------------------------------------------------------------
# FIXED VALUES: ingestion
# ---------------------------------------------------------------------------
CSV_ENCODINGS = ["utf-8", "utf-8-sig", "latin1", "cp1252", "utf-16"]
ALTERNATE_SEPARATORS = [";", "\t", "|"]

# target column -> synonyms, both in the order they are tried.
COLUMN_SYNONYMS = {
    "sr_row_id": ["id", "row_id", "record_id", "row", "sr_id", "sr_row", "rowid"],
    "sr_open_dttm": ["date", "time", "open_date", "opened", "timestamp",
                     "created_at", "open_dttm", "occurrence_time"],
    "sr_type": ["type", "complaint_type", "category", "sr_type", "order_type"],
    "region": ["location", "zone", "area", "region_name"],
    "exc_id": ["exchange", "exc", "exchange_id", "excid"],
}

# Columns added as null when absent.
EXPECTED_OPTIONAL_COLUMNS = [
    "rca", "desc_text", "sr_sub_type", "sr_sub_status",
    "city", "cabinet_id", "dp_id", "switch_id",
    "mdn", "region_id", "product", "sub_product", "cust_seg", "sr_duration",
    "sr_number", "product_id",
]
REQUIRED_COLUMNS = ["sr_number", "sr_open_dttm", "sr_type", "region", "exc_id"]

# Date-time formats (Spark pattern syntax) in the order they are tried.
DATETIME_FORMATS = [
    "d-M-yyyy H:mm:ss",
    "d-M-yyyy H:mm",
    "d/M/yyyy H:mm",
    "M/d/yyyy H:mm",
    "d-M-yy H:mm:ss",
    "d-M-yy H:mm",
    "d-MMM-yy H:mm:ss",
    "d-MMM-yy H:mm",
    "yyyy-M-d H:mm:ss",
    "M/d/yyyy H:mm:ss",
    "d/M/yyyy H:mm:ss",
    "yyyy/M/d H:mm:ss",
    "M/d/yy H:mm:ss",
    "d/M/yy H:mm:ss",
    "yyyy-M-d'T'H:mm:ss",
    "d-MMM-yyyy H:mm:ss",
    "M/d/yyyy h:mm:ss a",
    "d/M/yyyy h:mm:ss a",
    "yyyy-M-d h:mm:ss a",
]
DATE_FORMATS = ["d-M-yyyy", "d-M-yy", "d-MMM-yy", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy"]

# Complaint table columns (natural key first).
COMPLAINT_COLUMNS = [
    "sr_number", "sr_row_id", "mdn", "region_id", "sr_open_dt", "sr_open_dttm",
    "sr_close_dttm", "sr_duration", "sr_type", "sr_sub_type", "sr_status",
    "sr_sub_status", "rca", "desc_text", "fault_type", "department", "region",
    "city", "exc_id", "cabinet_id", "dp_id", "switch_id", "product",
    "sub_product", "product_id", "cust_seg", "service_type", "priority",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: text analysis word lists
# ---------------------------------------------------------------------------
CATEGORY_TERMS = {
    "Product Quality": ["defect", "broken", "damaged", "poor quality", "faulty",
                        "not working", "stopped working", "malfunctioning"],
    "Customer Service": ["rude", "unprofessional", "unhelpful", "customer service",
                         "support", "representative", "staff", "employee"],
    "Delivery Issues": ["delivery", "shipping", "arrived late", "never arrived",
                        "lost package", "wrong address", "delayed"],
    "Billing/Payment": ["charged", "payment", "billing", "refund", "overcharged",
                        "wrong amount", "invoice", "credit card"],
    "Technical Issues": ["technical", "bug", "error", "crash", "not loading",
                         "glitch", "software", "app", "website"],
    "Refund/Return": ["refund", "return", "money back", "exchange", "replace"],
    "Account Management": ["account", "login", "password", "access", "locked out",
                           "username", "registration"],
}
OTHER_CATEGORY = "Other"
URGENT_TERMS = ["urgent", "immediately", "asap", "emergency", "critical",
                "serious", "dangerous", "unsafe", "lawyer", "legal"]
NEGATIVE_TERMS = ["bad", "terrible", "awful", "poor", "worst", "hate",
                  "disappointed", "frustrated", "angry", "horrible"]
POSITIVE_TERMS = ["good", "great", "excellent", "love", "best", "happy",
                  "satisfied", "pleased", "wonderful"]
KEYWORD_STOP_WORDS = ["the", "is", "at", "which", "on", "a", "an", "and", "or",
                      "but", "in", "with", "to", "for", "of", "as", "by", "this",
                      "that", "it", "from", "are", "was", "were", "been", "be",
                      "have", "has", "had", "do", "does", "did", "will", "would",
                      "could", "should", "my", "your", "their", "our"]
KEYWORD_MIN_LENGTH = 4   # words of length <= 3 are dropped
KEYWORDS_KEPT = 5
PRIORITY_LEVELS = ["low", "medium", "high", "critical"]
SENTIMENT_SCORE = 0.5
POLARITY_POSITIVE = 0.1
POLARITY_NEGATIVE = -0.1
PRIORITY_CRITICAL_SCORE = -0.6
PRIORITY_HIGH_SCORE = -0.5
PRIORITY_MEDIUM_SCORE = -0.2
TOP_CATEGORIES = 10

# Key topics of a report on a text without keywords.
NO_KEYWORDS = "None identified"
