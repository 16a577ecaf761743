"""Fixed values.

Everything in this module is a value that has to equal the behaviour we
reproduce (token lists, field names, thresholds, header aliases, period
patterns, standards dictionary, output formats). They are stated plainly
and together so that the rest of the package only refers to them.
"""

from __future__ import annotations

# --- FIXED VALUES: blank-cell spellings (after trim + lower-case) -------------
BLANK_TOKENS = ("", "nan", "none", "null", "n/a", "na", "-")

# --- FIXED VALUES: canonical dimensions, in output order ----------------------
DIMS = ("Country", "Region", "Channel", "City/State", "Category", "Brand", "SKU", "Fact")
# dimensions that make a record Incomplete when blank
REQUIRED_DIMS = ("Country", "Channel", "Category", "Brand", "SKU", "Fact")
# classification targets (what a column may be mapped to)
TARGETS = ("Ignore",) + DIMS + ("Time Period",)

# snake_case output names for the dimensions (Spark- and SQL-friendly)
DIM_COLUMNS = {
    "Country": "country",
    "Region": "region",
    "Channel": "channel",
    "City/State": "city_state",
    "Category": "category",
    "Brand": "brand",
    "SKU": "sku",
    "Fact": "fact",
}

# --- FIXED VALUES: header aliases per dimension --------------------------------
ALIASES = {
    "Country": ["country", "market", "nation", "country name"],
    "Region": ["region", "zone", "territory", "sales zone", "sales territory"],
    "Channel": ["channel", "trade channel", "trade type", "sales channel", "dist channel"],
    "City/State": ["city", "state", "location", "ship to city", "destination city", "province"],
    "Category": ["category", "product group", "segment", "prod group"],
    "Brand": ["brand", "brand name", "brand desc"],
    "SKU": ["sku", "item code", "material", "product id", "item number", "product code"],
    "Fact": ["fact", "measure", "metric", "sales value", "units", "volume", "quantity"],
}

# --- FIXED VALUES: time-period header patterns (case-insensitive, anchored,
# applied to the normalised header) -------------------------------------------
TIME_PATTERNS = (
    r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[ _-]?\d{2,4}$",
    r"^\d{4}[ _-]?(0?[1-9]|1[0-2])$",
    r"^q[1-4][ _-]?\d{2,4}$",
    r"^\d{4}[ _-]?q[1-4]$",
    r"^(week|wk)[ _-]?\d+([ _-]?\d{2,4})?$",
    r"^\d{4}[ _-]?(week|wk)[ _-]?\d+$",
    r"^w\d{1,2}[ _-]?\d{2,4}$",
    r"^\d{4}$",
)

# --- FIXED VALUES: standards dictionary (lower-case alias -> canonical) -------
STANDARDS = {
    "country": {
        "india": "India",
        "ind": "India",
        "in": "India",
        "united states": "United States",
        "usa": "United States",
        "us": "United States",
        "united kingdom": "United Kingdom",
        "uk": "United Kingdom",
        "gb": "United Kingdom",
    },
    "channel": {
        "ecommerce": "E-commerce",
        "e-commerce": "E-commerce",
        "e commerce": "E-commerce",
        "online": "E-commerce",
        "modern": "Modern Trade",
        "modern trade": "Modern Trade",
        "supermarket": "Modern Trade",
        "hypermarket": "Modern Trade",
        "traditional": "Traditional Trade",
        "traditional trade": "Traditional Trade",
        "general trade": "Traditional Trade",
        "wholesale": "Wholesale",
        "cash and carry": "Wholesale",
    },
    "region": {
        "north": "North",
        "northern": "North",
        "south": "South",
        "southern": "South",
        "east": "East",
        "eastern": "East",
        "west": "West",
        "western": "West",
        "central": "Central",
    },
}

# --- FIXED VALUES: thresholds ---------------------------------------------------
NUMERIC_SHARE = 0.7          # profile: parsed share of all rows (>=)
OUTPUT_NUMERIC_SHARE = 0.7   # reconcile: output measure share (>, strict)
DATE_SHARE = 0.7             # profile: parsed share of the non-null values (>=)
DATE_NAME_HINTS = ("date", "period", "month", "week", "year")
DUP_KEY_HINTS = ("sku", "item", "product", "country", "date", "period", "channel")
DUP_KEY_MAX = 4
RATIO_MIN = 0.70             # similarity ratio kept only from here
SUBSET_SCORE = 0.95          # alias tokens are a subset of header tokens
IGNORE_BELOW = 0.45
RULE_FROM = 0.85
CONFIRM_FROM = 0.90
APPROVE_FROM = 90            # record confidence
HISTORY_FROM = 70
TOLERANCE = 0.01
DEFAULT_REC_CONFIDENCE = 0.85
SAMPLE_VALUES = 4

# --- FIXED VALUES: labels --------------------------------------------------------
TIME_FIELD = "Time Period"
IGNORE_FIELD = "Ignore"
METHOD_TIME = "Time rule"
METHOD_RULE = "Rule/Dictionary"
METHOD_CANDIDATE = "AI candidate"
METHOD_REVIEW = "AI review"
METHOD_MODEL = "Model recommendation"
SOURCE_RULES = "Rules and Standards"
SOURCE_HISTORY = "Rules and History"
SOURCE_MANUAL = "Unresolved / Manual"
STATUS_APPROVED = "Approved"
STATUS_REVIEW = "Needs Review"
STATUS_INCOMPLETE = "Incomplete"
STATUS_REJECTED = "Rejected"
STATUSES = (STATUS_APPROVED, STATUS_REVIEW, STATUS_INCOMPLETE, STATUS_REJECTED)
LOCKED_COLUMNS = ("record_id", "confidence", "recommendation_source")
SOURCE_COLUMN = "Source Sheet"
REDACTED_KEY = "[REDACTED_KEY]"
REDACTED_TOKEN = "[REDACTED_TOKEN]"

# --- FIXED VALUES: quality report texts (part of the report the user reads) ---
ISSUE_REQUIRED = "Required value missing"
ISSUE_REGION = "Region unavailable"
RECOMMEND_REGION = "Derive from City/State or review."
SEVERITY_ERROR = "Error"
SEVERITY_WARNING = "Warning"

# --- FIXED VALUES: date output formats (name -> Spark pattern) ------------------
DATE_OUTPUT_FORMATS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "Long date": "dd MMMM yyyy",
    "Month text": "MMM yyyy",
}
EXCEL_EPOCH = "1899-12-30"

# --- FIXED VALUES: workbook size gate ----------------------------------------------
EXCEL_ROWS = 1_048_576
EXCEL_COLS = 16_384

# delimiters a delimited-text scan may choose from, in preference order
DELIMITERS = (",", ";", "\t", "|")
HEADER_SCAN_ROWS = 20
HEADER_SAMPLE_ROWS = 25
