"""Fixed values that must equal the reference's behaviour.

FIXED VALUES — literal lists and thresholds taken as-is; keep them in this order.
"""

# Two-valued sets recognised as boolean (compared as exact sets of trimmed strings).
BOOLEAN_PAIRS = [
    ("True", "False"), ("true", "false"), ("TRUE", "FALSE"),
    ("Yes", "No"), ("yes", "no"), ("YES", "NO"),
    ("Y", "N"), ("y", "n"),
    ("1", "0"),
    ("Male", "Female"), ("M", "F"),
    ("Active", "Inactive"),
]

# Null-like strings counted by the categorical profile (compared lower-cased).
NULL_LIKE_PROFILE = ["null", "none", "na", "n/a", "unknown", "missing", ""]

# Null-like strings counted by the format checks (compared lower-cased, trimmed).
NULL_LIKE_FORMAT = ["null", "none", "na", "n/a", "nan", "nil", "undefined", ""]

# Placeholder numbers that flag suspicious values.
PLACEHOLDER_VALUES = [-999, -99, 999999, -1]

# Column-name parts that suggest personal data.
PII_NAME_PARTS = [
    "name", "email", "phone", "address", "ssn", "social", "id", "user", "customer",
    "account", "person", "individual", "contact", "zip", "postal", "credit", "card",
    "license", "passport", "birth", "age",
]

# Column-name parts that suggest an identifier.
ID_NAME_PARTS = ["id", "key", "index", "uuid"]

# Column-name parts that suggest a prediction target ('y' matches any name containing it).
TARGET_NAME_PARTS = ["target", "label", "class", "y", "outcome"]

# Range rules keyed by column-name token.
AGE_TOKENS = ["age"]
NON_NEGATIVE_TOKENS = ["price", "cost", "amount", "salary", "income", "revenue"]
PERCENT_TOKENS = ["percent", "rate", "ratio"]

# Characters considered usual in text; anything else counts as unusual.
UNUSUAL_CHAR_PATTERN = r"(?U)[^\w\s\-\.\,\(\)\[\]]"
ESCAPED_UNICODE_PATTERN = r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"

# Characters removed at both ends before a value is called padded.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# CSV probing order.
CSV_ENCODINGS = ["utf-8", "latin1", "iso-8859-1"]
CSV_DELIMITERS = [",", ";", "\t"]

# Timestamp formats tried when a string column is tested for dates.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd",
    "MM/dd/yyyy", "dd-MM-yyyy", "MM/dd/yyyy HH:mm", "dd.MM.yyyy",
]

# Ladders of labels (first threshold reached wins).
CORR_STRENGTH = [(0.9, "very_strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")]
ASSOC_STRENGTH = [(0.5, "very_strong"), (0.3, "strong"), (0.15, "moderate"), (0.05, "weak")]
EFFECT_SIZE = [(0.14, "large"), (0.06, "medium"), (0.01, "small")]
HEALTH_GRADES = [(90, "A - Excellent"), (80, "B - Good"), (70, "C - Fair"), (60, "D - Poor")]
HEALTH_GRADE_LOWEST = "F - Critical Issues"
SIZE_FACTORS = [(10000, 1.0), (1000, 0.8), (100, 0.5)]
SIZE_FACTOR_LOWEST = 0.2
WIDTH_FACTORS = [(20, 1.0), (10, 0.8), (5, 0.6)]
WIDTH_FACTOR_LOWEST = 0.4
PRIORITY_BANDS = [(0.8, "very_high"), (0.6, "high"), (0.4, "medium")]
PRIORITY_BAND_LOWEST = "low"

# Thresholds used by several operators.
IQR_FACTOR = 1.5
ZSCORE_LIMIT = 3.0
MODIFIED_Z_LIMIT = 3.5
MODIFIED_Z_CONSTANT = 0.6745
