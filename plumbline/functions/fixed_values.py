"""Word lists, codes, patterns and rule tables the checks are defined by."""

# Text that stands for a missing value (compared after lower + trim).
PLACEHOLDERS = (
    "", "-", "--", "---", "n/a", "na", "none", "null", "nil",
    "unknown", "not available", "missing", "undefined", "not applicable",
    "tbd", "tba", "n.a.", "n.a", "#n/a", "#null!", "#value!", "#ref!",
    "#div/0!", "error", "nan", "inf", "-inf", "0000-00-00", "1900-01-01",
    "9999-12-31", "00", "000", "0000", "?", "??", "???", "!",
    "temp", "test", "dummy", "placeholder", "na.", "na,", "not set",
    "unknown unknown", "n.d.", "nd", "not known",
)

# Numbers that stand for a missing value.
SENTINELS = (
    -999, -9999, -99999, -999999, -9999999,
    999, 9999, 99999, 999999, 9999999,
    -1, -99, -100, -1000,
    0,
    1111, 1234, 12345, 123456, 1234567,
    9876, 98765, 9876543,
    11111, 22222, 33333, 44444, 55555, 66666, 77777, 88888,
)

# Families of boolean spellings.
BOOLEAN_FAMILIES = {
    "true_false": ("true", "false"),
    "yes_no": ("yes", "no"),
    "y_n": ("y", "n"),
    "1_0": ("1", "0"),
    "on_off": ("on", "off"),
    "active_inactive": ("active", "inactive"),
    "enabled_disabled": ("enabled", "disabled"),
}
TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "on", "off")

# Column pairs whose second date must not precede the first.
DATE_RANGE_PAIRS = (
    ("start_date", "end_date"),
    ("start_dt", "end_dt"),
    ("valid_from", "valid_to"),
    ("from_date", "to_date"),
    ("begin_date", "end_date"),
    ("effective_date", "expiry_date"),
    ("effective_from", "effective_to"),
    ("period_start", "period_end"),
    ("open_date", "close_date"),
    ("order_date", "ship_date"),
    ("order_date", "delivery_date"),
    ("ship_date", "delivery_date"),
    ("created_at", "updated_at"),
    ("birth_date", "death_date"),
)

# Default functional dependencies (determinant, dependent).
FUNCTIONAL_DEPENDENCIES = (
    ("zip", "city"),
    ("zip", "state"),
    ("postal_code", "city"),
    ("postal_code", "state"),
    ("country_code", "country"),
    ("store_id", "store_name"),
    ("product_id", "product_name"),
    ("customer_id", "customer_name"),
)

# Words in column names.
PHONE_NAME_HINTS = (
    "phone", "mobile", "contact", "tel", "cell", "fax",
    "whatsapp", "landline", "ph_no", "phno", "phone_no",
    "telephone", "phn", "mob", "cellphone", "handphone",
)
BUSINESS_DATE_WORDS = ("order", "payment", "ship", "invoice", "transaction", "purchase", "billing", "sale")
LABEL_WORDS = ("name", "title", "label", "desc", "comment", "remark", "status", "type")
TOKEN_WORDS = ("name", "title", "desc", "comment", "address", "label")
PERCENT_WORDS = ("percent", "pct", "rate", "ratio", "share", "proportion")
HIERARCHY_WORDS = ("parent", "manager", "prev", "next", "reports", "sub", "master", "hierarchy")
SENSITIVE_WORDS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "ssn", "pan",
    "credit", "card", "email", "phone", "mobile", "address",
)

# Patterns. They avoid \s, \w and \b so that every regex engine reads them alike.
EMAIL = r"^[^@ \t\r\n]+@[^@ \t\r\n]*\.[^@ \t\r\n]+$"
PHONE = r"^[+()\-. \t\r\n0-9]{7,}$"
UUID_V1_TO_V5 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
UUID_ANY = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
URL = r"^(https?://|ftp://|www\.)[^ \t\r\n/$.?#][^ \t\r\n]*$"
URL_START = r"^https?://"
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
ISO_DATE_START = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
US_DATE_START = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
EU_DATE_START = r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}"
TIME_ZONE_MARK = r"[+-][0-9]{2}:[0-9]{2}$|Z$|(^|[^A-Za-z0-9_])(UTC|GMT|EST|CST|MST|PST|EDT|CDT|MDT|PDT)([^A-Za-z0-9_]|$)"
HTML_TAG = r"<[a-zA-Z][^>]*>|</[a-zA-Z]+>"
PUNCTUATION_ONLY = r"^[^\p{L}\p{N}]+$"
OUTER_SPACE = r"^[ \t\r\n]+|[ \t\r\n]+$"
INNER_SPACES = r"  +"
NON_ASCII = r"[^\x00-\x7F]"
CONTROL_CHARACTER = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DIGITS = r"^[0-9]+$"
LEADING_ZERO = r"^0[0-9]+$"
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
ZIP = r"^[0-9]{5}(-[0-9]{4})?$"
E164 = r"^\+[1-9][0-9]{6,14}$"
JSON_SHAPE = r"^[ \t\r\n]*[\[{].*[\]}][ \t\r\n]*$"

# Date-format census, four named shapes then everything else.
DATE_SHAPES = {
    "YYYY-MM-DD": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "MM/DD/YYYY": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "DD-MM-YYYY": r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
    "YYYY/MM/DD": r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
}
# The six-pattern variant of the census.
DATE_VARIANTS = {
    "DD/MM/YYYY": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    "YYYY-MM-DD": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "MM-DD-YYYY": r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
    "YYYY/MM/DD": r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
    "Mon D YYYY": r"^[A-Za-z]+ [0-9]{1,2} [0-9]{4}$",
    "DD-Mon-YYYY": r"^[0-9]{2}-[A-Za-z]+-[0-9]{4}$",
}

# Issue types a deterministic transform repairs, and those nothing can repair.
FIXABLE = (
    "whitespace", "empty_string_values", "case_inconsistency", "mixed_scalar_types",
    "integer_stored_as_float", "control_characters_in_text", "nested_structure",
    "internal_whitespace", "non_ascii_characters", "html_tags_in_text",
    "boolean_inconsistency", "all_caps_values", "duplicate_insensitive_values",
    "id_type_drift_across_datasets",
)
NOT_FIXABLE = (
    "invalid_email", "duplicate_primary_key", "orphan_foreign_key_rows", "orphan_foreign_key",
    "invalid_uuid", "impossible_date", "high_null_ratio_in_key_column",
)

# The action suggested for each issue type.
ISSUE_ACTIONS = {
    "whitespace": "trim",
    "nulls": "fill_or_drop",
    "invalid_date_format": "parse_dates",
    "invalid_email": "sanitize_email",
    "invalid_phone": "normalize_phone",
    "invalid_numeric": "coerce_numeric",
    "negative_values": "clip_or_flag",
    "suspicious_zero": "zero_to_null",
    "mixed_types": "coerce_numeric",
    "nested_structure": "flatten_nested",
    "duplicate_rows": "deduplicate",
    "duplicate_primary_key": "deduplicate_or_alert",
    "custom_one_of": "replace_values",
    "custom_range": "range_clip",
    "custom_regex": "regex_replace",
    "custom_not_null": "fill_or_drop",
    "potential_primary_key": "review_manually",
    "numeric_outliers_iqr": "clip_or_flag",
    "extremely_long_strings": "regex_replace",
    "control_characters_in_text": "regex_replace",
    "empty_string_values": "fill_or_drop",
    "date_range_violation": "review_manually",
    "future_dates": "review_manually",
    "ancient_dates": "parse_dates",
    "constant_column": "review_manually",
    "dominant_value_skew": "review_manually",
    "skewed_distribution": "review_manually",
    "integer_stored_as_float": "cast_type",
    "empty_dataset": "review_manually",
    "duplicate_column_names": "review_manually",
    "case_insensitive_column_collision": "review_manually",
    "case_inconsistency": "lowercase",
    "punctuation_only_value": "zero_to_null",
    "very_wide_table": "review_manually",
    "column_name_whitespace": "review_manually",
    "very_high_cardinality": "review_manually",
    "binary_like_column": "standardize_boolean",
    "very_wide_date_span": "review_manually",
    "duplicate_insensitive_values": "lowercase",
}
