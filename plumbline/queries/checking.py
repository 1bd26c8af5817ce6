"""Queries of the validation family: one per issue type, over tables with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import checks, keys, profile
from plumbline.operators.checks import Settings
from plumbline.queries.profiling import parsed_sql
from plumbline.queries.registry import issue_sql, matches, query, quote, union_sql

SETTINGS = Settings(
    semantics={"active_flag": "boolean_like", "score_text": "numeric", "status": "categorical", "remark": "free_text"},
    as_of="2025-01-01 00:00:00",
)
PLACEHOLDERS = "(" + ", ".join(quote(p) for p in fv.PLACEHOLDERS) + ")"
SENTINELS = "(" + ", ".join(str(s) for s in fv.SENTINELS) + ")"
TEXT = ("full_name", "email", "phone", "account_uuid", "website_url", "signup_date", "active_flag", "status", "zip",
        "city", "score_text", "account_code", "remark", "attributes")
ALL = ("cust_id", "full_name", "email", "phone", "account_uuid", "website_url", "signup_date", "active_flag", "status",
       "zip", "city", "age", "interest_rate", "score_text", "account_code", "parent_cust_id", "amount", "remark", "attributes")


def trimmed(c):
    return f"regexp_replace({c}, {quote(fv.OUTER_SPACE)}, '', 'g')"


def contacts(issue, severity, bad, columns, checked=None, fires="n_bad > 0", label=None):
    return union_sql([
        issue_sql("contacts", c, label or issue, severity, bad.format(c=c, t=trimmed(c)),
                  (checked or "{c} IS NOT NULL").format(c=c, t=trimmed(c)), fires)
        for c in columns
    ])


def contact_check(issue, items, severity, bad, columns, **kw):
    name = {"nulls": "null_values", "placeholder_nulls": "placeholder_values"}.get(issue, issue)

    @query(f"check_{name}", items, contacts(issue, severity, bad, columns, **kw))
    def _(t):
        return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=[issue])


def re(column, pattern):
    return matches(column, pattern).replace("{", "{{").replace("}", "}}").replace("{{c}}", "{c}").replace("{{t}}", "{t}")


contact_check("nulls", "C1", "low", "{c} IS NULL", ALL, checked="TRUE")
contact_check("placeholder_nulls", "C2", "low", f"lower({{t}}) IN {PLACEHOLDERS}", TEXT, label="nulls")
contact_check("invalid_numeric", "C5", "medium", "TRY_CAST(trim({c}) AS DOUBLE) IS NULL AND {c} IS NOT NULL", ["score_text"])
contact_check("invalid_email", "C6", "medium", "NOT " + re("{c}", fv.EMAIL), ["email"])
contact_check("invalid_phone", "C7", "medium", "NOT " + re("{c}", fv.PHONE), ["phone"])
contact_check("invalid_uuid", "C8", "high", "NOT " + re("{c}", fv.UUID_V1_TO_V5), ["account_uuid"])
contact_check("invalid_url", "C9", "medium", "NOT " + re("lower({c})", fv.URL), ["website_url"])
contact_check("invalid_date_format", "C10", "medium",
              parsed_sql("trim(signup_date)").replace("{", "{{").replace("}", "}}") + " IS NULL", ["signup_date"])
contact_check("negative_values", "C11", "medium", "{c} < 0", ["age", "interest_rate", "amount"])
contact_check("sentinel_numeric_value", "C12", "medium", f"TRY_CAST({{c}} AS DOUBLE) IN {SENTINELS}",
              ["age", "interest_rate", "score_text", "amount"], checked="TRY_CAST({c} AS DOUBLE) IS NOT NULL")
contact_check("suspicious_zero", "C13", "medium", "CAST({c} AS VARCHAR) IN ('0', '0.0')",
              ["cust_id", "account_uuid", "account_code", "parent_cust_id"])
contact_check("whitespace", "C14", "low", re("{c}", fv.OUTER_SPACE) + " OR {t} = ''", TEXT)
contact_check("internal_whitespace", "C15", "low", "contains({c}, '  ')", TEXT)
contact_check("html_tags_in_text", "C16", "medium", re("{c}", fv.HTML_TAG), TEXT)
contact_check("punctuation_only_value", "C17", "medium", re("{c}", fv.PUNCTUATION_ONLY), TEXT)
contact_check("empty_string_values", "C58", "low", "{t} = ''", TEXT)
contact_check("extremely_long_strings", "C59", "low", "length({c}) > 4000", TEXT)
contact_check("leading_zeros_on_numeric_id", "C57", "low", re("{c}", fv.LEADING_ZERO), ["account_code"])
contact_check("impossible_date", "C63", "high",
              (matches("trim(signup_date)", fv.ISO_DATE_START + "|" + fv.US_DATE_START) + " AND "
               + parsed_sql("trim(signup_date)") + " IS NULL").replace("{", "{{").replace("}", "}}"), ["signup_date"])
contact_check("non_ascii_characters", "C39", "low", re("{c}", fv.NON_ASCII), TEXT,
              fires="n_bad > 0 AND n_checked >= 10 AND n_bad < 0.5 * n_checked")
contact_check("control_characters_in_text", "C40", "medium", re("{c}", fv.CONTROL_CHARACTER), TEXT,
              fires="n_bad > 0 AND n_checked >= 5")
contact_check("all_caps_values", "C24", "low", "{c} = upper({c}) AND " + re("{c}", r"\p{L}"),
              ["full_name", "status"], fires="n_bad > 0 AND n_checked > 5 AND n_bad < 0.9 * n_checked")
contact_check("string_with_only_digits_in_text_column", "C42", "medium", re("{t}", fv.DIGITS),
              ["full_name", "email", "website_url", "signup_date", "active_flag", "status", "city", "score_text", "remark", "attributes"],
              fires="n_checked >= 10 AND n_bad > 0.1 * n_checked AND n_bad < 0.9 * n_checked")
contact_check("repeated_token_in_string", "C43", "low",
              "array_length(regexp_split_to_array(lower({t}), '[ \\t\\r\\n]+')) >= 2 AND "
              "regexp_split_to_array(lower({t}), '[ \\t\\r\\n]+')[1] = regexp_split_to_array(lower({t}), '[ \\t\\r\\n]+')[2]",
              ["full_name"])
contact_check("implausible_age", "C44", "high", "{c} < 0 OR {c} > 150", ["age"])
contact_check("implausible_percentage", "C45", "medium", "{c} < 0 OR {c} > 100", ["interest_rate"])
contact_check("mixed_types", "C47", "medium", "TRY_CAST(trim({c}) AS DOUBLE) IS NOT NULL", TEXT,
              checked="{c} IS NOT NULL AND {t} <> ''", fires="n_bad > 0.2 * n_checked AND n_bad < 0.8 * n_checked")
contact_check("high_null_ratio_in_key_column", "C65", "high", "{c} IS NULL", ["cust_id", "parent_cust_id", "account_code"],
              checked="TRUE", fires="n_bad > 0.25 * n_checked")
contact_check("nested_structure", "C73", "medium", re("{c}", fv.JSON_SHAPE), TEXT, fires="n_bad = n_checked AND n_checked > 0")


@query("check_nested_columns", "C73", issue_sql("embeddings", "embedding", "nested_structure", "medium", "embedding IS NOT NULL"))
def _(t):
    return checks.run_row_checks(t["embeddings"], "embeddings", SETTINGS, only=["nested_structure"])


@query("check_mixed_date_formats", "C23", f"""
SELECT 'contacts' AS dataset, 'signup_date' AS column_name, 'mixed_date_formats' AS issue_type, 'medium' AS severity,
 CAST(i + u + e AS BIGINT) AS n_bad, n AS n_checked, round((i + u + e) / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT
  count(*) FILTER (WHERE {matches('signup_date', fv.ISO_DATE_START)}) AS i, count(*) FILTER (WHERE {matches('signup_date', fv.US_DATE_START)}) AS u,
  count(*) FILTER (WHERE {matches('signup_date', fv.EU_DATE_START)}) AS e, count(*) AS n FROM contacts WHERE trim(signup_date) <> '') x
WHERE n >= 10 AND CAST(i > 0 AS INT) + CAST(u > 0 AS INT) + CAST(e > 0 AS INT) >= 2""")
def _(t):
    return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=["mixed_date_formats"])


@query("check_timezone_inconsistency", "C38", f"""
SELECT 'contacts' AS dataset, 'signup_date' AS column_name, 'timezone_inconsistency' AS issue_type, 'medium' AS severity,
 least(z, n - z) AS n_bad, n AS n_checked, round(least(z, n - z) / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT
  count(*) FILTER (WHERE {matches('signup_date', fv.TIME_ZONE_MARK)}) AS z, count(signup_date) AS n FROM contacts) x
WHERE n >= 10 AND least(z, n - z) > 0.05 * n""")
def _(t):
    return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=["timezone_inconsistency"])


@query("check_ambiguous_boolean", "C26", """
SELECT 'contacts' AS dataset, 'active_flag' AS column_name, 'ambiguous_boolean' AS issue_type, 'medium' AS severity, n AS n_bad, n AS n_checked,
 CAST(1 AS DOUBLE) AS pct FROM (SELECT count(active_flag) AS n, count(DISTINCT CASE WHEN lower(trim(active_flag)) IN
 ('true','yes','y','1','t','false','no','n','0','f') THEN lower(trim(active_flag)) END) AS d FROM contacts) x WHERE n > 10 AND d >= 3""")
def _(t):
    return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=["ambiguous_boolean"])


@query("check_boolean_inconsistency", "C61", """
SELECT 'contacts' AS dataset, 'active_flag' AS column_name, 'boolean_inconsistency' AS issue_type, 'medium' AS severity, f AS n_bad, n AS n_checked,
 round(f / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT count(active_flag) AS n, count(fam) AS f, count(DISTINCT fam) AS d FROM (
  SELECT active_flag, CASE WHEN lower(trim(active_flag)) IN ('true','false') THEN 'tf' WHEN lower(trim(active_flag)) IN ('yes','no') THEN 'yn'
   WHEN lower(trim(active_flag)) IN ('y','n') THEN 'y' WHEN lower(trim(active_flag)) IN ('1','0') THEN '10' END AS fam FROM contacts) y) x WHERE d >= 2""")
def _(t):
    return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=["boolean_inconsistency"])


@query("check_mixed_phone_formats", "C62", f"""
SELECT 'contacts' AS dataset, 'phone' AS column_name, 'mixed_phone_formats' AS issue_type, 'low' AS severity, n - m AS n_bad, n AS n_checked,
 round((n - m) / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT CAST(sum(k) AS BIGINT) AS n, max(k) AS m, count(*) AS d FROM (
  SELECT count(*) AS k FROM contacts WHERE phone IS NOT NULL GROUP BY CASE WHEN {matches('phone', fv.E164)} THEN 1 WHEN {matches('phone', fv.PHONE)} THEN 2 ELSE 3 END) g) x WHERE d >= 2""")
def _(t):
    return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=["mixed_phone_formats"])


def _number(c):
    return f"(regexp_matches(trim({c}), '^[+-]?[0-9]+$') OR (TRY_CAST(trim({c}) AS DOUBLE) IS NOT NULL AND regexp_matches(trim({c}), '^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$')))"


def _other(c):
    return f"({_number(c)} OR lower(trim({c})) IN ('true','false') OR regexp_matches(trim({c}), '^\\[.*\\]$') OR regexp_matches(trim({c}), '^\\{{.*\\}}$'))"


@query("check_mixed_scalar_types", "C66", union_sql([f"""
SELECT 'contacts' AS dataset, '{c}' AS column_name, 'mixed_scalar_types' AS issue_type, 'medium' AS severity, least(s, m) AS n_bad, n AS n_checked,
 round(least(s, m) / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT count({c}) AS n, count(*) FILTER (WHERE {_number(c)}) AS m,
 count(*) FILTER (WHERE NOT {_other(c)}) AS s FROM contacts) x WHERE s >= 0.1 * n AND m >= 0.1 * n""" for c in TEXT]))
def _(t):
    return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=["mixed_scalar_types"])


@query("check_name_format_inconsistency", "C67", f"""
SELECT 'contacts' AS dataset, 'full_name' AS column_name, 'name_format_inconsistency' AS issue_type, 'low' AS severity, s - m AS n_bad, n AS n_checked,
 round((s - m) / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT (SELECT count(full_name) FROM contacts) AS n, CAST(sum(k) AS BIGINT) AS s, max(k) AS m, count(*) AS d FROM (
  SELECT count(*) AS k FROM (SELECT CASE WHEN contains(v, '  ') THEN 1 WHEN NOT {matches('v', chr(92) + 'p{L}')} THEN NULL WHEN v = upper(v) THEN 2 WHEN v = lower(v) THEN 3 ELSE 4 END AS shape
   FROM (SELECT {trimmed('full_name')} AS v FROM contacts WHERE full_name IS NOT NULL) a) b WHERE shape IS NOT NULL GROUP BY shape) g) x WHERE d >= 2""")
def _(t):
    return checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=["name_format_inconsistency"])


# --- numeric columns -----------------------------------------------------------------------------

PAYMENT_METRICS = ("line_number", "quantity", "amount", "estimated_amount", "status_level", "unit_price", "discount", "total_amount")
FLOATS = PAYMENT_METRICS[1:]


@query("check_numeric_outliers_iqr", "C27", union_sql([
    issue_sql("payments", c, "numeric_outliers_iqr", "medium",
              f"q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))", fires="n_checked >= 20 AND n_bad > 0 AND n_bad < 0.3 * n_checked",
              source=f"payments, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM payments) b") for c in PAYMENT_METRICS]))
def _(t):
    return checks.iqr_outliers(t["payments"], "payments")


@query("check_numeric_outliers_zscore", "C28", union_sql([
    issue_sql("payments", c, "numeric_outliers_zscore", "high", f"s > 0 AND abs({c} - m) > 4 * s",
              fires="n_checked >= 20 AND n_bad > 0 AND n_bad < 0.05 * n_checked",
              source=f"payments, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM payments) b") for c in PAYMENT_METRICS]))
def _(t):
    return checks.zscore_outliers(t["payments"], "payments")


def _grouped(issue, severity, columns, fires, bad, table="payments"):
    return union_sql([f"""
SELECT '{table}' AS dataset, '{c}' AS column_name, '{issue}' AS issue_type, '{severity}' AS severity, CAST({bad} AS BIGINT) AS n_bad, n AS n_checked,
 round({bad} / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS u, (SELECT max(k) FROM (SELECT count(*) AS k FROM {table}
 WHERE {c} IS NOT NULL GROUP BY {c}) g) AS top, count(*) AS total FROM {table}) x WHERE {fires}""" for c in columns])


@query("check_low_variance_numeric", "C29", _grouped("low_variance_numeric", "low", PAYMENT_METRICS, "n > 50 AND u <= 2 AND top >= 0.98 * n", "top"))
def _(t):
    return checks.run_census_checks(t["payments"], "payments", SETTINGS, only=["low_variance_numeric"])


@query("check_numeric_precision_anomaly", "C30", union_sql([
    issue_sql("payments", c, "numeric_precision_anomaly", "low", f"{c} = floor({c})",
              fires="n_checked >= 20 AND n_bad > 0.2 * n_checked AND n_bad < 0.8 * n_checked") for c in FLOATS]))
def _(t):
    return checks.run_row_checks(t["payments"], "payments", SETTINGS, only=["numeric_precision_anomaly"])


@query("check_round_number_anomaly", "C31", union_sql([f"""
SELECT 'payments' AS dataset, '{c}' AS column_name, 'round_number_anomaly' AS issue_type, 'low' AS severity,
 CASE WHEN k > 0.3 * n THEN k ELSE h END AS n_bad, n AS n_checked, round((CASE WHEN k > 0.3 * n THEN k ELSE h END) / CAST(n AS DOUBLE), 6) AS pct FROM (
 SELECT count({c}) AS n, count(*) FILTER (WHERE {c} % 1000 = 0 AND {c} <> 0) AS k, count(*) FILTER (WHERE {c} % 100 = 0 AND {c} <> 0) AS h FROM payments) x
WHERE n >= 50 AND (k > 0.3 * n OR h > 0.5 * n)""" for c in PAYMENT_METRICS]))
def _(t):
    return checks.run_row_checks(t["payments"], "payments", SETTINGS, only=["round_number_anomaly"])


@query("check_integer_stored_as_float", "C56", union_sql([
    issue_sql("payments", c, "integer_stored_as_float", "low", f"{c} = floor({c})", fires="n_checked > 0 AND n_bad = n_checked") for c in FLOATS]))
def _(t):
    return checks.run_row_checks(t["payments"], "payments", SETTINGS, only=["integer_stored_as_float"])


@query("check_skewed_distribution", "C55", union_sql([f"""
SELECT 'payments' AS dataset, '{c}' AS column_name, 'skewed_distribution' AS issue_type, 'low' AS severity, n AS n_bad, n AS n_checked, CAST(1 AS DOUBLE) AS pct
FROM (SELECT count({c}) AS n, skewness({c}) AS g FROM payments) x WHERE abs(g) > 2""" for c in PAYMENT_METRICS if c != "status_level"] + ["""
SELECT 'payments', 'status_level', 'skewed_distribution', 'low', n, n, CAST(1 AS DOUBLE) FROM (SELECT count(*) AS n, skewness(status_level) AS g FROM payments) x WHERE abs(g) > 2"""]))
def _(t):
    return checks.skewed_distributions(t["payments"], "payments")


# --- dates -----------------------------------------------------------------------------------------

DATES = ("order_date", "ship_date", "payment_date", "billing_date")


def _dates(issue, severity, bad, columns=DATES, fires="n_bad > 0"):
    return union_sql([issue_sql("shipments", c, issue, severity, bad.format(c=c), fires=fires) for c in columns])


for _issue, _item, _severity, _bad, _fires in (
    ("future_dates", "C32", "high", "{c} > TIMESTAMP '2025-01-02 00:00:00'", "n_bad > 0"),
    ("ancient_dates", "C33", "medium", "{c} < TIMESTAMP '1900-01-01 00:00:00'", "n_bad > 0"),
    ("date_clumping_jan1", "C35", "medium", "month({c}) = 1 AND day({c}) = 1", "n_checked >= 20 AND n_bad > 0.2 * n_checked"),
    ("date_clumping_month_end", "C36", "low", "last_day({c}) = CAST({c} AS DATE)", "n_checked >= 20 AND n_bad > 0.3 * n_checked"),
    ("weekend_date_anomaly", "C37", "low", "isodow({c}) >= 6", "n_checked >= 20 AND n_bad > 0.15 * n_checked"),
):
    def _make(issue):
        return lambda t: checks.run_row_checks(t["shipments"], "shipments", SETTINGS, only=[issue])

    query(f"check_{_issue}", _item, _dates(_issue, _severity, _bad, fires=_fires))(_make(_issue))


@query("check_very_wide_date_span", "C34", union_sql([f"""
SELECT 'shipments' AS dataset, '{c}' AS column_name, 'very_wide_date_span' AS issue_type, 'low' AS severity, n AS n_bad, n AS n_checked, CAST(1 AS DOUBLE) AS pct
FROM (SELECT count({c}) AS n, date_diff('day', CAST(min({c}) AS DATE), CAST(max({c}) AS DATE)) AS d FROM shipments) x WHERE n >= 10 AND d / 365.25 > 50""" for c in DATES]))
def _(t):
    return checks.wide_date_spans(t["shipments"], "shipments", SETTINGS)


@query("check_date_range_violation", "C22", issue_sql(
    "shipments", "order_date,ship_date", "date_range_violation", "high", "ship_date < order_date", "ship_date IS NOT NULL AND order_date IS NOT NULL"))
def _(t):
    return keys.date_range_violations(t["shipments"], "shipments")


# --- distinct values -------------------------------------------------------------------------------

@query("check_constant_column", "C50", _grouped("constant_column", "low", PAYMENT_METRICS + ("line_id", "order_id", "return_flag", "currency"), "u = 1", "n"))
def _(t):
    return checks.run_census_checks(t["payments"], "payments", SETTINGS, only=["constant_column"])


@query("check_dominant_value_skew", "C51", _grouped("dominant_value_skew", "low", PAYMENT_METRICS + ("line_id", "order_id", "return_flag", "currency"), "top >= 0.92 * n", "top"))
def _(t):
    return checks.run_census_checks(t["payments"], "payments", SETTINGS, only=["dominant_value_skew"])


@query("check_binary_like_column", "C52", _grouped("binary_like_column", "low", PAYMENT_METRICS + ("line_id", "order_id", "return_flag", "currency"), "u = 2", "n"))
def _(t):
    return checks.run_census_checks(t["payments"], "payments", SETTINGS, only=["binary_like_column"])


@query("check_very_high_cardinality", "C53", _grouped("very_high_cardinality", "low", TEXT, "n > 0 AND u > 0.9 * n", "u", "contacts"))
def _(t):
    return checks.run_census_checks(t["contacts"], "contacts", SETTINGS, only=["very_high_cardinality"])


@query("check_duplicate_uuid", "C25", _grouped("duplicate_uuid", "high", ["account_uuid"], "u < n", "(n - u)", "contacts"))
def _(t):
    return checks.run_census_checks(t["contacts"], "contacts", SETTINGS, only=["duplicate_uuid"])


@query("check_potential_primary_key", "C3 B2", _grouped("potential_primary_key", "low", ALL, "n > 0 AND u = n AND n = total", "0", "contacts"))
def _(t):
    return checks.run_census_checks(t["contacts"], "contacts", SETTINGS, only=["potential_primary_key"])


@query("check_duplicate_insensitive_values", "C46", """
SELECT 'contacts' AS dataset, 'status' AS column_name, 'duplicate_insensitive_values' AS issue_type, 'low' AS severity, a - b AS n_bad, n AS n_checked,
 round((a - b) / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT count(status) AS n, count(DISTINCT trim(status)) AS a, count(DISTINCT lower(trim(status))) AS b FROM contacts) x WHERE b < a""")
def _(t):
    return checks.suppress(checks.case_findings(t["contacts"], "contacts", SETTINGS), ["case_inconsistency"])


@query("check_case_inconsistency", "C60", union_sql([f"""
SELECT 'contacts' AS dataset, '{c}' AS column_name, 'case_inconsistency' AS issue_type, 'low' AS severity, CAST(bad AS BIGINT) AS n_bad, CAST(n AS BIGINT) AS n_checked,
 round(bad / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT sum(CASE WHEN d > 1 THEN k ELSE 0 END) AS bad, sum(k) AS n FROM (
 SELECT count(*) AS k, count(DISTINCT {trimmed(c)}) AS d FROM contacts WHERE {c} IS NOT NULL GROUP BY lower({trimmed(c)})) g) x WHERE bad > 0""" for c in TEXT]))
def _(t):
    return checks.suppress(checks.case_findings(t["contacts"], "contacts", SETTINGS), ["duplicate_insensitive_values"])


@query("check_systematic_placeholder", "C64", union_sql([f"""
SELECT * FROM (SELECT 'contacts' AS dataset, '{c}' AS column_name, 'systematic_placeholder' AS issue_type, 'medium' AS severity, tok AS token, k AS n_bad, n AS n_checked,
 round(k / CAST(n AS DOUBLE), 6) AS pct FROM (SELECT lower({trimmed(c)}) AS tok, count(*) AS k, (SELECT count({c}) FROM contacts) AS n FROM contacts WHERE {c} IS NOT NULL GROUP BY 1) g
 WHERE tok IN {PLACEHOLDERS} AND k >= 5 AND k >= 0.02 * n) z""" for c in TEXT]))
def _(t):
    return checks.systematic_placeholders(t["contacts"], "contacts", SETTINGS)


@query("check_string_length_outlier", "C41", union_sql([
    issue_sql("contacts", c, "string_length_outlier", "low", f"s > 0 AND m > 1 AND length({c}) > m + 4 * s",
              fires="n_checked >= 20 AND n_bad > 0 AND n_bad < 0.1 * n_checked",
              source=f"contacts, (SELECT avg(length({c})) AS m, stddev_samp(length({c})) AS s FROM contacts) b") for c in TEXT]))
def _(t):
    return checks.length_outliers(t["contacts"], "contacts")


# --- rows and keys ---------------------------------------------------------------------------------

@query("check_duplicate_primary_key", "C3", """
SELECT 'lines_dup' AS dataset, 'l_orderkey,l_linenumber,l_partkey' AS column_name, 'duplicate_primary_key' AS issue_type, 'high' AS severity,
 CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS n_bad, CAST(sum(k) AS BIGINT) AS n_checked,
 round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / CAST(sum(k) AS DOUBLE), 6) AS pct FROM (SELECT count(*) AS k FROM lines_dup GROUP BY l_orderkey, l_linenumber, l_partkey) g""")
def _(t):
    return keys.duplicate_primary_key(t["lines_dup"], "lines_dup", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("check_duplicate_rows", "C4", """
SELECT 'lines_dup' AS dataset, '[row]' AS column_name, 'duplicate_rows' AS issue_type, 'medium' AS severity,
 CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS n_bad, CAST(sum(k) AS BIGINT) AS n_checked,
 round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / CAST(sum(k) AS DOUBLE), 6) AS pct FROM (SELECT count(*) AS k FROM lines_dup GROUP BY ALL HAVING TRUE) g""".replace(
    "SELECT count(*) AS k FROM lines_dup GROUP BY ALL HAVING TRUE",
    "SELECT count(*) AS k FROM lines_dup GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipmode_x"))
def _(t):
    return keys.duplicate_rows(t["lines_dup"], "lines_dup")


@query("check_document_duplicate_rows", "C4", """
SELECT 'documents' AS dataset, '[row]' AS column_name, 'duplicate_rows' AS issue_type, 'medium' AS severity,
 CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS n_bad, CAST(sum(k) AS BIGINT) AS n_checked,
 round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / CAST(sum(k) AS DOUBLE), 6) AS pct FROM (SELECT count(*) AS k FROM documents GROUP BY text, lang) g""")
def _(t):
    return keys.duplicate_rows(t["documents"].select("text", "lang"), "documents")


@query("check_intra_dataset_orphan_fk", "C20", issue_sql(
    "contacts", "parent_cust_id", "intra_dataset_orphan_fk", "high", "parent_cust_id NOT IN (SELECT c_custkey FROM customer)"))
def _(t):
    key, ref = keys.self_reference_candidates(t["contacts"].select("cust_id", "parent_cust_id"), ["cust_id"])[0]
    return keys.intra_dataset_orphans(t["contacts"], "contacts", key, ref)


@query("check_functional_dependency_violation", "C21", """
SELECT 'contacts' AS dataset, 'zip->city' AS column_name, 'functional_dependency_violation' AS issue_type, 'medium' AS severity,
 count(*) FILTER (WHERE d > 1) AS n_bad, CAST(sum(CASE WHEN d > 1 THEN k ELSE 0 END) AS BIGINT) AS n_rows, CAST(sum(k) AS BIGINT) AS n_checked FROM (
 SELECT count(*) AS k, count(DISTINCT city) AS d FROM contacts WHERE zip IS NOT NULL AND city IS NOT NULL GROUP BY zip) g""")
def _(t):
    return keys.functional_dependencies(t["contacts"], "contacts")


# --- schema, whole tables, follow-ups ----------------------------------------------------------------

@query("check_header_and_dates", "C37 C48 C69 C70 C71 C72", """
SELECT * FROM (VALUES ('orders', 'o Status', 'column_name_whitespace', 'low', CAST(1 AS BIGINT), CAST(4 AS BIGINT), 0.25::DOUBLE),
 ('orders', 'O_ORDERKEY', 'case_insensitive_column_collision', 'medium', 1, 4, 0.25), ('orders', 'o_orderkey', 'duplicate_column_names', 'high', 1, 4, 0.25),
 ('orders', '[table]', 'schema_mismatch', 'high', 1, 4, 0.25)) v(dataset, column_name, issue_type, severity, n_bad, n_checked, pct)
UNION ALL """ + issue_sql("orders", "o_orderdate", "weekend_date_anomaly", "low", "isodow(o_orderdate) >= 6"))
def _(t):
    found = checks.schema_checks(t["orders"], "orders", header=["o_orderkey", "o Status", "O_ORDERKEY", "o_orderkey"],
                                 expected=["o_orderkey", "o_status"])
    return found.unionByName(checks.run_row_checks(t["orders"], "orders", SETTINGS, only=["weekend_date_anomaly"]))


@query("check_empty_dataset", "C68", """
SELECT 'orders_before_1990' AS dataset, '[table]' AS column_name, 'empty_dataset' AS issue_type, 'high' AS severity, CAST(0 AS BIGINT) AS n_bad,
 CAST(0 AS BIGINT) AS n_checked, CAST(NULL AS DOUBLE) AS pct WHERE (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1990-01-01') = 0""")
def _(t):
    return checks.schema_checks(t["orders"].filter("o_orderdate < TIMESTAMP_NTZ '1990-01-01'"), "orders_before_1990")


@query("check_suggested_expectations", "C49", """
SELECT 'customer' AS dataset, c AS column_name, s AS suggested_check FROM (
 SELECT 'c_custkey' AS c, unnest(['not_null', 'unique']) AS s UNION ALL SELECT 'c_name', unnest(['not_null', 'unique'])
 UNION ALL SELECT 'c_nationkey', unnest(CASE WHEN (SELECT count(DISTINCT c_nationkey) FROM customer) <= 25 THEN ['not_null', 'in_set'] ELSE ['not_null'] END)
 UNION ALL SELECT 'c_acctbal', unnest(CASE WHEN (SELECT count(DISTINCT c_acctbal) = count(*) FROM customer) THEN ['not_null', 'unique'] ELSE ['not_null'] END)
 UNION ALL SELECT 'c_mktsegment', unnest(['not_null', 'in_set'])) x""")
def _(t):
    c = t["customer"]
    return checks.suggest_checks(profile.column_profile(c, "customer"), profile.semantic_types(profile.value_shares(c, "customer")))


@query("check_suppressed_findings", "C54", """
SELECT issue_type, count(*) AS n FROM (""" + union_sql([
    _dates("weekend_date_anomaly", "low", "isodow({c}) >= 6", fires="n_checked >= 20 AND n_bad > 0.15 * n_checked"),
    _dates("future_dates", "high", "{c} > TIMESTAMP '2025-01-02 00:00:00'"),
]) + ") f WHERE issue_type NOT IN ('weekend_date_anomaly', 'round_number_anomaly') GROUP BY issue_type")
def _(t):
    found = checks.run_row_checks(t["shipments"], "shipments", SETTINGS, only=["weekend_date_anomaly", "future_dates"])
    return checks.suppress(found, ["weekend_date_anomaly", "round_number_anomaly"]).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


@query("check_violation_rows", "C6 C11 C44", """
SELECT 'contacts' AS dataset, 'invalid_email' AS issue_type, 'email' AS column_name, CAST(cust_id AS VARCHAR) AS row_key, email AS value FROM contacts WHERE NOT """
       + matches("email", fv.EMAIL) + """
UNION ALL SELECT 'contacts', 'implausible_age', 'age', CAST(cust_id AS VARCHAR), CAST(age AS VARCHAR) FROM contacts WHERE age < 0 OR age > 150""")
def _(t):
    return checks.violations(t["contacts"], "contacts", ["cust_id"], SETTINGS, only=["invalid_email", "implausible_age"])


@query("check_html_in_pages", "C16 A8", issue_sql("pages", "html", "html_tags_in_text", "medium", matches("html", fv.HTML_TAG)))
def _(t):
    return checks.run_row_checks(t["pages"], "pages", SETTINGS, only=["html_tags_in_text"], columns=["html"])


@query("check_document_text", "C14 C39 C40 C59", union_sql([
    issue_sql("documents", "text", "whitespace", "low", f"{matches('text', fv.OUTER_SPACE)} OR {trimmed('text')} = ''"),
    issue_sql("documents", "text", "non_ascii_characters", "low", matches("text", fv.NON_ASCII), fires="n_bad > 0 AND n_checked >= 10 AND n_bad < 0.5 * n_checked"),
    issue_sql("documents", "text", "control_characters_in_text", "medium", matches("text", fv.CONTROL_CHARACTER), fires="n_bad > 0 AND n_checked >= 5"),
    issue_sql("documents", "text", "extremely_long_strings", "low", "length(text) > 4000")]))
def _(t):
    return checks.run_row_checks(t["documents"], "documents", SETTINGS, columns=["text"],
                                 only=["whitespace", "non_ascii_characters", "control_characters_in_text", "extremely_long_strings"])


checks.register_check("ship_before_order", lambda df: F.col("ship_date") < F.col("order_date"), "high")


@query("check_user_registered", "C22", issue_sql("shipments", "[row]", "ship_before_order", "high", "ship_date < order_date", "TRUE"))
def _(t):
    return checks.run_user_checks(t["shipments"], "shipments")
