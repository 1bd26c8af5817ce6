"""Queries of the column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import load, transforms as tr
from plumbline.plans.steps import Step, run_gated, run_steps
from plumbline.queries.checking import PLACEHOLDERS, SENTINELS, trimmed
from plumbline.queries.profiling import parsed_sql
from plumbline.queries.registry import matches, query, quote


@query("transform_trim_and_case", "H1 H2", f"""
SELECT cust_id, {trimmed('full_name')} AS full_name, lower(email) AS email, upper(city) AS city, amount FROM contacts""")
def _(t):
    df = tr.uppercase(tr.lowercase(tr.trim(t["contacts"], "full_name"), "email"), "city")
    return tr.trim(df, "amount").select("cust_id", "full_name", "email", "city", "amount")


@query("transform_fill_constant", "H3", """
SELECT cust_id, coalesce(full_name, 'nobody') AS full_name, coalesce(parent_cust_id, 0) AS parent_cust_id, email FROM contacts""")
def _(t):
    df = tr.fill_nulls(tr.fill_nulls(t["contacts"], "full_name", "nobody"), "parent_cust_id")
    return tr.fill_nulls(df, "email").select("cust_id", "full_name", "parent_cust_id", "email")


@query("transform_fill_statistics", "H4", """
SELECT order_id, round(coalesce(refund_amount, (SELECT avg(refund_amount) FROM shipments)), 6) AS refund_amount,
 round(coalesce(discount_amount, (SELECT median(discount_amount) FROM shipments)), 6) AS discount_amount FROM shipments""")
def _(t):
    df = tr.fill_nulls(tr.fill_nulls(t["shipments"], "refund_amount", strategy="mean"), "discount_amount", strategy="median")
    return df.select("order_id", F.round("refund_amount", 6).alias("refund_amount"), F.round("discount_amount", 6).alias("discount_amount"))


@query("transform_fill_mode", "H4", """
SELECT event_id, coalesce(k, (SELECT min(k) FROM (SELECT k, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN event_type END AS k FROM events) a WHERE k IS NOT NULL GROUP BY k
 QUALIFY n = max(n) OVER ()) m)) AS event_type FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS k FROM events) e""")
def _(t):
    gaps = t["events"].select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return tr.fill_nulls(gaps, "event_type", strategy="mode")


@query("transform_coerce_numbers", "H5 H6", """
SELECT cust_id, TRY_CAST(score_text AS BIGINT) AS score_text, CAST(round(amount, 2) AS DOUBLE) AS amount, TRY_CAST(zip AS BIGINT) AS zip FROM contacts""")
def _(t):
    df = tr.cast_integer(tr.coerce_numeric(tr.cast_integer(t["contacts"], "score_text"), "amount"), "zip")
    return df.select("cust_id", "score_text", F.col("amount").cast("double").alias("amount"), "zip")


@query("transform_parse_dates", "H7", f"""
SELECT cust_id, strftime({parsed_sql('trim(signup_date)')}, '%Y-%m-%d %H:%M:%S') AS signup_date FROM contacts""")
def _(t):
    return tr.parse_dates(t["contacts"], "signup_date").select("cust_id", F.date_format("signup_date", "yyyy-MM-dd HH:mm:ss").alias("signup_date"))


@query("transform_sanitize_email", "H8", f"""
SELECT cust_id, CASE WHEN contains(email, '@') THEN lower({trimmed('email')}) END AS email,
 CASE WHEN regexp_matches(lower({trimmed('email')}), '^[^@]*@[^@]*\\.[^@]*$') THEN lower({trimmed('email')}) END AS email_strict FROM contacts""")
def _(t):
    df = t["contacts"].withColumn("email_strict", F.col("email"))
    return tr.sanitize_email(tr.sanitize_email(df, "email_strict", strict=True), "email").select("cust_id", "email", "email_strict")


@query("transform_normalize_phone", "H9", f"""
SELECT cust_id, regexp_replace(phone, '[^0-9]', '', 'g') AS phone,
 CASE WHEN {matches('phone', fv.PHONE)} AND length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(phone, '[^0-9]', '', 'g') END AS phone_strict FROM contacts""")
def _(t):
    df = t["contacts"].withColumn("phone_strict", F.col("phone"))
    return tr.normalize_phone(tr.normalize_phone(df, "phone_strict", strict=True), "phone").select("cust_id", "phone", "phone_strict")


@query("transform_hash_and_mask", "H10 H11", """
SELECT cust_id, sha256(email) AS email, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) < 4 THEN '***' ELSE '***' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) END AS phone FROM contacts""")
def _(t):
    return tr.mask_column(tr.hash_column(t["contacts"], "email"), "phone").select("cust_id", "email", "phone")


@query("transform_mask_sensitive_rows", "H12", """
SELECT cust_id, CASE WHEN email IS NULL THEN NULL WHEN regexp_matches(trim(email), '^[^@]{1,2}[^@]*@.+$') THEN left(trim(email), 2) || '***' || substr(trim(email), strpos(trim(email), '@')) ELSE '***' END AS email,
 CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) <= 4 THEN '***' ELSE '***' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) END AS phone, city,
 left(account_code, 2) AS code_start FROM contacts""")
def _(t):
    df = tr.mask_sensitive(t["contacts"].select("cust_id", "email", "phone", "city", "account_code"))
    return df.select("cust_id", "email", "phone", "city", F.substring("account_code", 1, 2).alias("code_start"))


@query("transform_mask_free_text", "H12", """
SELECT doc_id, CASE WHEN length(text) <= 4 THEN '***' ELSE left(text, 2) || '***' || right(text, 2) END AS address_text FROM documents""")
def _(t):
    return tr.mask_sensitive(t["documents"].select("doc_id", F.col("text").alias("address_text")))


@query("transform_standardize_boolean", "H13", """
SELECT cust_id, CAST(lower(active_flag) IN ('1', 'true', 'yes', 'y', 't') AS INTEGER) AS active_flag FROM contacts""")
def _(t):
    return tr.standardize_boolean(t["contacts"], "active_flag").select("cust_id", "active_flag")


@query("transform_sentinels_to_null", "H14", f"""
SELECT cust_id, CASE WHEN amount NOT IN {SENTINELS} THEN amount END AS amount, CASE WHEN age NOT IN {SENTINELS} THEN age END AS age,
 CASE WHEN coalesce(TRY_CAST(score_text AS DOUBLE) IN {SENTINELS}, FALSE) THEN NULL ELSE score_text END AS score_text FROM contacts""")
def _(t):
    df = t["contacts"]
    for c in ("amount", "age", "score_text"):
        df = tr.zero_to_null(df, c)
    return df.select("cust_id", "amount", "age", "score_text")


def _bounds(c, lo, hi, factor):
    return f"(SELECT quantile_cont({c}, {lo}) - {factor} * (quantile_cont({c}, {hi}) - quantile_cont({c}, {lo})) AS l, quantile_cont({c}, {hi}) + {factor} * (quantile_cont({c}, {hi}) - quantile_cont({c}, {lo})) AS h, median({c}) AS m FROM payments) b"


@query("transform_flag_outliers", "H15", f"""
SELECT line_id, amount, coalesce(amount < l OR amount > h, FALSE) AS amount_outlier_flagged FROM payments, {_bounds('amount', 0.25, 0.75, 1.5)}""")
def _(t):
    return tr.flag_outliers(t["payments"], "amount").select("line_id", "amount", "amount_outlier_flagged")


@query("transform_clip_outliers", "H16", f"""
SELECT line_id, round(least(greatest(amount, l), h), 6) AS amount FROM payments, {_bounds('amount', 0.25, 0.75, 1.5)}""")
def _(t):
    return tr.clip_outliers(t["payments"], "amount").select("line_id", F.round("amount", 6).alias("amount"))


@query("transform_cap_outliers", "H17", f"""
SELECT line_id, round(CASE WHEN amount < l OR amount > h THEN m ELSE amount END, 6) AS amount FROM payments, {_bounds('amount', 0.25, 0.75, 1.5)}""")
def _(t):
    return tr.cap_outliers(t["payments"], "amount").select("line_id", F.round("amount", 6).alias("amount"))


@query("transform_percentile_bounds", "H18", f"""
SELECT line_id, round(least(greatest(amount, l), h), 6) AS amount FROM payments, {_bounds('amount', 0.05, 0.95, 0.5)}""")
def _(t):
    return tr.clip_outliers(t["payments"], "amount", 0.5, "p5_p95").select("line_id", F.round("amount", 6).alias("amount"))


@query("transform_range_clip", "H19", "SELECT line_id, greatest(0.0, quantity) AS quantity FROM payments".replace("0.0", "CAST(0 AS DOUBLE)"))
def _(t):
    return tr.range_clip(t["payments"], "quantity").select("line_id", "quantity")


@query("transform_replace_values", "H20", """
SELECT cust_id, CASE status WHEN 'TBD' THEN 'Unknown' WHEN 'ACTIVE' THEN 'Active' ELSE status END AS status FROM contacts""")
def _(t):
    return tr.replace_values(t["contacts"], "status", {"TBD": "Unknown", "ACTIVE": "Active"}).select("cust_id", "status")


@query("transform_regex_replace", "H21 H22", """
SELECT cust_id, regexp_replace(full_name, '[^\\p{L}\\p{N}_ \\t\\r\\n]', '', 'g') AS full_name, CAST(18 AS BIGINT) AS columns_left FROM contacts""")
def _(t):
    df = tr.drop_columns(tr.regex_replace(t["contacts"], "full_name"), "remark")
    return df.select("cust_id", "full_name", F.lit(len(df.columns)).cast("long").alias("columns_left"))


@query("transform_nullify_future_dates", "H23", """
SELECT order_id, strftime(CASE WHEN order_date <= TIMESTAMP '2025-01-01' THEN order_date END, '%Y-%m-%d') AS order_date FROM shipments""")
def _(t):
    return tr.nullify_future_dates(t["shipments"], "order_date", "2025-01-01 00:00:00").select("order_id", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


@query("transform_placeholders_to_null", "H24", f"""
SELECT cust_id, CASE WHEN lower({trimmed('full_name')}) NOT IN {PLACEHOLDERS} THEN full_name END AS full_name, CASE WHEN lower(status) NOT IN {PLACEHOLDERS} THEN status END AS status FROM contacts""")
def _(t):
    return tr.placeholders_to_null(t["contacts"].select("cust_id", "full_name", "status"), fv.PLACEHOLDERS)


_TIDY = f"regexp_replace({trimmed('full_name')}, '[ \\t\\r\\n]+', ' ', 'g')"


@query("transform_tidy_text_and_ids", "H25", f"""
SELECT cust_id, CASE WHEN lower({_TIDY}) NOT IN ('nan','null','none','tbd','tba','n/a','na','-','--','') THEN lower({_TIDY}) END AS full_name,
 CASE WHEN CAST(age AS VARCHAR) NOT IN ('0','-999','999','1111','1234','9876','9999') THEN CAST(age AS VARCHAR) END AS age FROM contacts""")
def _(t):
    df = tr.tidy_id_column(tr.tidy_text_column(t["contacts"], "full_name", casing="lower"), "age")
    return df.select("cust_id", "full_name", "age")


@query("transform_enforce_valid_values", "H26", """
SELECT cust_id, status, 'dropped' AS variant FROM contacts WHERE lower(status) IN ('active', 'closed')
UNION ALL SELECT cust_id, CASE WHEN lower(status) IN ('active', 'closed') THEN status END, 'nulled' FROM contacts""")
def _(t):
    c = t["contacts"].select("cust_id", "status")
    dropped = tr.enforce_valid_values(c, "status", ["active", "closed"]).withColumn("variant", F.lit("dropped"))
    return dropped.unionByName(tr.enforce_valid_values(c, "status", ["active", "closed"], never_drop_rows=True).withColumn("variant", F.lit("nulled")))


@query("transform_require_any", "H27", "SELECT order_id FROM shipments WHERE refund_amount IS NOT NULL OR discount_amount IS NOT NULL")
def _(t):
    return tr.require_any(t["shipments"], ["refund_amount", "discount_amount"]).select("order_id")


@query("transform_flatten_json_props", "H28 A3", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""")
def _(t):
    return tr.flatten_json_text(t["events"].select("event_id", "event_type", "props"), "props", "struct<k: bigint>")


@query("transform_flatten_nested_rows", "H28", """
SELECT l_orderkey AS head_order_id, l_linenumber AS head_line, 'quantity' AS measures_kind, l_quantity AS measures_amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem""")
def _(t):
    measures = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("amount")) for k, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"))])
    nested = t["lineitem"].select(F.struct(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")).alias("head"), measures.alias("measures"))
    return tr.flatten_nested(nested)


_GAPS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events) g"


def _with_gaps(t):
    return t["events"].select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))


@query("transform_fill_forward", "H29", f"""
SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM {_GAPS}""")
def _(t):
    return tr.fill_directional(_with_gaps(t), "value", ["user_id"], "ts", "event_id").select("event_id", "value")


@query("transform_fill_backward", "H29", f"""
SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_GAPS}""")
def _(t):
    return tr.fill_directional(_with_gaps(t), "value", ["user_id"], "ts", "event_id", backward=True).select("event_id", "value")


@query("transform_fill_sequence", "H29", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def _(t):
    return tr.fill_sequence(t["orders"].select("o_orderkey", "o_orderdate"), "seq", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "seq")


@query("transform_currency_normalize", "H29", "SELECT c_custkey, c_acctbal AS balance FROM customer")
def _(t):
    amount = F.abs("c_acctbal").cast("decimal(18,2)").cast("string")
    text = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("(EUR "), amount, F.lit(")"))).otherwise(F.concat(F.lit("$ "), amount))
    return tr.currency_normalize(t["customer"].select("c_custkey", text.alias("balance")), "balance")


_STEPS = [
    Step("flag_outliers", "amount"), Step("coerce_numeric", "score_text", {"to": "bigint"}), Step("zero_to_null", "amount"), Step("trim", "full_name"),
    Step("lowercase", "full_name"), Step("sanitize_email", "email"), Step("fill_nulls", "status", {"value": "none"}), Step("hash", "phone"), Step("drop_column", "remark"),
]


@query("steps_ordered_cleaning", "H31 J10", f"""
SELECT cust_id, lower({trimmed('full_name')}) AS full_name, CASE WHEN contains(email, '@') THEN lower({trimmed('email')}) END AS email, sha256(phone) AS phone, TRY_CAST(score_text AS BIGINT) AS score_text,
 CASE WHEN amount NOT IN {SENTINELS} THEN amount END AS amount, CAST(19 AS BIGINT) AS columns_left FROM contacts""")
def _(t):
    df = run_steps(t["contacts"], _STEPS)
    return df.select("cust_id", "full_name", "email", "phone", "score_text", "amount", F.lit(len(df.columns)).cast("long").alias("columns_left"))


@query("steps_gated_phases", "J11", f"""
SELECT 'cleanse' AS phase, cust_id, lower({trimmed('full_name')}) AS full_name, phone FROM contacts
UNION ALL SELECT 'transform', cust_id, lower({trimmed('full_name')}), sha256(phone) FROM contacts""")
def _(t):
    clean, final = run_gated(t["contacts"], _STEPS, passed=True)
    cols = ["cust_id", "full_name", "phone"]
    return clean.select(F.lit("cleanse").alias("phase"), *cols).unionByName(final.select(F.lit("transform").alias("phase"), *cols))
