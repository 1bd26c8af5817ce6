"""Queries of the profiling family."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import keys, profile
from plumbline.operators.census import census_summary, top_values, value_census
from plumbline.queries.registry import matches, query, quote, union_sql

LINEITEM = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
    "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
    "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date",
}
CONTACTS = {
    "cust_id": "integer", "full_name": "text", "email": "text", "phone": "text", "account_uuid": "text",
    "website_url": "text", "signup_date": "text", "active_flag": "text", "status": "text", "zip": "text",
    "city": "text", "age": "integer", "interest_rate": "float", "score_text": "text", "account_code": "text",
    "parent_cust_id": "integer", "amount": "float", "remark": "text", "attributes": "text",
}


def _profile_sql(table, columns):
    parts = []
    for c, kind in columns.items():
        number = f"CAST({c} AS DOUBLE)" if kind in ("integer", "float") else "CAST(NULL AS DOUBLE)"
        text = c if kind == "text" else (f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind == "date" else "CAST(NULL AS VARCHAR)")
        parts.append(
            f"SELECT {quote(table)} AS dataset, {quote(c)} AS column_name, {quote(kind)} AS dtype, count(*) AS row_count, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
            f"round(count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, "
            f"(SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM {table} GROUP BY {c}) g WHERE k > 1) AS duplicate_value_count, "
            f"min({number}) AS min_number, max({number}) AS max_number, min({text}) AS min_text, max({text}) AS max_text, "
            f"count(*) FILTER (WHERE {number} = 0) AS zeros, count(*) FILTER (WHERE {number} < 0) AS negatives, "
            f"(count(*) FILTER (WHERE {c} IS NULL) = 0 AND count(DISTINCT {c}) = count(*)) AS is_key_candidate FROM {table}"
        )
    return union_sql(parts)


PROFILE_COLUMNS = ["dataset", "column_name", "dtype", "row_count", "null_count", "null_pct", "unique_count",
                   "duplicate_value_count", "min_number", "max_number", "min_text", "max_text", "zeros", "negatives",
                   "is_key_candidate"]


@query("profile_table_size", "B1", """
SELECT 'orders' AS dataset, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM orders""")
def _(t):
    return profile.table_profile(t["orders"], "orders").select("dataset", "row_count", "column_count")


@query("profile_lineitem_columns", "B2 B5 A7", _profile_sql("lineitem", LINEITEM))
def _(t):
    return profile.column_profile(t["lineitem"], "lineitem").select(*PROFILE_COLUMNS)


@query("profile_contacts_columns", "B2 B5", _profile_sql("contacts", CONTACTS))
def _(t):
    return profile.column_profile(t["contacts"], "contacts").select(*PROFILE_COLUMNS)


@query("profile_approximate_distincts", "B3 I13")
def _(t):
    return profile.approximate_distincts(t["lineitem"], "lineitem")


def _stats_sql(table, columns):
    return union_sql([
        f"""SELECT '{table}' AS dataset, '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean,
        round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, round(skewness({c}), 6) AS skew,
        round(kurtosis_pop({c}), 6) AS kurtosis, round(quantile_cont({c}, 0.05), 6) AS p5,
        round(quantile_cont({c}, 0.95), 6) AS p95 FROM {table}""" for c in columns
    ])


@query("profile_numeric_statistics", "B4", _stats_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t):
    return profile.numeric_stats(t["lineitem"], "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("profile_extended_figures", "B6", """
SELECT 'lines_dup' AS dataset, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS missing_cells,
  CAST(sum(CASE WHEN l_orderkey = 0 THEN 1 ELSE 0 END + CASE WHEN l_partkey = 0 THEN 1 ELSE 0 END + CASE WHEN l_suppkey = 0 THEN 1 ELSE 0 END
   + CASE WHEN l_linenumber = 0 THEN 1 ELSE 0 END + CASE WHEN l_quantity = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lines_dup) d) AS duplicate_rows,
  CAST(0 AS BIGINT) AS constant_columns, CAST(0 AS DOUBLE) AS missing_pct FROM lines_dup""")
def _(t):
    return profile.extended_profile(t["lines_dup"], "lines_dup").select(
        "dataset", "row_count", "column_count", "missing_cells", "zero_cells", "duplicate_rows", "constant_columns", "missing_pct")


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query("profile_pearson_correlations", "B7", union_sql([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in _PAIRS]))
def _(t):
    return profile.correlations(t["lineitem"], ["l_quantity", "l_extendedprice", "l_discount"])


def _avg_rank(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("profile_spearman_correlations", "B7", f"""
SELECT 'o_totalprice' AS column_a, 'o_custkey' AS column_b, round(corr(a, b), 6) AS correlation FROM (
  SELECT {_avg_rank('o_totalprice')} AS a, {_avg_rank('o_custkey')} AS b FROM orders) r""")
def _(t):
    return profile.correlations(t["orders"], ["o_totalprice", "o_custkey"], "spearman")


@query("profile_correlated_column_alerts", "B7", """
SELECT 'quantity' AS column_a, 'total_amount' AS column_b, c AS correlation FROM (SELECT round(corr(quantity, total_amount), 6) AS c FROM payments) x WHERE abs(c) >= 0.5
UNION ALL SELECT 'unit_price', 'total_amount', c FROM (SELECT round(corr(unit_price, total_amount), 6) AS c FROM payments) x WHERE abs(c) >= 0.5
UNION ALL SELECT 'quantity', 'unit_price', c FROM (SELECT round(corr(quantity, unit_price), 6) AS c FROM payments) x WHERE abs(c) >= 0.5""")
def _(t):
    return profile.correlated_columns(t["payments"], ["quantity", "unit_price", "total_amount"], 0.5)


@query("profile_scalar_type_mix", "B8", union_sql([f"""
SELECT 'contacts' AS dataset, '{c}' AS column_name, count({c}) AS n,
  round(count(*) FILTER (WHERE NOT (regexp_matches(trim({c}), '^[+-]?[0-9]+$') OR lower(trim({c})) IN ('true','false')
     OR (regexp_matches(trim({c}), '^\\{{.*\\}}$') AND json_valid(trim({c}))))) / CAST(count({c}) AS DOUBLE), 6) AS pct_string,
  round(count(*) FILTER (WHERE regexp_matches(trim({c}), '^[+-]?[0-9]+$')) / CAST(count({c}) AS DOUBLE), 6) AS pct_integer,
  round(count(*) FILTER (WHERE lower(trim({c})) IN ('true','false')) / CAST(count({c}) AS DOUBLE), 6) AS pct_boolean,
  round(count(*) FILTER (WHERE regexp_matches(trim({c}), '^\\{{.*\\}}$') AND json_valid(trim({c}))) / CAST(count({c}) AS DOUBLE), 6) AS pct_dict
FROM contacts""" for c in ("score_text", "active_flag", "attributes", "full_name")]))
def _(t):
    return profile.type_mix(t["contacts"], "contacts", ["score_text", "active_flag", "attributes", "full_name"]).select(
        "dataset", "column_name", "n", "pct_string", "pct_integer", "pct_boolean", "pct_dict")


PARSED = ("coalesce(CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({c} AS TIMESTAMP) END, "
          "try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%m/%d/%Y'), try_strptime({c}, '%Y/%m/%d'))")


def parsed_sql(c):
    return PARSED.format(c=c)


_SHAPES = ["email", "phone", "account_uuid", "website_url", "signup_date", "active_flag", "zip", "city", "remark"]


def _shares_sql():
    parts = []
    for c in _SHAPES:
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS n,
  avg(CASE WHEN {matches(c, fv.UUID_ANY)} THEN 1.0 ELSE 0.0 END) AS uuid,
  avg(CASE WHEN {matches(f'lower(trim({c}))', fv.URL_START)} THEN 1.0 ELSE 0.0 END) AS url,
  avg(CASE WHEN contains({c}, '@') THEN 1.0 ELSE 0.0 END) AS at_sign,
  avg(CASE WHEN lower(trim({c})) IN ('true','false','yes','no','y','n','1','0','t','f','on','off') THEN 1.0 ELSE 0.0 END) AS bool,
  avg(CASE WHEN {matches(f'trim({c})', fv.ISO_DATE_START)} THEN 1.0 ELSE 0.0 END) AS iso,
  avg(CASE WHEN {parsed_sql(f'trim({c})')} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS dates,
  avg(CASE WHEN {matches(f'trim({c})', fv.DIGITS)} THEN 1.0 ELSE 0.0 END) AS digits,
  avg(length({c})) AS len FROM contacts WHERE {c} IS NOT NULL""")
    return union_sql(parts)


@query("profile_semantic_types", "B9", f"""
SELECT 'contacts' AS dataset, column_name, n, CASE WHEN column_name = 'phone' THEN 'phone' WHEN uuid >= 0.7 THEN 'uuid'
  WHEN url >= 0.5 THEN 'url' WHEN at_sign >= 0.5 THEN 'email' WHEN bool >= 0.8 THEN 'boolean_like' WHEN iso >= 0.5 THEN 'date'
  WHEN dates >= 0.7 THEN 'date' WHEN digits >= 0.9 THEN 'numeric_id' WHEN len > 50 THEN 'free_text' ELSE 'categorical' END AS semantic_type
FROM ({_shares_sql()}) s""")
def _(t):
    return profile.semantic_types(profile.value_shares(t["contacts"], "contacts", _SHAPES))


@query("profile_storage_hints", "B10", union_sql([f"""
SELECT 'contacts' AS dataset, '{c}' AS column_name, n, CASE WHEN n = 0 THEN 'unknown' WHEN nested = n THEN 'nested'
 WHEN bools > 0.8 * n THEN 'boolean_like' WHEN nums > 0.8 * n THEN 'numeric_like' WHEN marks >= 0.2 * n AND dates > 0.8 * n THEN 'datetime_like'
 WHEN nums = 0 AND dates = 0 AND nested = 0 THEN 'string' ELSE 'mixed' END AS storage_hint FROM (
 SELECT count({c}) AS n, count(*) FILTER (WHERE {matches(c, fv.JSON_SHAPE)}) AS nested,
  count(*) FILTER (WHERE lower(trim({c})) IN ('true','false','yes','no','y','n','1','0','t','f','on','off')) AS bools,
  count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) IS NOT NULL) AS nums,
  count(*) FILTER (WHERE regexp_matches({c}, '[-/:T]')) AS marks,
  count(*) FILTER (WHERE {parsed_sql(f'trim({c})')} IS NOT NULL) AS dates FROM contacts) x"""
    for c in ("active_flag", "zip", "score_text", "attributes", "city", "signup_date")]))
def _(t):
    return profile.storage_hints(t["contacts"], "contacts", ["active_flag", "zip", "score_text", "attributes", "city", "signup_date"])


@query("profile_date_formats", "B11", f"""
SELECT 'signup_date' AS column_name, format, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS pct FROM (
 SELECT CASE WHEN {parsed_sql('trim(signup_date)')} IS NULL THEN 'unparsed'
  WHEN {matches('trim(signup_date)', fv.DATE_SHAPES['YYYY-MM-DD'])} THEN 'YYYY-MM-DD'
  WHEN {matches('trim(signup_date)', fv.DATE_SHAPES['MM/DD/YYYY'])} THEN 'MM/DD/YYYY'
  WHEN {matches('trim(signup_date)', fv.DATE_SHAPES['DD-MM-YYYY'])} THEN 'DD-MM-YYYY'
  WHEN {matches('trim(signup_date)', fv.DATE_SHAPES['YYYY/MM/DD'])} THEN 'YYYY/MM/DD' ELSE 'other/timestamp' END AS format
 FROM contacts WHERE trim(signup_date) <> '') x GROUP BY format""")
def _(t):
    return profile.date_format_census(t["contacts"], "signup_date")


@query("profile_date_format_variants", "B11", f"""
SELECT 'signup_date' AS column_name, format, count(*) AS n, round(count(*) / (SELECT CAST(count(signup_date) AS DOUBLE) FROM contacts), 4) AS pct FROM (
 SELECT CASE WHEN {matches('trim(signup_date)', fv.DATE_VARIANTS['DD/MM/YYYY'])} THEN 'DD/MM/YYYY'
  WHEN {matches('trim(signup_date)', fv.DATE_VARIANTS['YYYY-MM-DD'])} THEN 'YYYY-MM-DD'
  WHEN {matches('trim(signup_date)', fv.DATE_VARIANTS['YYYY/MM/DD'])} THEN 'YYYY/MM/DD' END AS format FROM contacts) x
WHERE format IS NOT NULL GROUP BY format""")
def _(t):
    return profile.date_format_census(t["contacts"], "signup_date", variants=True)


@query("profile_phone_formats", "B12", f"""
SELECT 'phone' AS column_name, CASE WHEN trim(phone) = '' THEN 'empty' WHEN {matches('trim(phone)', fv.E164)} THEN 'e164'
 WHEN {matches('trim(phone)', fv.PHONE)} THEN 'national' ELSE 'invalid' END AS format, count(*) AS n
FROM contacts WHERE phone IS NOT NULL GROUP BY 2""")
def _(t):
    return profile.phone_format_census(t["contacts"], "phone")


@query("profile_null_patterns", "B14", """
SELECT 'shipments' AS dataset, 'discount_amount' AS column_name,
 (SELECT count(*) FROM shipments WHERE discount_amount IS NULL) AS total_nulls,
 CASE WHEN max(s) > 0.8 THEN 'MNAR' ELSE 'MCAR' END AS pattern,
 CASE WHEN max(s) > 0.8 THEN arg_max(k, s) END AS concentrated_in_col, CASE WHEN max(s) > 0.8 THEN arg_max(v, s) END AS concentrated_in_value
FROM (SELECT 'status' AS k, status AS v, avg(CASE WHEN discount_amount IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM shipments GROUP BY status
 UNION ALL SELECT 'priority', priority, avg(CASE WHEN discount_amount IS NULL THEN 1.0 ELSE 0.0 END) FROM shipments GROUP BY priority) x""")
def _(t):
    return profile.null_patterns(t["shipments"], "shipments", "discount_amount", ["status", "priority"])


@query("profile_null_pattern_mnar", "B14", """
SELECT 'events' AS dataset, 'value_clean' AS column_name, count(*) AS total_nulls, 'MNAR' AS pattern,
 'event_type' AS concentrated_in_col, 'error' AS concentrated_in_value FROM events WHERE event_type = 'error'""")
def _(t):
    events = t["events"].withColumn("value_clean", F.when(F.col("event_type") != "error", F.col("value")))
    return profile.null_patterns(events, "events", "value_clean", ["event_type"])


@query("profile_business_key", "B15", """
SELECT 'lines_dup' AS dataset, 'l_orderkey,l_linenumber' AS business_key,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lines_dup) d) AS duplicate_count, 'keep_last' AS dedup_hint FROM lines_dup""")
def _(t):
    return keys.confirm_business_key(t["lines_dup"], "lines_dup", ["l_orderkey", "l_linenumber"])


@query("profile_null_ranking", "B20", f"""
SELECT dataset, column_name, null_count, null_pct FROM ({_profile_sql('contacts', CONTACTS)}) p
ORDER BY null_pct DESC, column_name LIMIT 5""")
def _(t):
    metrics = profile.base_metrics(t["contacts"], "contacts")
    return profile.null_ranking(metrics.withColumn("null_pct", F.round(F.col("null_count") / F.col("row_count"), 6)), 5)


_COMPARED = {"c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "float"}
_COMPARED_B = {"s_suppkey": "integer", "s_name": "text", "s_nationkey": "integer", "s_acctbal": "float"}


@query("profile_two_datasets", "B21", f"""
SELECT coalesce(a.k, b.k) AS column_name, a.unique_count AS unique_count_a, b.unique_count AS unique_count_b,
 a.null_pct AS null_pct_a, b.null_pct AS null_pct_b, a.max_number AS max_number_a, b.max_number AS max_number_b,
 round(b.null_pct - a.null_pct, 6) AS null_pct_delta, b.unique_count - a.unique_count AS unique_delta,
 CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS presence
FROM (SELECT *, substr(column_name, 3) AS k FROM ({_profile_sql('customer', {**_COMPARED, 'c_mktsegment': 'text'})}) p) a
FULL OUTER JOIN (SELECT *, substr(column_name, 3) AS k FROM ({_profile_sql('supplier', _COMPARED_B)}) p) b ON a.k = b.k""")
def _(t):
    def stripped(table):
        df = t[table]
        return profile.column_profile(df.toDF(*[c[2:] for c in df.columns]), table)

    return profile.compare_profiles(stripped("customer"), stripped("supplier")).select(
        "column_name", "unique_count_a", "unique_count_b", "null_pct_a", "null_pct_b", "max_number_a", "max_number_b",
        "null_pct_delta", "unique_delta", "presence")


@query("profile_histograms", "B22", union_sql([f"""
SELECT '{c}' AS column_name, CAST(bin AS INTEGER) AS bin, round(lo + bin * (hi - lo) / 10, 6) AS bin_start, count(*) AS n FROM (
 SELECT least(9, floor(({c} - lo) / ((hi - lo) / 10))) AS bin, lo, hi FROM lineitem,
 (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) e) x GROUP BY bin, lo, hi""" for c in ("l_quantity", "l_extendedprice")]))
def _(t):
    return profile.histogram(t["lineitem"], ["l_quantity", "l_extendedprice"], 10)


@query("profile_top_values", "B22", union_sql([f"""
SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n,
 CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank FROM part GROUP BY {c} QUALIFY rank <= 5"""
    for c in ("p_brand", "p_type", "p_size")]))
def _(t):
    return top_values(value_census(t["part"], ["p_brand", "p_type", "p_size"]), 5)


@query("profile_value_entropy", "B6", union_sql([f"""
SELECT '{c}' AS column_name, CAST(sum(k) AS BIGINT) AS n_values, count(*) AS unique_count,
 round(-sum(k / s * log2(k / s)), 6) AS entropy FROM (SELECT count(*) AS k, CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM part GROUP BY {c}) g"""
    for c in ("p_brand", "p_type")]))
def _(t):
    return census_summary(value_census(t["part"], ["p_brand", "p_type"])).select(
        "column_name", "n_values", "unique_count", F.round("entropy", 6).alias("entropy"))
