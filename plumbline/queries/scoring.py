"""Queries for drift, reconciliation, scores, gates and semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import checks, drift, keys, profile, relate, score, semantics
from plumbline.queries.checking import SETTINGS, TEXT, contacts, re, trimmed
from plumbline.queries.profiling import CONTACTS, LINEITEM, _profile_sql, parsed_sql
from plumbline.queries.registry import issue_sql, matches, query, quote, union_sql

CONTACT_CHECKS = ["invalid_email", "invalid_phone", "invalid_date_format", "implausible_age", "negative_values", "whitespace"]


def issues(t) -> DataFrame:
    """Findings on three tables that the scoring queries start from."""
    a = checks.run_row_checks(t["contacts"], "contacts", SETTINGS, only=CONTACT_CHECKS)
    b = checks.run_row_checks(t["payments"], "payments", SETTINGS, only=["negative_values"])
    return reduce(DataFrame.unionByName, [a, b, keys.duplicate_rows(t["lines_dup"], "lines_dup")])


_BAD_DATE = parsed_sql("trim(signup_date)") + " IS NULL"
ISSUES = "(" + union_sql([
    contacts("invalid_email", "medium", "NOT " + re("{c}", fv.EMAIL), ["email"]),
    contacts("invalid_phone", "medium", "NOT " + re("{c}", fv.PHONE), ["phone"]),
    issue_sql("contacts", "signup_date", "invalid_date_format", "medium", _BAD_DATE),
    contacts("implausible_age", "high", "{c} < 0 OR {c} > 150", ["age"]),
    contacts("negative_values", "medium", "{c} < 0", ["age", "interest_rate", "amount"]),
    contacts("whitespace", "low", re("{c}", fv.OUTER_SPACE) + " OR {t} = ''", TEXT),
    issue_sql("payments", "quantity", "negative_values", "medium", "quantity < 0"),
    issue_sql("payments", "amount", "negative_values", "medium", "amount < 0"),
    """SELECT 'lines_dup', '[row]', 'duplicate_rows', 'medium', CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT), CAST(sum(k) AS BIGINT),
 round(sum(CASE WHEN k > 1 THEN k ELSE 0 END) / CAST(sum(k) AS DOUBLE), 6) FROM (SELECT count(*) AS k FROM lines_dup GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipmode_x) g""",
]) + ") AS issues"
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_POINTS = "CASE severity WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END"


@query("assess_lineitem_issues", "A7 B2 C1 C11 C27 G2", union_sql([
    issue_sql("lineitem", c, "suspicious_zero", "medium", f"{c} = 0") for c in ("l_orderkey", "l_partkey", "l_suppkey")] + [
    issue_sql("lineitem", c, "numeric_outliers_iqr", "medium", f"q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))",
              fires="n_checked >= 20 AND n_bad > 0 AND n_bad < 0.3 * n_checked",
              source=f"lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) b")
    for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [
    issue_sql("lineitem", "l_shipdate", "weekend_date_anomaly", "low", "isodow(l_shipdate) >= 6"),
    issue_sql("lineitem", "l_linenumber", "sentinel_numeric_value", "medium", "l_linenumber IN (0, 999, 1111)"),
    issue_sql("lineitem", "l_discount", "sentinel_numeric_value", "medium", "l_discount = 0"),
    issue_sql("lineitem", "l_tax", "sentinel_numeric_value", "medium", "l_tax = 0")]))
def _(t):
    found = checks.run_row_checks(t["lineitem"], "lineitem", SETTINGS, only=[
        "nulls", "negative_values", "suspicious_zero", "weekend_date_anomaly", "sentinel_numeric_value"])
    return found.unionByName(checks.iqr_outliers(t["lineitem"], "lineitem"))


# --- drift ---------------------------------------------------------------------------------------

_EARLY, _LATE = "o_orderdate < TIMESTAMP '1996-06-01'", "o_orderdate >= TIMESTAMP '1996-06-01'"


def _halves(t):
    o = t["orders"]
    before = o.filter("o_orderdate < TIMESTAMP_NTZ '1996-06-01'").drop("o_orderdate")
    after = (
        o.filter("o_orderdate >= TIMESTAMP_NTZ '1996-06-01'").drop("o_orderdate")
        .withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
        .withColumn("o_custkey", F.col("o_custkey").cast("string")).drop("o_orderpriority").withColumn("channel", F.lit("web"))
    )
    return before, after


def _snapshots(t):
    before, after = _halves(t)
    return (drift.snapshot(before, "orders", "r1", "2024-01-01 00:00:00"), drift.snapshot(after, "orders", "r2", "2024-02-01 00:00:00"))


_AFTER = f"(SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, 'web' AS channel FROM orders WHERE {_LATE})"
_BEFORE = f"(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE {_EARLY})"
_SIGNALS = f"""
SELECT 'orders' AS dataset, '' AS column_name, 'row_count' AS kind, CASE WHEN r > 0.3 THEN 'high' ELSE 'medium' END AS severity, round(r, 6) AS detail
FROM (SELECT abs(b.n - a.n) / CAST(a.n AS DOUBLE) AS r FROM (SELECT count(*) AS n FROM {_BEFORE} x) a, (SELECT count(*) AS n FROM {_AFTER} y) b) z WHERE r > 0.15
UNION ALL SELECT 'orders', 'channel', 'column_added', 'high', NULL
UNION ALL SELECT 'orders', 'o_orderpriority', 'column_removed', 'high', NULL
UNION ALL SELECT 'orders', 'o_custkey', 'dtype_changed', 'medium', NULL
UNION ALL SELECT 'orders', 'o_totalprice', 'null_rate', 'medium', round(d, 6) FROM (SELECT round(count(*) FILTER (WHERE o_totalprice IS NULL) / CAST(count(*) AS DOUBLE), 6) AS d FROM {_AFTER} y) q WHERE d > 0.08
""" + " ".join(f"""UNION ALL SELECT 'orders', '{c}', 'distinct_count', 'low', round(r, 6) FROM (SELECT a.u, abs(b.u - a.u) / CAST(a.u AS DOUBLE) AS r FROM
 (SELECT count(DISTINCT {c}) AS u FROM {_BEFORE} x) a, (SELECT count(DISTINCT {c}) AS u FROM {_AFTER} y) b) z WHERE u > 10 AND r > 0.25
""" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))


@query("drift_snapshot_signals", "F2 F3 F4 F5 E10", _SIGNALS)
def _(t):
    return drift.compare_snapshots(*_snapshots(t))


@query("drift_rollup", "F6", f"""
SELECT CAST(greatest(0, 100 - CASE worst WHEN 3 THEN 35 WHEN 2 THEN 18 WHEN 1 THEN 8 ELSE 0 END - least(20, 2 * n)) AS BIGINT) AS drift_score,
 CASE worst WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS worst_severity, n AS total_signal_count
FROM (SELECT max({_RANK}) AS worst, count(*) AS n FROM ({_SIGNALS}) s) x""")
def _(t):
    return drift.drift_score(drift.compare_snapshots(*_snapshots(t)))


@query("drift_by_dataset", "F6", f"""
SELECT dataset, CASE max({_RANK}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS signal_count FROM ({_SIGNALS}) s GROUP BY dataset""")
def _(t):
    return drift.drift_by_dataset(drift.compare_snapshots(*_snapshots(t)))


@query("drift_latest_snapshot", "F1", f"""
SELECT dataset, 'r2' AS run_id, column_name, row_count, null_pct, unique_count FROM ({_profile_sql('lineitem', LINEITEM)}) p""")
def _(t):
    whole = t["lineitem"]
    half = whole.filter(F.col("l_linestatus") == "F")
    history = drift.snapshot(half, "lineitem", "r1", "2024-01-01 00:00:00").unionByName(
        drift.snapshot(whole, "lineitem", "r2", "2024-02-01 00:00:00"))
    return drift.latest_snapshot(history).select("dataset", "run_id", "column_name", "row_count", "null_pct", "unique_count")


@query("drift_schema_changes", "E10", """
SELECT 'orders' AS dataset, c AS column_name, a AS dtype_before, b AS dtype_after, k AS change FROM (VALUES
 ('channel', NULL, 'string', 'added'), ('o_orderpriority', 'string', NULL, 'removed'), ('o_custkey', 'bigint', 'string', 'type_changed')) v(c, a, b, k)
WHERE (SELECT count(*) FROM orders) > 0""")
def _(t):
    before, after = _halves(t)
    drifted = relate.schema_drift(relate.schema_frame(before, "orders"), relate.schema_frame(after, "orders"))
    live = t["orders"].agg(F.count(F.lit(1)).alias("n")).filter("n > 0").drop("n")
    return drifted.crossJoin(F.broadcast(live))


_STAGES = """SELECT count(*) AS source, count(*) FILTER (WHERE TRY_CAST(score_text AS DOUBLE) IS NOT NULL) AS parsed,
 count(*) FILTER (WHERE TRY_CAST(score_text AS DOUBLE) IS NULL) AS parse_failed,
 count(*) FILTER (WHERE TRY_CAST(score_text AS DOUBLE) IS NOT NULL AND age < 0) AS filtered,
 count(*) FILTER (WHERE TRY_CAST(score_text AS DOUBLE) IS NOT NULL AND age >= 0) AS written FROM contacts"""


def _stage_flags():
    ok = F.col("score_text").try_cast("double").isNotNull()
    return {"source": F.lit(True), "parsed": ok, "parse_failed": ~ok, "filtered": ok & (F.col("age") < 0), "written": ok & (F.col("age") >= 0)}


@query("reconcile_load_stages", "F7 F8", f"""
SELECT 'contacts' AS dataset, source, parsed, parse_failed, filtered, CAST(0 AS BIGINT) AS transformed, written, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS skipped,
 greatest(0, source - parsed) AS parse_delta, greatest(0, source - written) AS write_delta, written <= source AS balanced, 'rows lost while parsing' AS explanation FROM ({_STAGES}) s""")
def _(t):
    return drift.reconcile(drift.stage_counts(t["contacts"], "contacts", _stage_flags()))


@query("reconcile_row_deltas", "F9", """
SELECT 'lineitem' AS dataset, (SELECT count(*) FROM lineitem) AS rows_before, (SELECT count(*) FROM lines_dup) AS rows_after, (SELECT count(*) FROM lines_dup) - (SELECT count(*) FROM lineitem) AS row_delta
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') - (SELECT count(*) FROM orders)""")
def _(t):
    return drift.row_deltas({"lineitem": t["lineitem"], "orders": t["orders"]}, {"lineitem": t["lines_dup"], "orders": t["orders"].filter("o_orderstatus = 'F'")})


_DIFF_AFTER = """(SELECT o_orderkey + CASE WHEN o_orderkey % 40 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, o_custkey, upper(o_orderstatus) AS o_orderstatus,
 CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 50 <> 1)"""


@query("diff_frames", "F10", f"""
SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM {_DIFF_AFTER} a) AS rows_after, (SELECT count(*) FROM {_DIFF_AFTER} a) - (SELECT count(*) FROM orders) AS row_delta,
 (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_DIFF_AFTER} a)) AS lost_keys,
 (SELECT count(*) FROM {_DIFF_AFTER} a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS new_keys,
 (SELECT count(*) FROM orders o JOIN {_DIFF_AFTER} a ON o.o_orderkey = a.o_orderkey) AS kept_keys,
 (SELECT count(*) FROM orders o JOIN {_DIFF_AFTER} a ON o.o_orderkey = a.o_orderkey WHERE o.o_totalprice <> a.o_totalprice) AS changed_keys,
 '' AS added_columns, 'o_orderdate,o_orderpriority' AS removed_columns, '' AS retyped_columns""")
def _(t):
    o = t["orders"]
    after = o.filter("o_orderkey % 50 <> 1").select(
        (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 40 == 0, 10000000).otherwise(0)).alias("o_orderkey"), "o_custkey",
        F.upper("o_orderstatus").alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 9 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return drift.frame_diff(o, after, ["o_orderkey"])


@query("preview_sql_statement", "F11", """
SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def _(t):
    return drift.sql_preview({"orders": t["orders"], "customer": t["customer"]}, """
        SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment;""", sample_rows=None, limit=None)


@query("preview_step_impact", "F12", """
SELECT step, CAST(n AS BIGINT) AS affected_rows, total AS total_rows, round(n / CAST(total AS DOUBLE), 6) AS pct FROM (SELECT count(*) AS total,
 count(*) FILTER (WHERE full_name <> trim(full_name)) AS a, count(*) FILTER (WHERE email IS NULL) AS b, count(*) FILTER (WHERE amount < 0) AS c FROM contacts) x,
 LATERAL (VALUES ('trim_name', a), ('fill_email', b), ('clip_amount', c)) v(step, n)""")
def _(t):
    return drift.step_impact(t["contacts"], {
        "trim_name": F.col("full_name") != F.trim("full_name"), "fill_email": F.col("email").isNull(), "clip_amount": F.col("amount") < 0})


# --- scores --------------------------------------------------------------------------------------

_HIGH = "coalesce(age < 0 OR age > 150, FALSE)"
_MEDIUM = (f"coalesce(NOT {matches('email', fv.EMAIL)}, FALSE) OR coalesce(NOT {matches('phone', fv.PHONE)}, FALSE) OR (signup_date IS NOT NULL AND {_BAD_DATE}) "
           "OR coalesce(age < 0, FALSE) OR coalesce(interest_rate < 0, FALSE) OR coalesce(amount < 0, FALSE)")
_LOW = " OR ".join(f"coalesce({matches(c, fv.OUTER_SPACE)} OR {trimmed(c)} = '', FALSE)" for c in TEXT)
_SCORES = f"""SELECT 'contacts' AS dataset, n AS row_count, h AS high_rows, m AS medium_rows, l AS low_rows,
 round(100.0 * greatest(0.0, 1.0 - (3.0 * h / n + 1.0 * m / n + 0.3 * l / n) / 4.3), 6) AS dq_score, n - h AS clean_rows_after_high, n - h - m AS clean_rows_after_high_and_medium FROM (
 SELECT CAST(count(*) AS DOUBLE) AS nd, count(*) AS n, count(*) FILTER (WHERE hi) AS h, count(*) FILTER (WHERE me AND NOT hi) AS m, count(*) FILTER (WHERE lo AND NOT me AND NOT hi) AS l
 FROM (SELECT {_HIGH} AS hi, ({_MEDIUM}) AS me, ({_LOW}) AS lo FROM contacts) f) c"""


def _score(t):
    flags = checks.row_level_flags(t["contacts"], SETTINGS, CONTACT_CHECKS)
    return score.quality_score(t["contacts"], "contacts", flags)


@query("score_quality", "G1", _SCORES)
def _(t):
    return _score(t)


@query("score_scorecard", "G6", f"""
SELECT dataset, dq_score, CASE WHEN dq_score >= 70 THEN 'READY' WHEN dq_score >= 35 THEN 'NEEDS_WORK' ELSE 'BLOCKED' END AS status,
 round(100.0 * clean_rows_after_high_and_medium / row_count, 2) AS clean_pct, round(dq_score, 2) AS overall_score FROM ({_SCORES}) s""")
def _(t):
    return score.scorecard(_score(t))


@query("score_severity_counts", "G2", f"""
SELECT dataset, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
 count(*) AS issue_count FROM {ISSUES} GROUP BY dataset""")
def _(t):
    return score.severity_counts(issues(t))


_GATE = f"""SELECT dataset, round(0.3 * ns + 0.3 * ts + 0.2 * ds + 0.2 * os - CASE WHEN ns < 10 THEN 15 ELSE 0 END, 2) AS score, round(ns, 2) AS null_score, ts AS type_score, ds AS duplicate_score, os AS outlier_score FROM (
 SELECT n.dataset, greatest(0.0, 100.0 * pow(1.0 - a, 2)) AS ns, CAST(greatest(0.0, 100.0 - 10.0 * coalesce(ty, 0)) AS DOUBLE) AS ts, CAST(greatest(0.0, 100.0 - 5.0 * coalesce(du, 0)) AS DOUBLE) AS ds,
  CAST(greatest(0.0, 100.0 - 10.0 * coalesce(ou, 0)) AS DOUBLE) AS os FROM (SELECT dataset, avg(null_pct) AS a FROM ({_profile_sql('contacts', CONTACTS)}) p GROUP BY dataset) n LEFT JOIN (
  SELECT dataset, count(*) FILTER (WHERE issue_type IN ('type_mismatch', 'invalid_date_format', 'invalid_email', 'invalid_phone')) AS ty,
   count(*) FILTER (WHERE contains(issue_type, 'dup')) AS du, count(*) FILTER (WHERE contains(issue_type, 'outlier')) AS ou FROM {ISSUES} GROUP BY dataset) i ON i.dataset = n.dataset) x"""


def _null_profile(t):
    m = profile.base_metrics(t["contacts"], "contacts")
    return m.withColumn("null_pct", F.round(F.col("null_count") / F.col("row_count"), 6))


@query("gate_scores", "G3", _GATE)
def _(t):
    return score.gate_score(issues(t), _null_profile(t))


@query("gate_decision", "G4", f"""
SELECT dataset, score, null_score, type_score, duplicate_score, outlier_score, TRUE AS has_high_pii, CAST(85 AS DOUBLE) AS threshold, score >= 85 AS passed, FALSE AS force_unlocked FROM ({_GATE}) g""")
def _(t):
    described = semantics.describe(profile.value_shares(t["contacts"], "contacts"))
    return score.gate(score.gate_score(issues(t), _null_profile(t)), described)


@query("readiness_grade", "G5", f"""
SELECT CAST(greatest(0, 100 - p) AS BIGINT) AS score, CASE WHEN p <= 10 THEN 'A' WHEN p <= 25 THEN 'B' WHEN p <= 50 THEN 'C' ELSE 'F' END AS grade, blockers, warnings, auto_fixable,
 CASE WHEN blockers = 0 THEN 'ready' ELSE 'fix_blockers' END AS recommendation FROM (SELECT sum(pts) AS p, count(*) FILTER (WHERE b = 1) AS blockers, count(*) FILTER (WHERE b = 2) AS warnings, count(*) FILTER (WHERE b = 3) AS auto_fixable FROM (
 SELECT CASE WHEN severity = 'high' THEN 1 WHEN severity = 'medium' THEN 2 ELSE 3 END AS b, CASE WHEN severity = 'high' THEN 15 WHEN severity = 'medium' THEN 8 ELSE 2 END AS pts FROM {ISSUES} WHERE dataset = 'payments'
 UNION ALL SELECT 1, 15 FROM (SELECT count(*) AS n FROM orders_fk WHERE cust_id NOT IN (SELECT c_custkey FROM customer)) o WHERE n > 0
 UNION ALL SELECT 2, 5 FROM (SELECT count(*) AS n FROM payments) q WHERE n > 0) f) z""")
def _(t):
    found = issues(t).filter("dataset = 'payments'")
    orphans = relate.orphan_issue(t["orders_fk"], t["customer"], "orders_fk", "cust_id", "c_custkey")
    drifted = t["payments"].agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("payments").alias("dataset"), F.lit("medium").alias("severity"))
    return score.readiness(found, orphans=orphans, drift=drifted)


@query("verdicts_by_column", "G7", f"""
SELECT dataset, column_name, 'completeness' AS dimension, CASE WHEN 1.0 - null_pct >= 0.95 THEN 'PASS' WHEN 1.0 - null_pct >= 0.80 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM ({_profile_sql('contacts', CONTACTS)}) p""")
def _(t):
    p = profile.column_profile(t["contacts"], "contacts")
    kinds = profile.semantic_types(profile.value_shares(t["contacts"], "contacts"))
    return score.dimension_verdicts(p, issues(t), kinds).filter("dimension = 'completeness'")


@query("verdicts_rollup", "G7")
def _(t):
    p = profile.column_profile(t["contacts"], "contacts")
    kinds = profile.semantic_types(profile.value_shares(t["contacts"], "contacts"))
    return score.verdict_rollup(score.dimension_verdicts(p, issues(t), kinds))


@query("summary_executive", "G8", f"""
SELECT issue_type, column_name, CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, d AS datasets_affected, CAST(b AS BIGINT) AS rows_affected,
 r * (1.0 + least(3.0, d / 2.0)) AS score FROM (SELECT issue_type, column_name, max({_RANK}) AS r, count(DISTINCT dataset) AS d, sum(n_bad) AS b FROM {ISSUES} GROUP BY 1, 2) x
ORDER BY score DESC, d DESC, b DESC, issue_type, column_name""".replace("least(3.0, d / 2.0)", "least(CAST(3 AS DOUBLE), d / 2.0)"))
def _(t):
    return score.executive_summary(issues(t))


@query("summary_column_risk", "G9", f"""
SELECT column_name, CAST(sum({_POINTS}) AS BIGINT) AS risk_score, string_agg(DISTINCT issue_type, ',' ORDER BY issue_type) AS issue_types FROM {ISSUES}
GROUP BY column_name ORDER BY risk_score DESC, column_name""")
def _(t):
    return score.column_risk(issues(t))


@query("summary_triage", "G10", f"""
SELECT dataset, risk_score, issue_count, CASE WHEN risk_score = 0 THEN 'READY' WHEN risk_score <= 10 THEN 'NEEDS_WORK' ELSE 'BLOCKED' END AS status,
 CAST(row_number() OVER (ORDER BY risk_score, dataset) AS INTEGER) AS load_order FROM (SELECT d.dataset, coalesce(r, 0) AS risk_score, coalesce(c, 0) AS issue_count FROM (
 SELECT unnest(['contacts', 'payments', 'lines_dup', 'region']) AS dataset) d LEFT JOIN (SELECT dataset, CAST(sum({_POINTS}) AS BIGINT) AS r, count(*) AS c FROM {ISSUES} GROUP BY 1) i ON i.dataset = d.dataset) x""")
def _(t):
    return score.triage(issues(t), ["contacts", "payments", "lines_dup", "region"])


@query("summary_review_burden", "G11", f"""
SELECT dataset, count(*) AS issues, count(*) FILTER (WHERE issue_type NOT IN ('whitespace')) AS manual_review,
 count(*) FILTER (WHERE regexp_matches(issue_type, 'format|type|schema|key|range')) AS source_system, count(*) FILTER (WHERE regexp_matches(issue_type, 'email|phone|duplicate|null|missing')) AS user_entry,
 CAST(floor(100 * count(*) FILTER (WHERE issue_type NOT IN ('whitespace')) / count(*)) AS BIGINT) AS manual_pct FROM {ISSUES} GROUP BY dataset""")
def _(t):
    return score.review_burden(issues(t))


@query("summary_issue_slice", "G12", f"""
SELECT dataset, column_name, issue_type, n_bad FROM {ISSUES} WHERE contains(issue_type, 'email') OR contains(lower(column_name), 'email')""")
def _(t):
    return score.issues_of_family(issues(t), "email").select("dataset", "column_name", "issue_type", "n_bad")


_ACTION = """CASE issue_type WHEN 'whitespace' THEN 'trim' WHEN 'invalid_email' THEN 'sanitize_email' WHEN 'invalid_phone' THEN 'normalize_phone' WHEN 'invalid_date_format' THEN 'parse_dates'
 WHEN 'negative_values' THEN 'clip_or_flag' WHEN 'duplicate_rows' THEN 'deduplicate' ELSE 'review_manually' END"""


@query("summary_cleaning_manifest", "G13", f"""
SELECT dataset, column_name, issue_type, severity, n_bad, {_ACTION} AS suggested_action, CASE issue_type WHEN 'whitespace' THEN 'FIXABLE' WHEN 'invalid_email' THEN 'NOT_FIXABLE' ELSE 'COMPLEX' END AS fixability,
 CAST(4 - {_RANK} AS INTEGER) AS sort_order FROM {ISSUES}""")
def _(t):
    return score.cleaning_manifest(issues(t))


@query("summary_unified_issues", "G14", f"""
SELECT 'checks' AS source, dataset, column_name, severity, CASE WHEN column_name = 'email' THEN 'high' ELSE 'medium' END AS business_criticality, CASE WHEN column_name = 'email' THEN 'P2' ELSE 'P3' END AS fix_priority,
 'cleaning_or_validation' AS etl_impact, issue_type AS message FROM {ISSUES}
UNION ALL SELECT 'drift', dataset, column_name, severity, 'medium', 'P2', 'monitoring', kind FROM ({_SIGNALS}) s""")
def _(t):
    found = issues(t)
    critical = found.filter("column_name = 'email'").select("dataset", "column_name")
    balanced = drift.reconcile(drift.stage_counts(t["contacts"], "contacts", _stage_flags()))
    return score.unified_issues(found, critical, drift.compare_snapshots(*_snapshots(t)), balanced)


@query("summary_suggested_actions", "G15", f"SELECT dataset, column_name, issue_type, {_ACTION} AS action FROM {ISSUES}")
def _(t):
    return score.suggest_actions(issues(t))


# --- semantics -----------------------------------------------------------------------------------

_DESCRIBED = ["email", "phone", "account_uuid", "website_url", "zip", "city", "age", "interest_rate", "status", "amount", "cust_id"]


@query("semantic_descriptors", "B16", """
SELECT 'contacts' AS dataset, c AS column_name, s AS semantic_type, u AS sub_type, p AS pii_level, f AS fill_strategy, k AS confidence FROM (VALUES
 ('email', 'id', 'email', 'high', 'flag', 0.9::DOUBLE), ('phone', 'id', 'phone', 'high', 'flag', 0.9), ('account_uuid', 'id', 'fk', 'none', 'flag', 0.9), ('website_url', 'string', 'url', 'none', 'flag', 0.9),
 ('zip', 'id', 'zip_code', 'medium', 'fill_mode', 0.9), ('city', 'string', 'unknown', 'none', 'fill_mode', 0.5), ('age', 'metric', 'age', 'low', 'fill_median', 0.7),
 ('interest_rate', 'metric', 'percentage', 'none', 'fill_zero', 0.7), ('status', 'categorical', 'status_flag', 'none', 'fill_mode', 0.7), ('amount', 'metric', 'currency', 'none', 'fill_zero', 0.7),
 ('cust_id', 'metric', 'unknown', 'none', 'fill_zero', 0.5)) v(c, s, u, p, f, k)
WHERE CASE c WHEN 'email' THEN (SELECT avg(CAST(""" + matches("trim(email)", fv.EMAIL) + """ AS INT)) >= 0.5 FROM contacts)
 WHEN 'website_url' THEN (SELECT avg(CAST(regexp_matches(lower(trim(website_url)), '^https?://') AS INT)) >= 0.6 FROM contacts)
 WHEN 'account_uuid' THEN (SELECT avg(CAST(""" + matches("account_uuid", fv.UUID_ANY) + """ AS INT)) >= 0.7 FROM contacts) ELSE TRUE END""")
def _(t):
    shares = profile.value_shares(t["contacts"], "contacts", _DESCRIBED)
    return semantics.describe(shares).select("dataset", "column_name", "semantic_type", "sub_type", "pii_level", "fill_strategy", "confidence")


@query("semantic_tags", "B17", """
SELECT 'contacts' AS dataset, c AS column_name, g AS tag FROM (VALUES ('email', 'id'), ('phone', 'id'), ('signup_date', 'date'), ('status', 'categorical'), ('amount', 'metric'), ('full_name', 'text'), ('cust_id', 'id'), ('city', 'categorical')) v(c, g)
WHERE (SELECT count(*) FROM contacts) > 0""")
def _(t):
    return semantics.column_tags(profile.value_shares(t["contacts"], "contacts", ["email", "phone", "signup_date", "status", "amount", "full_name", "cust_id", "city"]))


@query("semantic_importance", "B18", """
SELECT 'contacts' AS dataset, c AS column_name, CASE WHEN u = n OR c = 'cust_id' THEN 'high' WHEN c = 'amount' THEN 'medium' WHEN c = 'status' THEN 'high' ELSE 'low' END AS importance, c = 'cust_id' AND u = n AS likely_key FROM (
 SELECT 'cust_id' AS c, count(DISTINCT cust_id) AS u, count(*) AS n FROM contacts UNION ALL SELECT 'amount', count(DISTINCT amount), count(*) FROM contacts
 UNION ALL SELECT 'status', count(DISTINCT status), count(*) FROM contacts UNION ALL SELECT 'city', count(DISTINCT city), count(*) FROM contacts) x""")
def _(t):
    cols = ["cust_id", "amount", "status", "city"]
    described = semantics.describe(profile.value_shares(t["contacts"], "contacts", cols))
    manifest = t.spark.createDataFrame([("contacts", "status", "high")], "dataset string, column_name string, importance string")
    return semantics.column_importance(profile.column_profile(t["contacts"], "contacts", cols), described, manifest).drop("confidence")


@query("semantic_manifest_gaps", "B19", """
SELECT 'contacts' AS dataset, 'tax_code' AS column_name, 'missing_column' AS problem, (SELECT count(*) FROM contacts) AS row_count""")
def _(t):
    gaps = semantics.manifest_gaps(t["contacts"], "contacts", ["cust_id"], ["cust_id", "email", "tax_code"])
    return gaps.crossJoin(F.broadcast(t["contacts"].agg(F.count(F.lit(1)).alias("row_count"))))
