"""Queries for user rules and cross-table relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import relate, rules
from plumbline.queries.registry import issue_sql, matches, query, union_sql


def rule_query(name, items, table, rule, sql):
    @query(name, items, sql)
    def _(t):
        return rules.apply_rules(t[table], table, rule)


rule_query("rule_valid_values", "D1", "shipments", [{"type": "valid_values", "values": {"dbo.shipments.status": ["F", "o"], "other.priority": ["x"]}}],
           issue_sql("shipments", "status", "invalid_lookup_value", "medium", "lower(status) NOT IN ('f', 'o')"))
rule_query("rule_custom_assertion", "D2", "shipments", [{"type": "assertion", "assertion": "refund_amount > 1000 OR status = 'P'"}],
           issue_sql("shipments", "refund_amount,status", "custom_rule_violation", "medium", "NOT coalesce(refund_amount > 1000 OR status = 'P', FALSE)", "TRUE"))
rule_query("rule_formula", "D3", "payments", [{"type": "formula", "assertion": "total_amount = amount * quantity", "severity": "high"}],
           issue_sql("payments", "quantity,amount,total_amount", "formula_rule_violation", "high", "total_amount <> amount * quantity", "TRUE"))
rule_query("rule_conditional_not_null", "D4", "shipments",
           [{"type": "conditional_not_null", "when_column": "status", "when_value": "F", "then_column": "refund_amount"}],
           issue_sql("shipments", "refund_amount", "conditional_not_null", "medium", "status = 'F' AND refund_amount IS NULL", "status = 'F'"))
rule_query("rule_conditional_range", "D5", "shipments",
           [{"type": "conditional_range", "when_column": "status", "when_value": "O", "then_column": "total", "min": 5000, "max": 300000}],
           issue_sql("shipments", "total", "conditional_range", "medium", "status = 'O' AND (total < 5000 OR total > 300000)", "status = 'O'"))
rule_query("rule_exclusive_columns", "D6", "shipments",
           [{"type": "mutual_exclusion", "columns": ["refund_amount", "discount_amount"]}, {"type": "at_least_one", "columns": ["refund_amount", "discount_amount"]}],
           union_sql([issue_sql("shipments", "refund_amount,discount_amount", "mutual_exclusion", "medium", "refund_amount IS NOT NULL AND discount_amount IS NOT NULL", "TRUE"),
                      issue_sql("shipments", "refund_amount,discount_amount", "at_least_one", "medium", "refund_amount IS NULL AND discount_amount IS NULL", "TRUE")]))
rule_query("rule_custom_patterns", "D7", "contacts", [
    {"type": "one_of", "dataset": "cont*", "column": "status", "params": ["Active", "Closed"]},
    {"type": "not_one_of", "column": "city", "params": ["Elsewhere"]},
    {"type": "range", "column": "amount", "params": {"min": 0, "max": 9000}},
    {"type": "regex", "column": "account_code", "params": "^A[0-9]+$"},
    {"type": "not_null", "column": "full_name"},
    {"type": "not_null", "dataset": "other*", "column": "city"}],
    union_sql([issue_sql("contacts", "status", "custom_one_of", "medium", "status NOT IN ('Active', 'Closed')"),
               issue_sql("contacts", "city", "custom_not_one_of", "medium", "city = 'Elsewhere'"),
               issue_sql("contacts", "amount", "custom_range", "medium", "amount < 0 OR amount > 9000"),
               issue_sql("contacts", "account_code", "custom_regex", "medium", "NOT " + matches("account_code", "^A[0-9]+$")),
               issue_sql("contacts", "full_name", "custom_not_null", "medium", "full_name IS NULL OR trim(full_name) = ''", "TRUE")]))
rule_query("rule_domain_bounds", "D8", "contacts", [{"type": "domain", "column": "age", "min": 18, "max": 80}, {"type": "domain", "column": "amount", "min": 1}],
           union_sql([issue_sql("contacts", "age", "out_of_range", "medium", "age < 18 OR age > 80"),
                      issue_sql("contacts", "amount", "out_of_range", "medium", "amount < 1")]))
rule_query("rule_cross_fields", "D9 D10 D11", "shipments", [
    {"type": "date_order", "start": "order_date", "end": "ship_date"}, {"type": "non_negative", "column": "total"},
    {"type": "allowed_pairs", "left": "status", "right": "priority", "pairs": {"F": ["1-URGENT", "2-HIGH"], "*": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}}],
    union_sql([issue_sql("shipments", "order_date,ship_date", "cross_field_date_order", "medium", "ship_date < order_date", "ship_date IS NOT NULL AND order_date IS NOT NULL"),
               issue_sql("shipments", "total", "cross_field_non_negative", "medium", "total < 0"),
               issue_sql("shipments", "status,priority", "cross_field_allowed_pairs", "medium",
                         "(status = 'F' AND priority NOT IN ('1-URGENT', '2-HIGH')) OR (status <> 'F' AND priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))",
                         "status IS NOT NULL AND priority IS NOT NULL")]))
rule_query("rule_required_columns", "D12", "shipments", [{"type": "required_columns", "columns": ["order_id", "carrier"]}, {"type": "non_nullable", "columns": ["order_id", "refund_amount"]}],
           union_sql([issue_sql("shipments", "carrier", "missing_required_column", "high", "TRUE", "TRUE"),
                      issue_sql("shipments", "order_id", "non_nullable_has_nulls", "high", "order_id IS NULL", "TRUE"),
                      issue_sql("shipments", "refund_amount", "non_nullable_has_nulls", "high", "refund_amount IS NULL", "TRUE")]))


@query("rule_all_null_columns", "D12", issue_sql("events", "blank", "all_null_column", "high", "TRUE", "TRUE"))
def _(t):
    return rules.all_null_columns(t["events"].withColumn("blank", F.lit(None).cast("string")), "events", ["blank", "value"])


@query("rule_lookup_table", "D1", issue_sql("orders_fk", "cust_id", "invalid_lookup_value", "medium", "cust_id NOT IN (SELECT c_custkey FROM customer)"))
def _(t):
    return rules.lookup_issues(t["orders_fk"], "orders_fk", "cust_id", t["customer"].select(F.col("c_custkey").cast("string").alias("v")))


@query("rule_role_domain", "D1", issue_sql("conversations", "role", "invalid_lookup_value", "medium", "role NOT IN ('user')"))
def _(t):
    return rules.apply_rules(t["conversations"], "conversations", [{"type": "valid_values", "values": {"role": ["user"]}}])


@query("rule_mining", "D13", """
SELECT 'customer' AS dataset, 'non_nullable' AS rule_type, c AS column_name, '' AS detail FROM (
 SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS c) x WHERE (SELECT count(*) FROM customer WHERE c_name IS NULL OR c_acctbal IS NULL) = 0
UNION ALL SELECT 'customer', 'valid_values', 'c_mktsegment', (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) d)""")
def _(t):
    return rules.mine_rules(t["customer"], "customer")


@query("rule_mining_order", "D13", """
SELECT 'payments' AS dataset, 'assertion' AS rule_type, 'unit_price,total_amount' AS column_name, 'unit_price <= total_amount' AS detail FROM payments
 HAVING count(*) FILTER (WHERE unit_price > total_amount) = 0
UNION ALL SELECT 'payments', 'assertion', 'amount,total_amount', 'amount <= total_amount' FROM payments HAVING count(*) FILTER (WHERE amount > total_amount) = 0""")
def _(t):
    mined = rules.mine_rules(t["payments"], "payments", ordered=[("unit_price", "total_amount"), ("amount", "total_amount")])
    return mined.filter("rule_type = 'assertion'")


@query("rule_violating_rows", "D2 D4", """
SELECT 'shipments' AS dataset, CAST(order_id AS VARCHAR) AS row_key, 'conditional_not_null' AS issue_type, 'refund_amount' AS column_name
FROM shipments WHERE status = 'F' AND refund_amount IS NULL
UNION ALL SELECT 'shipments', CAST(order_id AS VARCHAR), 'out_of_range', 'total' FROM shipments WHERE total > 450000""")
def _(t):
    return rules.rule_violations(t["shipments"], "shipments", [
        {"type": "conditional_not_null", "when_column": "status", "when_value": "F", "then_column": "refund_amount"},
        {"type": "domain", "column": "total", "max": 450000}], ["order_id"])


# --- relationships -----------------------------------------------------------------------------------

RELATED = ("customer", "orders", "nation", "region", "supplier", "lineitem", "part")
KEYS = {"custkey": [("customer", "c_custkey"), ("orders", "o_custkey")], "nationkey": [("customer", "c_nationkey"), ("nation", "n_nationkey"), ("supplier", "s_nationkey")],
        "orderkey": [("lineitem", "l_orderkey"), ("orders", "o_orderkey")], "partkey": [("lineitem", "l_partkey"), ("part", "p_partkey")],
        "regionkey": [("nation", "n_regionkey"), ("region", "r_regionkey")], "suppkey": [("lineitem", "l_suppkey"), ("supplier", "s_suppkey")]}


def related(t):
    return {n: t[n] for n in RELATED}


def _pair_sql():
    parts = []
    for key, members in KEYS.items():
        for x, (ta, ca) in enumerate(members):
            for tb, cb in members[x + 1:]:
                parts.append(f"""SELECT '{key}' AS key_name, '{ta}' AS dataset_a, '{ca}' AS column_name_a, '{tb}' AS dataset_b, '{cb}' AS column_name_b,
 count(*) AS overlap_count, max(a.n) AS max_rows_per_key_a, max(b.n) AS max_rows_per_key_b, CAST(sum(a.n) AS BIGINT) AS matched_rows_a, CAST(sum(b.n) AS BIGINT) AS matched_rows_b,
 (SELECT count(DISTINCT {ca}) FROM {ta}) AS n_keys_a, (SELECT count({ca}) FROM {ta}) AS n_rows_a, (SELECT count(DISTINCT {cb}) FROM {tb}) AS n_keys_b, (SELECT count({cb}) FROM {tb}) AS n_rows_b
 FROM (SELECT {ca} AS k, count(*) AS n FROM {ta} WHERE {ca} IS NOT NULL GROUP BY 1) a JOIN (SELECT {cb} AS k, count(*) AS n FROM {tb} WHERE {cb} IS NOT NULL GROUP BY 1) b ON a.k = b.k""")
    return union_sql(parts)


_CARD = """CASE WHEN max_rows_per_key_a <= 1 AND max_rows_per_key_b <= 1 THEN 'one_to_one' WHEN max_rows_per_key_a <= 1 THEN 'one_to_many'
 WHEN max_rows_per_key_b <= 1 THEN 'many_to_one' ELSE 'many_to_many' END"""
_PARENT = """CASE WHEN n_keys_a = n_rows_a AND n_keys_b < n_rows_b THEN dataset_a WHEN n_keys_b = n_rows_b AND n_keys_a < n_rows_a THEN dataset_b
 WHEN n_keys_a >= 0.995 * n_rows_a AND n_keys_b < 0.97 * n_rows_b THEN dataset_a WHEN n_keys_b >= 0.995 * n_rows_b AND n_keys_a < 0.97 * n_rows_a THEN dataset_b
 WHEN max_rows_per_key_a = 1 AND max_rows_per_key_b > 1 THEN dataset_a WHEN max_rows_per_key_b = 1 AND max_rows_per_key_a > 1 THEN dataset_b END"""
_REL = f"(SELECT *, {_CARD} AS cardinality, {_PARENT} AS parent FROM ({_pair_sql()}) p WHERE overlap_count > 0)"


@query("relate_key_overlaps", "E1 E2 E3", f"""
SELECT key_name, dataset_a, column_name_a, dataset_b, column_name_b, overlap_count, max_rows_per_key_a, max_rows_per_key_b, cardinality, parent FROM {_REL} r""")
def _(t):
    return relate.relationships(related(t)).select("key_name", "dataset_a", "column_name_a", "dataset_b", "column_name_b", "overlap_count",
                                                   "max_rows_per_key_a", "max_rows_per_key_b", "cardinality", "parent")


@query("relate_exact_names", "E1", """
SELECT 'doc_id' AS key_name, 'documents' AS dataset_a, 'labels' AS dataset_b, count(*) AS overlap_count,
 CASE WHEN max(a.n) <= 1 AND max(b.n) <= 1 THEN 'one_to_one' WHEN max(a.n) <= 1 THEN 'one_to_many' ELSE 'many' END AS cardinality
FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) a JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) b USING (doc_id)""")
def _(t):
    return relate.relationships({"documents": t["documents"], "labels": t["labels"]}, strip_prefix=False).select(
        "key_name", "dataset_a", "dataset_b", "overlap_count", "cardinality")


@query("relate_many_to_many", "E6", f"""
SELECT dataset_a, column_name_a, dataset_b, column_name_b, 'medium' AS severity FROM {_REL} r WHERE cardinality = 'many_to_many'""")
def _(t):
    return relate.many_to_many_warnings(relate.relationships(related(t)))


@query("relate_relationship_plan", "E11", f"""
SELECT key_name, dataset_a, dataset_b, cardinality, edge, CASE WHEN edge = 'join' THEN parent END AS parent, CASE WHEN edge = 'join' THEN child END AS child,
 CASE WHEN edge = 'join' THEN orphans END AS orphan_rows, CASE WHEN edge = 'join' THEN CASE WHEN orphans > 0 THEN 'left' ELSE 'inner' END END AS join_type FROM (
 SELECT *, CASE WHEN cardinality = 'many_to_many' THEN 'bridge' WHEN parent IS NULL THEN 'review' ELSE 'join' END AS edge,
  CASE WHEN parent = dataset_a THEN dataset_b WHEN parent = dataset_b THEN dataset_a END AS child,
  CASE WHEN parent = dataset_a THEN n_rows_b - matched_rows_b ELSE n_rows_a - matched_rows_a END AS orphans FROM {_REL} r) x""")
def _(t):
    return relate.relationship_plan(relate.relationships(related(t)))


@query("relate_load_order", "E11", f"""
SELECT d.dataset, coalesce(n, 0) AS n_parents, CAST(row_number() OVER (ORDER BY coalesce(n, 0), d.dataset) AS INTEGER) AS load_order FROM (
 SELECT unnest([{', '.join("'" + x + "'" for x in RELATED)}]) AS dataset) d LEFT JOIN (
 SELECT CASE WHEN parent = dataset_a THEN dataset_b ELSE dataset_a END AS dataset, count(DISTINCT parent) AS n FROM {_REL} r
 WHERE parent IS NOT NULL AND cardinality <> 'many_to_many' GROUP BY 1) c ON c.dataset = d.dataset""")
def _(t):
    return relate.load_order(relate.relationship_plan(relate.relationships(related(t))), list(RELATED))


@query("relate_orphan_rows", "E4", """
SELECT order_id, cust_id, order_status FROM orders_fk WHERE cust_id IS NOT NULL AND cust_id NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    return relate.orphan_rows(t["orders_fk"], t["customer"], "cust_id", "c_custkey").select("order_id", "cust_id", "order_status")


@query("relate_orphan_issue", "E4", issue_sql("orders_fk", "cust_id", "orphan_foreign_key_rows", "high", "cust_id NOT IN (SELECT c_custkey FROM customer)"))
def _(t):
    return relate.orphan_issue(t["orders_fk"], t["customer"], "orders_fk", "cust_id", "c_custkey")


@query("relate_orphan_labels", "E4", """
SELECT doc_id AS key_value, count(*) AS n_rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""")
def _(t):
    return relate.orphan_keys(t["documents"], t["labels"], "doc_id", "doc_id")


def _direction(key, a, ca, b, cb):
    inner = f"SELECT DISTINCT CAST({ca} AS VARCHAR) AS v FROM {a} WHERE {ca} IS NOT NULL AND {ca} NOT IN (SELECT {cb} FROM {b} WHERE {cb} IS NOT NULL)"
    return f"""SELECT '{key}' AS key_name, '{a}' AS from_dataset, '{b}' AS to_dataset, count(*) AS n_values,
 (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM ({inner}) i ORDER BY v LIMIT 5) s) AS samples FROM ({inner}) o HAVING count(*) > 0"""


@query("relate_orphan_values", "E5", union_sql([
    _direction("cust_id", "orders_fk", "cust_id", "contacts", "cust_id"), _direction("cust_id", "contacts", "cust_id", "orders_fk", "cust_id"),
    _direction("order_id", "orders_fk", "order_id", "payments", "order_id"), _direction("order_id", "payments", "order_id", "orders_fk", "order_id")]))
def _(t):
    return relate.global_orphan_values({"orders_fk": t["orders_fk"], "contacts": t["contacts"].select("cust_id"), "payments": t["payments"].select("order_id", "quantity")}, strip_prefix=False)


_SAME = """SELECT (SELECT count(*) FROM orders) AS shared_keys, count(*) FILTER (WHERE same) AS equal_rows, CAST(1 AS DOUBLE) AS id_overlap, CAST(0 AS DOUBLE) AS row_diff,
 round(count(*) FILTER (WHERE same) / CAST(count(*) AS DOUBLE), 6) AS equal_share, count(*) FILTER (WHERE same) >= 0.8 * count(*) AS same_records, TRUE AS duplicate_representation
FROM (SELECT o_orderkey % 19 <> 0 OR o_totalprice IS NULL AS same FROM orders) x"""


@query("relate_same_records", "E7 E8", _SAME)
def _(t):
    orders = t["orders"]
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 19 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return relate.same_records(orders, changed, "o_orderkey")


@query("relate_id_type_drift", "E9", """
SELECT 'cust_id' AS key_name, CAST(2 AS BIGINT) AS n_tables, CAST(2 AS BIGINT) AS n_buckets, 'mostly_numeric,mostly_string' AS buckets, 'high' AS severity
WHERE (SELECT count(*) FROM orders_fk) > 0""")
def _(t):
    texts = t["contacts"].select(F.concat(F.lit("C-"), F.col("cust_id").cast("string")).alias("cust_id"))
    return relate.id_type_drift({"orders_fk": t["orders_fk"].select("cust_id"), "contacts": texts}, strip_prefix=False)


@query("relate_merged_issues", "E13", """
SELECT column_name, issue_type, n_bad FROM (""" + union_sql([
    issue_sql("orders_fk", "cust_id", "orphan_foreign_key_rows", "high", "cust_id NOT IN (SELECT c_custkey FROM customer)"),
    issue_sql("orders_fk", "cust_id", "null_foreign_key_rows", "high", "cust_id IS NULL", "TRUE")]) + ") u")
def _(t):
    base = relate.orphan_issue(t["orders_fk"], t["customer"], "orders_fk", "cust_id", "c_custkey")
    nulls = t["orders_fk"].agg(F.count_if(F.col("cust_id").isNull()).alias("n_bad")).select(
        F.lit("orders_fk").alias("dataset"), F.lit("cust_id").alias("column_name"), F.lit("null_foreign_key_rows").alias("issue_type"), "n_bad")
    again = base.select("dataset", "column_name", "issue_type", (F.col("n_bad") * 0).alias("n_bad"))
    return relate.merge_issues(base, nulls.unionByName(again), ["dataset", "column_name", "issue_type"]).select("column_name", "issue_type", "n_bad")


@query("relate_contract_diff", "E14", """
WITH a AS (SELECT lang AS dataset, round(avg(CAST(n_chars > 500 AS INT)), 6) AS confidence FROM documents WHERE lang <> 'en' GROUP BY 1),
 b AS (SELECT lang AS dataset, round(avg(CAST(n_chars > 900 AS INT)), 6) AS confidence FROM documents WHERE lang <> 'fr' GROUP BY 1)
SELECT coalesce(a.dataset, b.dataset) AS dataset, a.confidence AS confidence_a, b.confidence AS confidence_b,
 CASE WHEN a.dataset IS NULL THEN 'added' WHEN b.dataset IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL OUTER JOIN b ON a.dataset = b.dataset""")
def _(t):
    def run(skip, size):
        return t["documents"].filter(F.col("lang") != skip).groupBy(F.col("lang").alias("dataset")).agg(
            F.round(F.avg((F.col("n_chars") > size).cast("int")), 6).alias("confidence"))

    return relate.contract_diff(run("en", 500), run("fr", 900))
