"""Small frames with hand-set counts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, drift, keys, relate, rules, score, similar
from plumbline.operators.checks import Settings

AS_OF = Settings(as_of="2025-01-01 00:00:00")


def frame(spark, column, dtype, values):
    return spark.createDataFrame([(v,) for v in values], f"`{column}` {dtype}")


def found(df):
    return {(r.column_name, r.issue_type): (r.n_bad, r.severity) for r in df.collect()}


ROW_CASES = [
    ("amount", "double", [10.0] * 20 + [10.12345] * 20, "numeric_precision_anomaly", 20, "low", AS_OF),
    ("estimated_amount", "int", [5000] * 40 + [1234] * 20, "round_number_anomaly", 40, "low", AS_OF),
    ("order_date", "string", ["2024-05-0%d" % d for d in range(1, 10)] + ["2025-01-11"], "future_dates", 1, "high", AS_OF),
    ("birth_date", "string", ["2024-01-01"] * 9 + ["1899-12-31"], "ancient_dates", 1, "medium", AS_OF),
    ("payment_date", "string", ["2024-01-01"] * 6 + ["2024-02-15"] * 14, "date_clumping_jan1", 6, "medium", AS_OF),
    ("billing_date", "string", ["2024-01-31"] * 8 + ["2024-02-15"] * 12, "date_clumping_month_end", 8, "low", AS_OF),
    ("order_date", "string", ["2024-01-08"] * 16 + ["2024-01-06"] * 2 + ["2024-01-07"] * 2, "weekend_date_anomaly", 4, "low", AS_OF),
    ("created_date", "string", ["2024-01-01T12:00:00Z"] * 5 + ["2024-01-01T12:00:00"] * 5, "timezone_inconsistency", 5, "medium", AS_OF),
    ("notes", "string", ["fine"] * 9 + ["smile \U0001F600"], "non_ascii_characters", 1, "low", AS_OF),
    ("comments", "string", ["ok"] * 4 + ["bad\x00"], "control_characters_in_text", 1, "medium", AS_OF),
    ("product_desc", "string", ["abc"] * 15 + ["12345"] * 5, "string_with_only_digits_in_text_column", 5, "medium", AS_OF),
    ("customer_name", "string", ["John Smith"] * 9 + ["John John"], "repeated_token_in_string", 1, "low", AS_OF),
    ("user_age", "int", [25] * 8 + [-5, 200], "implausible_age", 2, "high", AS_OF),
    ("interest_rate", "int", [50] * 8 + [-10, 150], "implausible_percentage", 2, "medium", AS_OF),
    ("nullable_col", "string", ["val1", None, "val2"], "nulls", 1, "low", AS_OF),
]


@pytest.mark.parametrize("column,dtype,values,issue,count,severity,settings", ROW_CASES, ids=[c[3] for c in ROW_CASES])
def test_row_checks(spark, column, dtype, values, issue, count, severity, settings):
    got = found(checks.run_row_checks(frame(spark, column, dtype, values), "t", settings, only=[issue]))
    assert got == {(column, issue): (count, severity)}


def test_percent_age_is_no_age(spark):
    df = frame(spark, "percentage", "int", [500] * 10)
    assert found(checks.run_row_checks(df, "t", only=["implausible_age"])) == {}


def test_iqr(spark):
    values = [10.0] * 50 + [12.0] * 45 + [100.0] * 5
    assert found(checks.iqr_outliers(frame(spark, "amount", "double", values), "t")) == {("amount", "numeric_outliers_iqr"): (5, "medium")}
    assert found(checks.iqr_outliers(frame(spark, "order_id", "double", values).withColumn("x", F.lit(1.0)), "t")) == {}


def test_zscore_and_low_variance(spark):
    z = checks.zscore_outliers(frame(spark, "amount", "double", [10.0] * 98 + [100000.0] * 2), "t")
    assert found(z) == {("amount", "numeric_outliers_zscore"): (2, "high")}
    low = checks.run_census_checks(frame(spark, "status_code_num", "double", [5.0] * 99 + [10.0]), "t", only=["low_variance_numeric"])
    assert found(low) == {("status_code_num", "low_variance_numeric"): (99, "low")}


def test_wide_span_and_length(spark):
    assert ("event_date", "very_wide_date_span") in found(
        checks.wide_date_spans(frame(spark, "event_date", "string", ["1940-01-01"] + ["2020-01-01"] * 9), "t"))
    got = found(checks.length_outliers(frame(spark, "description", "string", ["abc"] * 19 + ["x" * 500]), "t"))
    assert got == {("description", "string_length_outlier"): (1, "low")}


def test_case_duplicates(spark):
    df = frame(spark, "status", "string", ["Active"] * 5 + ["active"] * 5)
    got = found(checks.case_findings(df, "t", Settings(semantics={"status": "categorical"})))
    assert got[("status", "duplicate_insensitive_values")] == (1, "low")
    assert got[("status", "case_inconsistency")] == (10, "low")


def test_placeholders_and_sentinels(spark):
    df = frame(spark, "val", "string", ["valid", "custom_null_placeholder", "another_valid", "-9999", None])
    s = Settings(semantics={"val": "numeric_id"}, placeholders=("custom_null_placeholder",), sentinels=(-9999,))
    got = found(checks.run_row_checks(df, "t", s, only=["placeholder_nulls", "sentinel_numeric_value"]))
    assert got == {("val", "nulls"): (1, "low"), ("val", "sentinel_numeric_value"): (1, "medium")}


def test_hardening(spark):
    df = spark.createDataFrame([(" a@b", "two  gaps", "<b>x</b>", "a@b"), ("x@y.z", "fine", "---", "nope"), ("ok@ok.ok", "fine", "???", "x@y.z")],
                               "contact_info string, description string, remarks string, custom_contact string")
    s = Settings(semantics={"custom_contact": "email"})
    got = found(checks.run_row_checks(df, "t", s, only=["whitespace", "internal_whitespace", "html_tags_in_text", "punctuation_only_value", "invalid_email"]))
    assert got == {("contact_info", "whitespace"): (1, "low"), ("description", "internal_whitespace"): (1, "low"),
                   ("remarks", "html_tags_in_text"): (1, "medium"), ("remarks", "punctuation_only_value"): (2, "medium"),
                   ("custom_contact", "invalid_email"): (2, "medium")}


def test_bounds(spark):
    df = spark.createDataFrame([(101, 15.5, 2), (0, -10.0, 5), (103, 20.0, 1)], "order_id int, price double, quantity int")
    got = found(checks.run_row_checks(df, "t", only=["suspicious_zero", "negative_values"]))
    assert got == {("order_id", "suspicious_zero"): (1, "medium"), ("price", "negative_values"): (1, "medium")}


def test_suppression(spark):
    df = spark.createDataFrame([(f"2024-01-0{6 + i % 2}", 1000 * (i + 1)) for i in range(60)], "order_date string, amount int")
    fired = checks.run_row_checks(df, "t", AS_OF, only=["weekend_date_anomaly", "round_number_anomaly"])
    assert fired.count() == 2
    assert checks.suppress(fired, ["weekend_date_anomaly", "round_number_anomaly"]).count() == 0


def test_rules(spark):
    lookup = frame(spark, "dept", "string", ["IT", "HR", "CS", "invalid_dept", "IT", "HR"])
    got = found(rules.apply_rules(lookup, "employees", [{"type": "valid_values", "values": {"dbo.employees.dept": ["it", "HR", "CS"]}}]))
    assert got == {("dept", "invalid_lookup_value"): (1, "medium")}
    ages = spark.createDataFrame([(25, True), (17, False), (30, False), (16, False)], "age int, is_adult boolean")
    got = found(rules.apply_rules(ages, "t", [{"type": "assertion", "assertion": "age < 18 or is_adult = true"}]))
    assert got == {("age,is_adult", "custom_rule_violation"): (1, "medium")}
    sales = spark.createDataFrame([(1, 2.0, 2.0), (2, 3.0, 6.0), (3, 4.0, 13.0), (None, 1.0, 1.0)], "Quantity int, UnitPrice double, TotalAmount double")
    got = found(rules.apply_rules(sales, "t", [{"type": "formula", "assertion": "TotalAmount == Quantity * UnitPrice"}]))
    assert got == {("Quantity,UnitPrice,TotalAmount", "formula_rule_violation"): (1, "medium")}
    got = found(rules.apply_rules(frame(spark, "amount", "double", [1.0, -2.0, 3.0]), "t", [{"type": "non_negative", "column": "amount"}]))
    assert got == {("amount", "cross_field_non_negative"): (1, "medium")}


def test_self_reference(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "OrderID long, ParentOrderID long")
    assert keys.self_reference_candidates(df, ["OrderID"]) == [("OrderID", "ParentOrderID")]
    assert found(keys.intra_dataset_orphans(df, "t", "OrderID", "ParentOrderID")) == {("ParentOrderID", "intra_dataset_orphan_fk"): (1, "high")}
    other = spark.createDataFrame([(1, 7)], "OrderID long, CustomerID long")
    assert keys.self_reference_candidates(other, ["OrderID"]) == []


def test_near_duplicates(spark):
    rows = [("John Smith", "New York"), ("Jon Smith", "New York"), ("Alice Brown", "Paris"), ("Bob Green", "Rome")]
    df = spark.createDataFrame([(i, *rows[i % 4]) for i in range(400)], "id int, name string, city string")
    assert similar.near_duplicate_rows(df, "id", ["name", "city"], 0.85).count() == 400
    one = df.filter("id < 4")
    assert {r.id for r in similar.near_duplicate_rows(one, "id", ["name", "city"], 0.7).collect()} == {0, 1}


def test_drift_score(spark):
    signals = spark.createDataFrame([("t", "medium")], "dataset string, severity string")
    row = drift.drift_score(signals).first()
    assert (row.drift_score, row.worst_severity, row.total_signal_count) == (80, "medium", 1)


def test_reconcile(spark):
    df = spark.range(100)
    row = drift.reconcile(drift.stage_counts(df, "t", {"source": F.lit(True), "parsed": F.lit(True), "parse_failed": F.lit(False), "written": F.lit(True)})).first()
    assert row.balanced and row.source == 100 and row.parse_failed == 0


def test_relationship_plan(spark):
    customers = spark.createDataFrame([(i,) for i in range(95)], "customer_id long")
    orders = spark.createDataFrame([(i % 95,) for i in range(200)], "customer_id long")
    rel = relate.relationships({"customers": customers, "orders": orders}, strip_prefix=False)
    row = relate.relationship_plan(rel).first()
    assert (row.edge, row.parent, row.join_type, row.cardinality) == ("join", "customers", "inner", "one_to_many")
    tags = spark.createDataFrame([(i % 5,) for i in range(40)], "id long")
    products = spark.createDataFrame([(i % 8,) for i in range(40)], "id long")
    assert relate.relationship_plan(relate.relationships({"products": products, "tags": tags}, strip_prefix=False)).first().edge == "bridge"
    assert relate.shared_columns({"products": products, "tags": tags}).count() == 1


def test_schema_findings(spark):
    df = spark.range(3).selectExpr("id", *[f"id AS c{i}" for i in range(201)])
    got = {r.issue_type for r in checks.schema_checks(df, "t").collect()}
    assert got == {"very_wide_table"}
    wide = checks.run_row_checks(df, "t", only=["nulls"])
    assert wide.count() == 0


def test_gate(spark):
    issues = spark.createDataFrame([("t", "x", "invalid_email", "medium", 5, 10, 0.5)], "dataset string, column_name string, issue_type string, severity string, n_bad long, n_checked long, pct double")
    profile = spark.createDataFrame([("t", 0.8)], "dataset string, null_pct double")
    assert not score.gate(score.gate_score(issues, profile), threshold=80).first().passed
    assert score.gate(score.gate_score(issues, profile), threshold=80, force_unlock=True).first().passed
    semantics = spark.createDataFrame([("t", "high")], "dataset string, pii_level string")
    assert score.gate(score.gate_score(issues, profile), semantics, 85).first().threshold == 95.0
