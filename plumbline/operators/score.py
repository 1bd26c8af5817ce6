"""Scores, gates and ranked summaries: small aggregations over issues and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators.checks import Settings, row_level_flags
from plumbline.operators.drift import severity_name, severity_rank

SEVERITIES = ("high", "medium", "low")


def quality_score(df: DataFrame, dataset: str, flags: dict[str, tuple[str, Column]] | None = None,
                  settings: Settings = Settings(), weights: tuple[float, float, float] = (3.0, 1.0, 0.3)) -> DataFrame:
    """Score 0–100 from distinct bad rows, each counted once at its worst severity, in one scan."""
    flags = flags if flags is not None else row_level_flags(df, settings)

    def any_of(severity):
        chosen = [p for s, p in flags.values() if s == severity]
        return reduce(lambda a, b: a | b, chosen, F.lit(False))

    flagged = df.select(*[any_of(s).alias(s) for s in SEVERITIES])
    high, medium, low = F.col("high"), F.col("medium"), F.col("low")
    counts = flagged.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(high).alias("high_rows"),
        F.count_if(medium & ~high).alias("medium_rows"),
        F.count_if(low & ~high & ~medium).alias("low_rows"),
    )
    n = F.greatest(F.col("row_count"), F.lit(1))
    penalty = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"{s}_rows") / n for w, s in zip(weights, SEVERITIES)])
    return counts.select(
        F.lit(dataset).alias("dataset"), "row_count", "high_rows", "medium_rows", "low_rows",
        F.round(100.0 * F.greatest(F.lit(0.0), 1.0 - penalty / sum(weights)), 6).alias("dq_score"),
        (F.col("row_count") - F.col("high_rows")).alias("clean_rows_after_high"),
        (F.col("row_count") - F.col("high_rows") - F.col("medium_rows")).alias("clean_rows_after_high_and_medium"),
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    return (
        issues.groupBy("dataset").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1)))
        .fillna(0, list(SEVERITIES))
        .withColumn("issue_count", F.col("high") + F.col("medium") + F.col("low"))
    )


def gate_score(issues: DataFrame, profile: DataFrame, business_key_duplicates: DataFrame | None = None) -> DataFrame:
    """Weighted gate score per dataset: nulls 30, types 30, duplicates 20, outliers 20."""
    kind = F.col("issue_type")
    counts = issues.groupBy("dataset").agg(
        F.count_if(kind.isin("type_mismatch", "invalid_date_format", "invalid_email", "invalid_phone")).alias("types"),
        F.count_if(F.contains(kind, F.lit("dup"))).alias("dups"),
        F.count_if(F.contains(kind, F.lit("outlier"))).alias("outliers"),
    )
    nulls = profile.groupBy("dataset").agg(F.avg("null_pct").alias("avg_null"))
    j = nulls.join(counts, "dataset", "left").fillna(0, ["types", "dups", "outliers"])
    extra = F.lit(0)
    if business_key_duplicates is not None:
        dup = business_key_duplicates.groupBy("dataset").agg(F.sum("duplicate_count").alias("key_dups"))
        j = j.join(dup, "dataset", "left").fillna(0, ["key_dups"])
        extra = F.col("key_dups")
    zero = F.lit(0.0)
    parts = j.select(
        "dataset",
        F.greatest(zero, 100.0 * F.pow(1.0 - F.col("avg_null"), 2)).alias("null_score"),
        F.greatest(zero, 100.0 - 10.0 * F.col("types")).alias("type_score"),
        F.greatest(zero, 100.0 - 5.0 * (F.col("dups") + extra)).alias("duplicate_score"),
        F.greatest(zero, 100.0 - 10.0 * F.col("outliers")).alias("outlier_score"),
    )
    raw = 0.30 * F.col("null_score") + 0.30 * F.col("type_score") + 0.20 * F.col("duplicate_score") + 0.20 * F.col("outlier_score")
    score = F.when(F.col("null_score") < 10, F.greatest(zero, raw - 15)).otherwise(raw)
    return parts.withColumn("score", F.round(score, 2)).select(
        "dataset", "score", *[F.round(c, 2).alias(c) for c in ("null_score", "type_score", "duplicate_score", "outlier_score")])


def gate(scores: DataFrame, semantics: DataFrame | None = None, threshold: float = 70.0, force_unlock: bool = False) -> DataFrame:
    """Pass or hold a dataset; high-PII datasets need 15 points more, 95 at most."""
    if semantics is not None:
        pii = semantics.filter("pii_level = 'high'").select("dataset", F.lit(True).alias("has_high_pii")).distinct()
        scores = scores.join(F.broadcast(pii), "dataset", "left").fillna(False, ["has_high_pii"])
    else:
        scores = scores.withColumn("has_high_pii", F.lit(False))
    needed = F.when(F.col("has_high_pii"), F.lit(min(threshold + 15.0, 95.0))).otherwise(F.lit(float(threshold)))
    return scores.withColumn("threshold", needed).withColumn(
        "passed", (F.col("score") >= F.col("threshold")) | F.lit(force_unlock)).withColumn("force_unlocked", F.lit(force_unlock))


# Issue types that warn whatever their severity.
ALWAYS_WARN = ("punctuation_only_value", "case_inconsistency", "invalid_email", "invalid_phone", "invalid_date_format")


def readiness(issues: DataFrame, critical_nulls: DataFrame | None = None, key_duplicates: DataFrame | None = None,
              mixed_formats: DataFrame | None = None, drift: DataFrame | None = None, drift_total: DataFrame | None = None,
              reconciliation: DataFrame | None = None, orphans: DataFrame | None = None,
              semantic_confidence: float = 1.0) -> DataFrame:
    """Readiness score, grade and how many blockers, warnings and automatic fixes there are.

    Every optional frame only needs the rows that count: business-critical columns with more than
    30 % nulls, business keys with duplicates, columns with several date formats, drift severity
    per dataset, unbalanced datasets, orphan relations.
    """
    sev, kind = F.col("severity"), F.col("issue_type")
    bucket = F.when(sev == "high", "blocker").when((sev == "medium") | kind.isin(*ALWAYS_WARN), "warning").otherwise("auto_fix")
    points = F.when(bucket == "blocker", 15).when(bucket == "warning", 8).otherwise(2)
    parts = [issues.select("dataset", "column_name", kind.alias("reason"), bucket.alias("bucket"), points.alias("points")).distinct()]

    def add(df, reason, bucket, points, column=None):
        if df is not None:
            parts.append(df.select("dataset", (F.col(column) if column else F.lit("")).alias("column_name"),
                                   F.lit(reason).alias("reason"), F.lit(bucket).alias("bucket"), points.alias("points")))

    add(critical_nulls, "high_null_percentage", "blocker", F.lit(20), "column_name")
    add(key_duplicates, "business_key_duplicate", "blocker", F.lit(15), "business_key")
    add(mixed_formats, "mixed_date_formats", "warning", F.lit(8), "column_name")
    add(orphans, "orphan_foreign_keys", "blocker", F.lit(15), "column_name")
    if drift is not None:
        add(drift.filter("severity IN ('high', 'medium')"), "drift", "warning", F.when(F.col("severity") == "high", 10).otherwise(5))
    if drift_total is not None:
        add(drift_total.filter("drift_score < 72").withColumn("dataset", F.lit("global")), "weak_drift_score", "warning", F.lit(4))
    if reconciliation is not None:
        add(reconciliation.filter(~F.col("balanced")), "reconciliation_imbalance", "blocker", F.lit(12))
    findings = reduce(DataFrame.unionByName, parts)
    if semantic_confidence < 0.55:
        low = issues.sparkSession.createDataFrame([("global", "", "low_semantic_confidence", "warning", 6)], findings.schema)
        findings = findings.unionByName(low)
    total = findings.agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("penalty"),
        F.count_if(F.col("bucket") == "blocker").alias("blockers"),
        F.count_if(F.col("bucket") == "warning").alias("warnings"),
        F.count_if(F.col("bucket") == "auto_fix").alias("auto_fixable"),
    )
    score = 100 - F.col("penalty")
    return total.select(
        F.greatest(F.lit(0), score).cast("long").alias("score"),
        F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 50, "C").otherwise("F").alias("grade"),
        "blockers", "warnings", "auto_fixable",
        F.when(F.col("blockers") == 0, "ready").otherwise("fix_blockers").alias("recommendation"),
    )


def scorecard(scores: DataFrame) -> DataFrame:
    """Status per dataset from its score, and the mean over all datasets."""
    clean = F.round(100.0 * F.try_divide(
        F.greatest(F.lit(0.0), F.least(F.col("row_count").cast("double"), F.col("clean_rows_after_high_and_medium").cast("double"))),
        F.col("row_count").cast("double")), 2)
    overall = scores.agg(F.round(F.avg("dq_score"), 2).alias("overall_score"))
    status = F.when(F.col("dq_score") >= 70, "READY").when(F.col("dq_score") >= 35, "NEEDS_WORK").otherwise("BLOCKED")
    return scores.crossJoin(F.broadcast(overall)).select(
        "dataset", "dq_score", status.alias("status"), clean.alias("clean_pct"), "overall_score")


def dimension_verdicts(profile: DataFrame, issues: DataFrame, semantics: DataFrame) -> DataFrame:
    """PASS / WARN / FAIL per column for completeness, consistency, anomalies and semantics."""
    per = issues.groupBy("dataset", "column_name").agg(
        F.max(F.when(F.col("issue_type") == "duplicate_primary_key", F.col("n_bad"))).alias("dup_count"),
        F.count_if(F.col("issue_type") == "mixed_types").alias("mixed"),
        F.max(F.when(F.contains("issue_type", F.lit("outlier")), F.col("pct"))).alias("outlier_rate"),
        F.max(F.when(F.col("issue_type").isin("invalid_email", "invalid_phone", "invalid_date_format", "invalid_numeric"), F.col("pct"))).alias("invalid_rate"),
    )
    j = profile.join(F.broadcast(per), ["dataset", "column_name"], "left").join(
        F.broadcast(semantics.select("column_name", "semantic_type")), "column_name", "left")
    complete = 1.0 - F.col("null_pct")
    completeness = F.when(complete >= 0.95, "PASS").when(complete >= 0.80, "WARN").otherwise("FAIL")

    def by_count(*conditions):
        k = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])
        return F.when(k == 0, "PASS").when(k == 1, "WARN").otherwise("FAIL")

    consistency = by_count(F.col("mixed") > 0, F.col("dup_count") / F.col("row_count") > 0.10)
    anomalies = by_count(F.col("outlier_rate") > 0.15, F.col("entropy") < 1.0)
    conform = 1.0 - F.col("invalid_rate")
    validity = F.when(conform.isNull(), "UNKNOWN").when(conform < 0.80, "FAIL").when(conform < 0.95, "WARN").otherwise("PASS")
    semantic = F.when(F.col("semantic_type").isNull() | (F.col("semantic_type") == "unknown"), "UNKNOWN").otherwise("PASS")
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("verdict")) for d, v in (
        ("completeness", completeness), ("consistency", consistency), ("validity", validity),
        ("anomalies", anomalies), ("semantic_validity", semantic))])
    return j.select("dataset", "column_name", F.inline(rows))


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """Counts per dimension, and per dataset in the rows without a dimension."""
    return verdicts.rollup("dataset", "dimension").agg(
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("PASS", "WARN", "FAIL", "UNKNOWN")]
    ).filter("dataset IS NOT NULL").withColumn(
        "overall", F.when(F.col("fail") > 0, "FAIL").when(F.col("warn") > 0, "WARN").otherwise("PASS"))


def executive_summary(issues: DataFrame, top: int | None = None) -> DataFrame:
    """Most important signals first: severity weight times spread over datasets; ``top`` makes it a top-k report."""
    roll = issues.groupBy("issue_type", "column_name").agg(
        F.count_distinct("dataset").alias("datasets_affected"), F.sum("n_bad").alias("rows_affected"),
        F.max(severity_rank()).alias("_rank"))
    score = F.greatest(F.col("_rank"), F.lit(1)) * (1.0 + F.least(F.lit(3.0), F.col("datasets_affected") / 2.0))
    return roll.select("issue_type", "column_name", severity_name(F.col("_rank")).alias("severity"), "datasets_affected",
                       "rows_affected", score.alias("score")).orderBy(
        F.desc("score"), F.desc("datasets_affected"), F.desc("rows_affected"), "issue_type", "column_name").transform(_first(top))


def _first(top: int | None):
    return lambda df: df if top is None else df.limit(top)


def risk_points(c: str = "severity") -> Column:
    s = F.upper(c)
    return F.when(s.isin("CRITICAL", "BLOCKER"), 10).when(s == "HIGH", 6).when(s == "MEDIUM", 3).otherwise(1)


def column_risk(issues: DataFrame, top: int | None = None) -> DataFrame:
    return issues.groupBy("column_name").agg(
        F.sum(risk_points()).alias("risk_score"),
        F.array_join(F.array_sort(F.collect_set("issue_type")), ",").alias("issue_types"),
    ).orderBy(F.desc("risk_score"), "column_name").transform(_first(top))


def triage(issues: DataFrame, datasets: list[str]) -> DataFrame:
    """Risk and status per dataset and the order to load them in, cleanest first."""
    names = issues.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    scored = names.join(
        issues.groupBy("dataset").agg(F.sum(risk_points()).alias("risk_score"), F.count(F.lit(1)).alias("issue_count")), "dataset", "left"
    ).fillna(0, ["risk_score", "issue_count"])
    w = Window.partitionBy(F.lit(0)).orderBy("risk_score", "dataset")
    return scored.select(
        "dataset", "risk_score", "issue_count",
        F.when(F.col("risk_score") == 0, "READY").when(F.col("risk_score") <= 10, "NEEDS_WORK").otherwise("BLOCKED").alias("status"),
        F.row_number().over(w).alias("load_order"))


def action_map(spark) -> DataFrame:
    return spark.createDataFrame(list(fv.ISSUE_ACTIONS.items()), "issue_type string, suggested_action string")


def fixability(c: str = "issue_type") -> Column:
    return F.when(F.col(c).isin(*fv.NOT_FIXABLE), "NOT_FIXABLE").when(F.col(c).isin(*fv.FIXABLE), "FIXABLE").otherwise("COMPLEX")


AUTO_ACTIONS = ("trim", "lowercase", "fill_or_drop", "replace_values", "standardize_boolean", "zero_to_null")


def review_burden(issues: DataFrame) -> DataFrame:
    """Findings nobody can repair automatically, and where findings come from."""
    acted = issues.join(F.broadcast(action_map(issues.sparkSession)), "issue_type", "left")
    manual = (fixability() != "FIXABLE") & ~F.coalesce(F.col("suggested_action").isin(*AUTO_ACTIONS), F.lit(False))
    return acted.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(manual).alias("manual_review"),
        F.count_if(F.col("issue_type").rlike("format|type|schema|key|range")).alias("source_system"),
        F.count_if(F.col("issue_type").rlike("email|phone|duplicate|null|missing")).alias("user_entry"),
    ).withColumn("manual_pct", F.floor(100 * F.col("manual_review") / F.col("issues")).cast("long"))


# Issue families used to slice findings.
FAMILIES = {
    "null": "null|empty|missing|placeholder", "duplicate": "dup|near_dup", "email": "email", "phone": "phone",
    "key": "key|orphan|_fk|uuid|_id",
}


def issues_of_family(issues: DataFrame, family: str, column: str | None = None) -> DataFrame:
    hit = F.col("issue_type").rlike(FAMILIES[family])
    if family in ("email", "phone", "key"):
        hit = hit | F.lower("column_name").rlike(FAMILIES[family])
    out = issues.filter(hit)
    return out if column is None else out.filter(F.lower("column_name") == column.lower())


def cleaning_manifest(issues: DataFrame) -> DataFrame:
    """Findings with the suggested action and fixability, worst first."""
    return issues.join(F.broadcast(action_map(issues.sparkSession)), "issue_type", "left").select(
        "dataset", "column_name", "issue_type", "severity", "n_bad",
        F.coalesce("suggested_action", F.lit("review_manually")).alias("suggested_action"),
        fixability().alias("fixability"), (4 - severity_rank()).alias("sort_order"))


def unified_issues(issues: DataFrame, critical_columns: DataFrame | None = None, drift: DataFrame | None = None,
                   reconciliation: DataFrame | None = None) -> DataFrame:
    """Checks, drift signals and unbalanced loads in one list with priority and impact."""
    base = issues
    if critical_columns is not None:
        base = base.join(F.broadcast(critical_columns.select("dataset", "column_name", F.lit(True).alias("_crit")).distinct()),
                         ["dataset", "column_name"], "left")
    else:
        base = base.withColumn("_crit", F.lit(None).cast("boolean"))
    critical = F.coalesce(F.col("_crit"), F.lit(False))
    out = base.select(
        F.lit("checks").alias("source"), "dataset", "column_name", "severity",
        F.when(critical, "high").otherwise("medium").alias("business_criticality"),
        F.when(critical, "P2").otherwise("P3").alias("fix_priority"),
        F.lit("cleaning_or_validation").alias("etl_impact"), F.col("issue_type").alias("message"))
    if drift is not None:
        out = out.unionByName(drift.select(
            F.lit("drift").alias("source"), "dataset", "column_name", "severity", F.lit("medium").alias("business_criticality"),
            F.lit("P2").alias("fix_priority"), F.lit("monitoring").alias("etl_impact"), F.col("kind").alias("message")))
    if reconciliation is not None:
        out = out.unionByName(reconciliation.filter(~F.col("balanced")).select(
            F.lit("reconciliation").alias("source"), "dataset", F.lit("").alias("column_name"), F.lit("medium").alias("severity"),
            F.lit("high").alias("business_criticality"), F.lit("P1").alias("fix_priority"),
            F.lit("row_loss_risk").alias("etl_impact"), F.lit("stages do not balance").alias("message")))
    return out


# Columns whose text must not become a number.
NO_COERCE = "name|email|phone|address|city|country|state|status|desc|comment|title|label|category|type"


def suggest_actions(issues: DataFrame, semantics: DataFrame | None = None) -> DataFrame:
    """One action per finding; text columns are never coerced to numbers, and each column's
    semantic type adds the steps that are worth doing even without a finding."""
    acted = issues.join(F.broadcast(action_map(issues.sparkSession)), "issue_type", "left")
    guarded = (F.col("suggested_action") == "coerce_numeric") & F.lower("column_name").rlike(NO_COERCE)
    out = acted.select(
        "dataset", "column_name", "issue_type",
        F.when(guarded, "review_manually").otherwise(F.coalesce("suggested_action", F.lit("review_manually"))).alias("action"))
    if semantics is not None:
        proactive = semantics.select("dataset", "column_name", F.lit("proactive").alias("issue_type"), F.explode("transform_hints").alias("action"))
        out = out.unionByName(proactive.join(out.select("dataset", "column_name", "action").distinct(),
                                             ["dataset", "column_name", "action"], "left_anti").select(*out.columns))
    return out
