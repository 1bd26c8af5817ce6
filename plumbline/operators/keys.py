"""Keys, duplicates and dependencies between columns of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.functions.columns import as_timestamp, col, infos, row_fingerprint


def duplicate_row_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose every column repeats: all members, and those beyond the first of each group.

    Only a 128-bit fingerprint per row is shuffled.
    """
    groups = df.select(*row_fingerprint(infos(df, columns))).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_members"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"),
    )


def key_duplicates(df: DataFrame, keys: list[str], ignore_null: bool = True) -> DataFrame:
    """Duplicate figures of a key: rows in repeated keys and rows beyond the first."""
    source = df.select(*[col(k) for k in keys])
    if ignore_null:
        source = source.dropna(subset=keys)
    groups = source.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_members"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"),
        F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
    )


def confirm_business_key(df: DataFrame, dataset: str, keys: list[str]) -> DataFrame:
    """Confirm a declared key: duplicates beyond the first and the de-duplication hint."""
    available = [k for k in keys if k in df.columns]
    if not available:
        raise ValueError(f"none of the key columns {keys} exists")
    extra = key_duplicates(df, available, ignore_null=False)
    return extra.select(
        F.lit(dataset).alias("dataset"),
        F.lit(",".join(available)).alias("business_key"),
        F.col("n_extra").alias("duplicate_count"),
        F.when(F.col("n_extra") > 0, "keep_last").otherwise("no_action_needed").alias("dedup_hint"),
    )


def issue_row(df: DataFrame, dataset: str, column: str, issue_type: str, severity: str) -> DataFrame:
    """Issue shape from a frame that has ``n_bad`` and ``n_checked``; no row when nothing is bad."""
    from plumbline.operators.checks import finish_issues

    return finish_issues(df.select(
        F.lit(dataset).alias("dataset"), F.lit(column).alias("column_name"), F.lit(issue_type).alias("issue_type"),
        F.lit(severity).alias("severity"), F.col("n_bad").cast("long").alias("n_bad"),
        F.col("n_checked").cast("long").alias("n_checked"),
    ).filter("n_bad > 0"))


def duplicate_primary_key(df: DataFrame, dataset: str, keys: list[str]) -> DataFrame:
    counts = key_duplicates(df, keys).select(F.col("n_members").alias("n_bad"), F.col("n_rows").alias("n_checked"))
    return issue_row(counts, dataset, ",".join(keys), "duplicate_primary_key", "high")


def duplicate_rows(df: DataFrame, dataset: str) -> DataFrame:
    counts = duplicate_row_counts(df).select(F.col("n_members").alias("n_bad"), F.col("n_rows").alias("n_checked"))
    if len(df.columns) < 2:
        counts = counts.withColumn("n_bad", F.lit(0))
    return issue_row(counts, dataset, "[row]", "duplicate_rows", "medium")


def intra_dataset_orphans(df: DataFrame, dataset: str, key: str, reference: str) -> DataFrame:
    """Values of a self-reference that are missing from the key column.

    The referencing side is counted per value first, so a hot parent is one row in the join.
    """
    refs = df.filter(col(reference).isNotNull()).groupBy(col(reference).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(col(key).alias("k"), F.lit(True).alias("found")).filter("k IS NOT NULL").distinct()
    counts = refs.join(keys, "k", "left").agg(
        F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("n_bad"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"),
    )
    return issue_row(counts, dataset, reference, "intra_dataset_orphan_fk", "high")


def self_reference_candidates(df: DataFrame, unique_columns: list[str]) -> list[tuple[str, str]]:
    """(key, reference) column pairs worth testing: key unique, reference named after it or a hierarchy."""
    ids = [c for c in df.columns if c.lower().endswith("id")]
    pairs = []
    for key in ids:
        if key not in unique_columns:
            continue
        stem = key.lower()[:-2].strip("_")
        for ref in ids:
            hierarchy = any(w in ref.lower() for w in fv.HIERARCHY_WORDS)
            if ref != key and (not stem or stem in ref.lower() or hierarchy):
                pairs.append((key, ref))
    return pairs


def functional_dependency(df: DataFrame, dataset: str, determinant: str, dependent: str) -> DataFrame:
    """Determinants with more than one dependent value; reports keys and all their rows.

    Counting (determinant, dependent) pairs first keeps a hot determinant out of a single task.
    """
    pairs = (
        df.select(col(determinant).alias("det"), col(dependent).alias("dep")).dropna()
        .groupBy("det", "dep").agg(F.count(F.lit(1)).alias("n"))
    )
    groups = pairs.groupBy("det").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
    counts = groups.agg(
        F.count_if(F.col("values") > 1).alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col("values") > 1, F.col("n"))), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"),
    )
    return counts.filter("n_checked >= 10 AND n_keys > 0").select(
        F.lit(dataset).alias("dataset"), F.lit(f"{determinant}->{dependent}").alias("column_name"),
        F.lit("functional_dependency_violation").alias("issue_type"), F.lit("medium").alias("severity"),
        F.col("n_keys").alias("n_bad"), "n_rows", "n_checked",
    )


def functional_dependencies(df: DataFrame, dataset: str, rules=fv.FUNCTIONAL_DEPENDENCIES) -> DataFrame:
    """All rules whose columns exist; no rows if there is none."""
    by_lower = {c.lower(): c for c in df.columns}
    parts = [
        functional_dependency(df, dataset, by_lower[a], by_lower[b])
        for a, b in rules if a in by_lower and b in by_lower
    ]
    none = df.sparkSession.createDataFrame([], "dataset string, column_name string, issue_type string, severity string, n_bad long, n_rows long, n_checked long")
    return reduce(DataFrame.unionByName, parts) if parts else none


def date_range_violations(df: DataFrame, dataset: str, pairs=fv.DATE_RANGE_PAIRS) -> DataFrame:
    """End before start, for every known pair of columns, in one scan."""
    from plumbline.operators.checks import finish_issues
    from plumbline.operators.profile import aggregate_long

    by_lower = {i.lower: i for i in infos(df)}
    rows = []
    for a, b in pairs:
        if a in by_lower and b in by_lower:
            start, end = as_timestamp(by_lower[a]), as_timestamp(by_lower[b])
            rows.append({
                "dataset": dataset,
                "column_name": f"{by_lower[a].name},{by_lower[b].name}",
                "issue_type": "date_range_violation",
                "severity": "high",
                "n_bad": F.count_if(end < start),
                "n_checked": F.count_if(start.isNotNull() & end.isNotNull()),
            })
    return finish_issues(aggregate_long(df, rows).filter("n_bad > 0"))
