"""Snapshots, drift signals, stage reconciliation and before/after differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ColumnInfo, as_text, col, infos, row_fingerprint
from plumbline.operators.profile import column_profile
from plumbline.sources.readers import guard_select
from plumbline.sources.readers import sample_rows as sample_rows_of

# Drift policy.
ROW_COUNT_RELATIVE = 0.15
NULL_RATE_ABSOLUTE = 0.08
DISTINCT_RELATIVE = 0.25


def snapshot(df: DataFrame, dataset: str, run_id: str, saved_at: str) -> DataFrame:
    """Fingerprint of a table for the history: one row per column."""
    p = column_profile(df, dataset)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    mapping = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return p.select(
        "dataset", F.lit(run_id).alias("run_id"), F.lit(saved_at).cast("timestamp").alias("saved_at"), "row_count",
        "column_name", mapping[F.col("column_name")].alias("dtype"), "null_pct", "unique_count",
    )


def append_snapshot(snap: DataFrame, path: str) -> None:
    snap.write.mode("append").partitionBy("dataset").parquet(path)


def latest_snapshot(history: DataFrame, before_run: str | None = None) -> DataFrame:
    """The newest run of every dataset. Runs are few, rows stay where they are: a semi join."""
    runs = history.select("dataset", "run_id", "saved_at").distinct()
    if before_run is not None:
        runs = runs.filter(F.col("run_id") != before_run)
    w = Window.partitionBy("dataset").orderBy(F.desc("saved_at"), F.desc("run_id"))
    newest = runs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("dataset", "run_id")
    return history.join(newest, ["dataset", "run_id"], "left_semi")


def _signal(df: DataFrame, kind: str, severity, column=None, detail=None) -> DataFrame:
    return df.select(
        "dataset", (column if column is not None else F.lit("")).alias("column_name"), F.lit(kind).alias("kind"),
        severity.alias("severity"), (detail if detail is not None else F.lit(None).cast("double")).alias("detail"),
    )


def row_count_drift(prev: DataFrame, cur: DataFrame) -> DataFrame:
    a = prev.groupBy("dataset").agg(F.max("row_count").alias("prev"))
    b = cur.groupBy("dataset").agg(F.max("row_count").alias("cur"))
    rel = F.abs(F.col("cur") - F.col("prev")) / F.greatest(F.col("prev"), F.lit(1))
    found = a.join(b, "dataset").filter(rel > ROW_COUNT_RELATIVE)
    severity = F.when(rel > 2 * ROW_COUNT_RELATIVE, "high").otherwise("medium")
    return _signal(found, "row_count", severity, detail=F.round(rel, 6))


def column_drift(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Schema, type, null-rate and distinct-count signals from one full join of two snapshots."""
    a = prev.select("dataset", "column_name", *[F.col(c).alias(f"{c}_a") for c in ("dtype", "null_pct", "unique_count")])
    b = cur.select("dataset", "column_name", *[F.col(c).alias(f"{c}_b") for c in ("dtype", "null_pct", "unique_count")])
    j = a.join(b, ["dataset", "column_name"], "full_outer")
    null_delta = F.col("null_pct_b") - F.col("null_pct_a")
    distinct_rel = F.abs(F.col("unique_count_b") - F.col("unique_count_a")) / F.col("unique_count_a")

    def entry(condition, kind, severity, detail=None):
        return F.when(condition, F.struct(
            F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
            (detail if detail is not None else F.lit(None)).cast("double").alias("detail")))

    signals = F.array_compact(F.array(
        entry(F.col("dtype_a").isNull(), "column_added", "high"),
        entry(F.col("dtype_b").isNull(), "column_removed", "high"),
        entry(F.col("dtype_a") != F.col("dtype_b"), "dtype_changed", "medium"),
        entry(F.abs(null_delta) > NULL_RATE_ABSOLUTE, "null_rate", "medium", F.round(null_delta, 6)),
        entry((F.col("unique_count_a") > 10) & (distinct_rel > DISTINCT_RELATIVE), "distinct_count", "low", F.round(distinct_rel, 6)),
    ))
    return j.select("dataset", "column_name", F.inline(signals))


def compare_snapshots(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return row_count_drift(prev, cur).unionByName(column_drift(prev, cur))


_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).when(F.col(c) == "low", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank >= 3, "high").when(rank == 2, "medium").when(rank == 1, "low").otherwise("none")


def drift_by_dataset(signals: DataFrame) -> DataFrame:
    return signals.groupBy("dataset").agg(
        severity_name(F.max(severity_rank())).alias("severity"), F.count(F.lit(1)).alias("signal_count"))


def drift_score(signals: DataFrame) -> DataFrame:
    """100 minus the worst severity's penalty minus two points per signal (at most 20)."""
    worst = F.coalesce(F.max(severity_rank()), F.lit(0))
    total = signals.agg(worst.alias("worst"), F.count(F.lit(1)).alias("total_signal_count"))
    penalty = F.when(F.col("worst") == 3, 35).when(F.col("worst") == 2, 18).when(F.col("worst") == 1, 8).otherwise(0)
    score = F.greatest(F.lit(0), F.lit(100) - penalty - F.least(F.lit(20), F.col("total_signal_count") * 2))
    return total.select(score.cast("long").alias("drift_score"), severity_name(F.col("worst")).alias("worst_severity"), "total_signal_count")


# --- reconciliation ------------------------------------------------------------------------------

STAGES = ("source", "parsed", "parse_failed", "filtered", "transformed", "written", "failed", "skipped")


def stage_counts(df: DataFrame, dataset: str, flags: dict[str, Column]) -> DataFrame:
    """Rows per load stage from one scan; ``flags`` maps a stage to its row predicate."""
    wide = df.agg(*[F.count_if(p).alias(s) for s, p in flags.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in flags])
    return wide.select(F.lit(dataset).alias("dataset"), F.inline(rows))


def reconcile(stages: DataFrame) -> DataFrame:
    """One row per dataset with all stages, deltas, and whether the load balances."""
    wide = stages.groupBy("dataset").pivot("stage", list(STAGES)).agg(F.sum("n")).fillna(0, list(STAGES))
    parse_loss = F.greatest(F.lit(0), F.col("source") - F.col("parsed"))
    write_loss = F.greatest(F.lit(0), F.col("source") - F.col("written"))
    explanation = (
        F.when(F.col("written") > F.col("source"), "more rows written than read")
        .when(F.col("parse_failed") > 0, "rows lost while parsing")
        .when(F.col("filtered") > 0, "rows filtered or rejected")
        .when(F.col("failed") > 0, "rows failed to write")
        .otherwise("all rows accounted for")
    )
    return wide.withColumn("parse_delta", parse_loss).withColumn("write_delta", write_loss).withColumn(
        "balanced", F.col("written") <= F.col("source")).withColumn("explanation", explanation)


def row_deltas(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Row counts per table before and after a run."""
    from functools import reduce

    def counts(tables, name):
        return reduce(DataFrame.unionByName, [
            df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias("dataset"), name) for t, df in tables.items()])

    return counts(before, "rows_before").join(counts(after, "rows_after"), "dataset", "full_outer").withColumn(
        "row_delta", F.coalesce("rows_after", F.lit(0)) - F.coalesce("rows_before", F.lit(0)))


# --- frame difference ----------------------------------------------------------------------------

def frame_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Row delta, schema changes, lost and new keys, and rows whose shared columns changed.

    Both sides shrink to key plus fingerprint and meet in one full join.
    """
    ta = {f.name: f.dataType.simpleString() for f in before.schema.fields}
    tb = {f.name: f.dataType.simpleString() for f in after.schema.fields}
    shared = [c for c in before.columns if c in tb and c not in keys]
    same_type = [c for c in shared if ta[c] == tb[c]]

    def side(df, tag):
        # rows of one key count as a multiset; the order-free sum of fingerprints stands for them
        h = F.xxhash64(*row_fingerprint([i for i in infos(df) if i.name in same_type])) if same_type else F.lit(0).cast("long")
        return df.select(*[col(k) for k in keys], h.cast("decimal(38,0)").alias("h")).groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.sum("h").alias(f"h_{tag}"))

    a, b = side(before, "a"), side(after, "b")
    condition = [a[k].eqNullSafe(b[k]) for k in keys]
    j = a.join(b, condition, "full_outer")
    out = j.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_after"),
        F.count_if(F.col("n_b").isNull()).alias("lost_keys"), F.count_if(F.col("n_a").isNull()).alias("new_keys"),
        F.count_if(F.col("n_a").isNotNull() & F.col("n_b").isNotNull()).alias("kept_keys"),
        F.count_if((F.col("h_a") != F.col("h_b")) | (F.col("n_a") != F.col("n_b"))).alias("changed_keys"),
    )
    return out.select(
        "rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("row_delta"),
        "lost_keys", "new_keys", "kept_keys", "changed_keys",
        F.lit(",".join(sorted(set(tb) - set(ta)))).alias("added_columns"),
        F.lit(",".join(sorted(set(ta) - set(tb)))).alias("removed_columns"),
        F.lit(",".join(sorted(c for c in ta if c in tb and ta[c] != tb[c]))).alias("retyped_columns"),
    )


def sql_preview(tables: dict[str, DataFrame], statement: str, sample_rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Run one SELECT over the tables, known by their names while it is analysed; views of the session with these names come back.

    ``sample_rows`` takes about so many rows of each table, the same ones every time; ``limit`` cuts the result.
    """
    text = guard_select(statement)
    spark = next(iter(tables.values())).sparkSession
    own_views = {v.name.lower() for v in spark.catalog.listTables() if v.isTemporary}
    before = {name: spark.table(name) for name in tables if name.lower() in own_views}
    try:
        for name, df in tables.items():
            (df if sample_rows is None else sample_rows_of(df, sample_rows)).createOrReplaceTempView(name)
        out = spark.sql(text)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    return out if limit is None else out.limit(limit)


def step_impact(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Exact number of rows each step would touch, all steps in one scan."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(p).alias(s) for s, p in steps.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("affected_rows"), F.col("_n").alias("total_rows")) for s in steps])
    return wide.select(F.inline(rows)).withColumn(
        "pct", F.round(F.try_divide(F.col("affected_rows").cast("double"), F.col("total_rows").cast("double")), 6))
