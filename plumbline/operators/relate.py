"""Relationships between tables, found by joining counted keys, never rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ColumnInfo, as_text, col, infos, missing, row_fingerprint, share
from plumbline.operators.checks import finish_issues
from plumbline.operators.profile import aggregate_long, scalar_type_flags

KEY_WORDS = ("id", "key", "code", "sku")


def key_name(column: str, strip_prefix: bool = True) -> str:
    """Name used to match columns of different tables; a short table prefix (``o_``) is dropped."""
    lowered = column.lower()
    return re.sub(r"^[a-z]{1,2}_", "", lowered) if strip_prefix else lowered


def is_key_like(column: str) -> bool:
    return any(w in column.lower() for w in KEY_WORDS)


def key_text(i: ColumnInfo) -> Column:
    """Keys compare as text; a float that is whole reads like the integer."""
    text = F.trim(as_text(i))
    return F.regexp_replace(text, r"\.0$", "") if i.kind in ("float", "text") else text


def key_census(tables: dict[str, DataFrame], key_like_only: bool = True, strip_prefix: bool = True) -> DataFrame:
    """``(dataset, column_name, key_name, value, n)`` for the candidate keys of all tables.

    Only names shared by at least two tables are counted. A table contributes all its candidate
    columns from one scan.
    """
    names: dict[str, set[str]] = {}
    for table, df in tables.items():
        for c in df.columns:
            if not key_like_only or is_key_like(c):
                names.setdefault(key_name(c, strip_prefix), set()).add(table)
    shared = {k for k, v in names.items() if len(v) > 1}
    parts = []
    for table, df in tables.items():
        chosen = [i for i in infos(df) if key_name(i.name, strip_prefix) in shared and (not key_like_only or is_key_like(i.name))]
        if not chosen:
            continue
        entries = F.array(*[
            F.struct(F.lit(i.name).alias("column_name"), F.lit(key_name(i.name, strip_prefix)).alias("key_name"), key_text(i).alias("value"))
            for i in chosen
        ])
        parts.append(
            df.select(F.inline(entries)).filter("value IS NOT NULL")
            .groupBy("column_name", "key_name", "value").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(table).alias("dataset"), "column_name", "key_name", "value", "n")
        )
    return reduce(DataFrame.unionByName, parts) if parts else nothing_found(tables, "dataset string, column_name string, key_name string, value string, n long")


def nothing_found(tables: dict[str, DataFrame], schema: str) -> DataFrame:
    return next(iter(tables.values())).sparkSession.createDataFrame([], schema)


def relationships(tables: dict[str, DataFrame], key_like_only: bool = True, strip_prefix: bool = True) -> DataFrame:
    """Overlap, cardinality and orphans of every pair of tables that share a key name.

    The census meets itself on (name, value): each value carries at most one row per table, so the
    join output is bounded by the number of table pairs per value.
    """
    census = key_census(tables, key_like_only, strip_prefix)
    totals = census.groupBy("dataset", "column_name", "key_name").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"), F.max("n").alias("max_all")
    )

    def side(df, tag):
        return df.select("key_name", *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in ("key_name", "value")],
                         *(["value"] if "value" in df.columns else []))

    pairs = side(census, "a").join(side(census, "b"), ["key_name", "value"]).filter("dataset_a < dataset_b")
    overlap = pairs.groupBy("key_name", "dataset_a", "column_name_a", "dataset_b", "column_name_b").agg(
        F.count(F.lit(1)).alias("overlap_count"),
        F.max("n_a").alias("max_rows_per_key_a"), F.max("n_b").alias("max_rows_per_key_b"),
        F.sum("n_a").alias("matched_rows_a"), F.sum("n_b").alias("matched_rows_b"),
    )
    # totals have one row per candidate column: bounded by the schemas
    small_a, small_b = F.broadcast(side(totals, "a")), F.broadcast(side(totals, "b"))
    joined = overlap.join(small_a, ["key_name", "dataset_a", "column_name_a"]).join(
        small_b, ["key_name", "dataset_b", "column_name_b"])
    return joined.withColumn("cardinality", cardinality("max_rows_per_key_a", "max_rows_per_key_b")).withColumn(
        "parent", parent_side()
    )


def cardinality(a: str, b: str) -> Column:
    return (
        F.when((F.col(a) <= 1) & (F.col(b) <= 1), "one_to_one")
        .when(F.col(a) <= 1, "one_to_many")
        .when(F.col(b) <= 1, "many_to_one")
        .otherwise("many_to_many")
    )


def parent_side() -> Column:
    """Which side owns the key: unique column first, then distinct ratio, then rows per shared key."""
    ratio_a, ratio_b = F.col("n_keys_a") / F.col("n_rows_a"), F.col("n_keys_b") / F.col("n_rows_b")
    unique_a, unique_b = F.col("max_all_a") == 1, F.col("max_all_b") == 1
    return (
        F.when(unique_a & ~unique_b, F.col("dataset_a"))
        .when(unique_b & ~unique_a, F.col("dataset_b"))
        .when((ratio_a >= 0.995) & (ratio_b < 0.97), F.col("dataset_a"))
        .when((ratio_b >= 0.995) & (ratio_a < 0.97), F.col("dataset_b"))
        .when((F.col("max_rows_per_key_a") == 1) & (F.col("max_rows_per_key_b") > 1), F.col("dataset_a"))
        .when((F.col("max_rows_per_key_b") == 1) & (F.col("max_rows_per_key_a") > 1), F.col("dataset_b"))
    )


def many_to_many_warnings(rel: DataFrame) -> DataFrame:
    return rel.filter("cardinality = 'many_to_many'").select(
        "dataset_a", "column_name_a", "dataset_b", "column_name_b",
        F.when(F.col("key_name").rlike("id$|key$"), "medium").otherwise("low").alias("severity"),
    )


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct orphan key values with their row counts. The child is counted before the join."""
    counts = child.filter(col(child_key).isNotNull()).groupBy(col(child_key).alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(col(parent_key).alias("key_value"))
    return counts.join(known, "key_value", "left_anti")


def orphan_issue(child, parent, dataset, child_key, parent_key, severity="high") -> DataFrame:
    counts = child.filter(col(child_key).isNotNull()).groupBy(col(child_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(col(parent_key).alias("k"), F.lit(True).alias("found")).distinct()
    totals = counts.join(known, "k", "left").agg(
        F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("n_bad"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"),
    )
    return finish_issues(totals.filter("n_bad > 0").select(
        F.lit(dataset).alias("dataset"), F.lit(child_key).alias("column_name"), F.lit("orphan_foreign_key_rows").alias("issue_type"),
        F.lit(severity).alias("severity"), "n_bad", "n_checked"))


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The child rows themselves; null keys are no orphans and never enter the shuffle."""
    known = parent.select(col(parent_key).alias("_k"))
    return child.filter(col(child_key).isNotNull()).join(known, F.col(f"`{child_key}`") == F.col("_k"), "left_anti")


def global_orphan_values(tables: dict[str, DataFrame], strip_prefix: bool = True, samples: int = 5) -> DataFrame:
    """Key values present on one side only, for both directions of every pair, with samples.

    Works on the census with one group per (name, value): the set of tables that hold it.
    """
    census = key_census(tables, True, strip_prefix)
    holders = census.groupBy("key_name", "value").agg(F.collect_set("dataset").alias("holders"))
    members: dict[str, set[str]] = {}
    for table, df in tables.items():
        for c in df.columns:
            if is_key_like(c):
                members.setdefault(key_name(c, strip_prefix), set()).add(table)
    edges = [(k, a, b) for k, ts in members.items() for a in sorted(ts) for b in sorted(ts) if a != b]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("from_dataset"), F.lit(b).alias("to_dataset")) for k, a, b in edges])
    missing = F.filter(entries, lambda e: (e.k == F.col("key_name")) & F.array_contains(F.col("holders"), e.from_dataset)
                       & ~F.array_contains(F.col("holders"), e.to_dataset))
    orphans = holders.select("key_name", "value", F.inline(missing)).drop("k")
    top = Window.partitionBy("key_name", "from_dataset", "to_dataset").orderBy("value")
    sampled = (
        orphans.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= samples)
        .groupBy("key_name", "from_dataset", "to_dataset").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("samples"))
    )
    return orphans.groupBy("key_name", "from_dataset", "to_dataset").agg(F.count(F.lit(1)).alias("n_values")).join(
        F.broadcast(sampled), ["key_name", "from_dataset", "to_dataset"])


def same_records(a: DataFrame, b: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Do two tables hold the same records? Key overlap, row-count difference and equal rows."""
    shared = columns or [c for c in a.columns if c in b.columns]
    ia = [i for i in infos(a, shared)]

    def keyed(df, tag):
        h = row_fingerprint([i for i in infos(df, shared)])
        return df.select(col(key).alias("k"), F.struct(*h).alias("h")).filter("k IS NOT NULL").groupBy("k").agg(
            F.min("h").alias(f"h_{tag}"), F.count(F.lit(1)).alias(f"n_{tag}"))

    joined = keyed(a, "a").join(keyed(b, "b"), "k", "full_outer")
    s = joined.agg(
        F.count("h_a").alias("keys_a"), F.count("h_b").alias("keys_b"),
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"),
        F.count_if(F.col("h_a").isNotNull() & F.col("h_b").isNotNull()).alias("shared_keys"),
        F.count_if(F.col("h_a") == F.col("h_b")).alias("equal_rows"),
    )
    overlap = F.col("shared_keys") / F.nullif(F.least("keys_a", "keys_b"), F.lit(0))
    diff = F.abs(F.col("rows_a") - F.col("rows_b")) / F.nullif(F.greatest("rows_a", "rows_b"), F.lit(0))
    equal = F.col("equal_rows") / F.nullif(F.col("shared_keys"), F.lit(0))
    same_columns = F.lit(set(a.columns) == set(b.columns))
    return s.select(
        "shared_keys", "equal_rows",
        F.round(overlap, 6).alias("id_overlap"), F.round(diff, 6).alias("row_diff"), F.round(equal, 6).alias("equal_share"),
        F.coalesce(same_columns & (overlap >= 0.9) & (diff <= 0.1) & (equal >= 0.8), F.lit(False)).alias("same_records"),
        F.coalesce(same_columns & (overlap >= 0.95) & (diff <= 0.05), F.lit(False)).alias("duplicate_representation"),
    )


def id_type_drift(tables: dict[str, DataFrame], strip_prefix: bool = True) -> DataFrame:
    """The same id as numbers in one table and text in another. One aggregate per table."""
    parts = []
    for table, df in tables.items():
        rows = []
        for i in infos(df):
            if not is_key_like(i.name):
                continue
            flags = scalar_type_flags(i)
            rows.append({
                "dataset": table, "column_name": i.name, "key_name": key_name(i.name, strip_prefix),
                "n": F.count(col(i.name)),
                "n_str": F.count_if(col(i.name).isNotNull() & flags["string"]),
                "n_num": F.count_if(col(i.name).isNotNull() & (flags["integer"] | flags["float"])),
            })
        if rows:
            parts.append(aggregate_long(df, rows))
    none = nothing_found(tables, "dataset string, column_name string, key_name string, n long, n_str long, n_num long")
    found = reduce(DataFrame.unionByName, parts, none).filter("n > 0")
    bucket = (
        F.when((F.col("n_str") >= 0.1 * F.col("n")) & (F.col("n_num") >= 0.1 * F.col("n")), "mixed")
        .when(F.col("n_num") >= F.col("n_str"), "mostly_numeric").otherwise("mostly_string")
    )
    return found.withColumn("bucket", bucket).groupBy("key_name").agg(
        F.count(F.lit(1)).alias("n_tables"), F.count_distinct("bucket").alias("n_buckets"),
        F.array_join(F.array_sort(F.collect_set("bucket")), ",").alias("buckets"),
    ).filter("n_buckets >= 2").withColumn("severity", F.lit("high"))


def schema_frame(df: DataFrame, dataset: str) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(dataset, f.name, f.dataType.simpleString()) for f in df.schema.fields], "dataset string, column_name string, dtype string")


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and re-typed columns of two ``schema_frame`` tables."""
    a = before.select("dataset", "column_name", F.col("dtype").alias("dtype_before"))
    b = after.select("dataset", "column_name", F.col("dtype").alias("dtype_after"))
    change = (
        F.when(F.col("dtype_before").isNull(), "added").when(F.col("dtype_after").isNull(), "removed")
        .when(F.col("dtype_before") != F.col("dtype_after"), "type_changed")
    )
    return a.join(b, ["dataset", "column_name"], "full_outer").withColumn("change", change).filter("change IS NOT NULL")


def relationship_plan(rel: DataFrame) -> DataFrame:
    """Join edges with the join type, bridges for M:N, and edges to review."""
    child = F.when(F.col("parent") == F.col("dataset_a"), F.col("dataset_b")).when(
        F.col("parent") == F.col("dataset_b"), F.col("dataset_a"))
    child_rows = F.when(child == F.col("dataset_a"), F.col("n_rows_a")).otherwise(F.col("n_rows_b"))
    matched = F.when(child == F.col("dataset_a"), F.col("matched_rows_a")).otherwise(F.col("matched_rows_b"))
    orphans = child_rows - matched
    kind = F.when(F.col("cardinality") == "many_to_many", "bridge").when(F.col("parent").isNull(), "review").otherwise("join")
    return rel.select(
        "key_name", "dataset_a", "dataset_b", "cardinality", kind.alias("edge"),
        F.when(kind == "join", F.col("parent")).alias("parent"), F.when(kind == "join", child).alias("child"),
        F.when(kind == "join", orphans).alias("orphan_rows"),
        F.when(kind == "join", F.when(orphans > 0, "left").otherwise("inner")).alias("join_type"),
    )


def load_order(plan: DataFrame, datasets: list[str]) -> DataFrame:
    """Tables with the fewest parents first."""
    spark = plan.sparkSession
    names = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    degree = plan.filter("edge = 'join'").groupBy(F.col("child").alias("dataset")).agg(F.count_distinct("parent").alias("n_parents"))
    w = Window.partitionBy(F.lit(0)).orderBy("n_parents", "dataset")
    return names.join(degree, "dataset", "left").fillna(0, ["n_parents"]).withColumn("load_order", F.row_number().over(w))


def shared_columns(tables: dict[str, DataFrame], strip_prefix: bool = True) -> DataFrame:
    """Columns two tables have in common, and whether they could join."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, key_name(c, strip_prefix), is_key_like(c)) for t, df in tables.items() for c in df.columns]
    cols = spark.createDataFrame(rows, "dataset string, column_name string, key_name string, key_like boolean")
    b = cols.select(F.col("dataset").alias("dataset_b"), F.col("column_name").alias("column_name_b"), "key_name")
    return cols.join(b, "key_name").filter("dataset < dataset_b").select(
        F.col("dataset").alias("dataset_a"), F.col("column_name").alias("column_name_a"), "dataset_b", "column_name_b", "key_name", "key_like")


def merge_issues(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Add supplemental findings that are not there yet."""
    return base.unionByName(extra.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def contract_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Datasets added or removed between two runs, with the confidence of each run."""
    a = before.select("dataset", F.col("confidence").alias("confidence_a"))
    b = after.select("dataset", F.col("confidence").alias("confidence_b"))
    change = F.when(F.col("confidence_a").isNull(), "added").when(F.col("confidence_b").isNull(), "removed").otherwise("kept")
    return a.join(b, "dataset", "full_outer").withColumn("change", change)


def value_overlaps(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Distinct values that columns of different tables share, whatever the columns' names.

    dataset_a, column_a, dataset_b, column_b, n_a, n_b (distinct values), n_common. Every table is reduced to its
    distinct (column, value) in one pass; the values meet once in a census of all columns, where each becomes the set of
    columns that hold it, as bits. Then only the different sets are counted, so a pair of columns costs nothing per value.
    Text is compared as it is, numbers as numbers, dates as dates; nulls are left out.
    """
    places, entries = [], []
    for table, df in tables.items():
        chosen = [i for i in infos(df, (columns or {}).get(table)) if i.kind in ("integer", "float", "text", "date", "boolean")]
        cells = []
        for i in chosen:
            kind = "number" if i.is_numeric else i.kind
            value = as_text(i) if not i.is_numeric else (col(i.name).cast("double") + F.lit(0.0)).cast("string")
            cells.append(F.struct(F.lit(len(places)).alias("c"), F.concat(F.lit(kind[0]), F.when(~missing(i), value)).alias("v")))
            places.append((table, i.name))
        if cells:
            entries.append(df.select(F.inline(F.array(*cells))).filter("v IS NOT NULL").distinct())
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(places)], "c int, dataset string, column_name string")
    if not entries:
        entries = [spark.createDataFrame([], "c int, v string")]
    held_by = reduce(DataFrame.unionByName, entries).groupBy("v").agg(F.sort_array(F.collect_set("c")).alias("cs"))  # a column once per value
    sets = held_by.groupBy("cs").agg(F.count(F.lit(1)).alias("n"))
    sizes = sets.select(F.explode("cs").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("size"))
    both = sets.select(F.explode("cs").alias("ca"), "cs", "n").select("ca", F.explode("cs").alias("cb"), "n").groupBy("ca", "cb").agg(F.sum("n").alias("n_common"))
    side = lambda s: names.join(sizes, "c").select(*[F.col(x).alias(f"{x}_{s}") for x in ("c", "dataset", "column_name", "size")])
    found = both.join(side("a"), F.col("ca") == F.col("c_a")).join(side("b"), F.col("cb") == F.col("c_b")).filter("dataset_a <> dataset_b")
    return found.select(
        "dataset_a", F.col("column_name_a").alias("column_a"), "dataset_b", F.col("column_name_b").alias("column_b"),
        F.col("size_a").alias("n_a"), F.col("size_b").alias("n_b"), "n_common")


def potential_join_keys(tables: dict[str, DataFrame], least_share: float = 0.9, least_values: int = 2) -> DataFrame:
    """Columns whose values lie, but for a small share, in a column of another table that has few others besides.

    Each row says: ``column_a`` could refer to ``column_b``. ``inclusion`` is the share of a's distinct values found in b,
    ``coverage`` the share of b's that a uses, ``is_complete`` whether all of a's are found.
    """
    found = value_overlaps(tables).filter((F.col("n_a") >= least_values) & (F.col("n_common") >= F.col("n_a") * least_share))
    return found.select(
        "dataset_a", "column_a", "dataset_b", "column_b", "n_a", "n_b", "n_common",
        F.round(F.col("n_common") / F.col("n_a"), 6).alias("inclusion"), F.round(F.col("n_common") / F.col("n_b"), 6).alias("coverage"),
        (F.col("n_common") == F.col("n_a")).alias("is_complete"))
