"""Joins, referential integrity and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_text, col, infos, row_fingerprint
from plumbline.operators.ordering import global_row_number, overlapping_blocks
from plumbline.operators.transforms import prefix_columns


def join_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, how: str = "left",
                prefix: str | None = None, never_drop_rows: bool = False) -> DataFrame:
    """Child rows with their parent's columns.

    Colliding parent columns get the prefix (or all, when a prefix is given with ``:all``). An inner
    join becomes a left join when rows must never be dropped. The join strategy is left to Spark:
    it broadcasts a parent only when its measured size allows, and AQE splits skewed child keys.
    """
    if how == "inner" and never_drop_rows:
        how = "left"
    if prefix and prefix.endswith(":all"):
        right = prefix_columns(parent, prefix[:-4], [parent_key])
    else:
        taken = set(child.columns)
        right = parent.withColumnsRenamed({c: f"{prefix or 'parent_'}{c}" for c in parent.columns if c in taken and c != parent_key})
    right = right.withColumnRenamed(parent_key, "_parent_key")
    joined = child.join(right, col(child_key) == F.col("_parent_key"), how)
    return joined.drop("_parent_key") if child_key == parent_key or parent_key in child.columns else joined.withColumnRenamed("_parent_key", parent_key)


def bridge(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys present on both sides of an M:N relation."""
    a = left.select(col(left_key).alias(left_key)).distinct()
    return a.join(right.select(col(right_key).alias(left_key)).distinct(), left_key, "left_semi")


def enforce_reference(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, action: str = "reject_orphans"):
    """Apply a foreign-key action.

    ``reject_orphans`` → ``(good, rejects)``; ``null_fill_fk`` and ``flag`` → child;
    ``create_unknown_dim_record`` → parent with the missing keys added.
    """
    keys = parent.select(col(parent_key).alias("_k")).filter("_k IS NOT NULL")
    matches = col(child_key) == F.col("_k")
    if action == "reject_orphans":
        # null keys stay in place and never meet in one shuffle partition
        unkeyed = child.filter(col(child_key).isNull())
        keyed = child.filter(col(child_key).isNotNull())
        return keyed.join(keys, matches, "left_semi").unionByName(unkeyed), keyed.join(keys, matches, "left_anti")
    if action in ("null_fill_fk", "flag"):
        known = keys.distinct().withColumn("_found", F.lit(True))
        unkeyed = child.filter(col(child_key).isNull()).withColumn("_found", F.lit(None).cast("boolean"))
        keyed = child.filter(col(child_key).isNotNull()).join(known, matches, "left").drop("_k")
        both = keyed.unionByName(unkeyed)
        if action == "null_fill_fk":
            return both.withColumn(child_key, F.when(F.col("_found"), col(child_key))).drop("_found")
        orphan = col(child_key).isNotNull() & F.col("_found").isNull()
        return both.withColumn(f"{child_key}_orphan", orphan).drop("_found")
    if action == "create_unknown_dim_record":
        wanted = child.select(col(child_key).alias(parent_key)).filter(col(parent_key).isNotNull()).distinct()
        missing = wanted.join(parent.select(parent_key), parent_key, "left_anti")
        return parent.unionByName(missing.withColumn(parent_key, col(parent_key).cast(parent.schema[parent_key].dataType)), allowMissingColumns=True)
    raise ValueError(f"unknown action {action!r}")


def drop_duplicates(df: DataFrame, columns: list[str] | None = None, order_by: list[Column] | None = None) -> DataFrame:
    """Whole-row or key de-duplication; with an order the first row is kept, reproducibly."""
    if order_by is None:
        return df.dropDuplicates(columns) if columns else df.dropDuplicates()
    w = Window.partitionBy(*[col(c) for c in columns or df.columns]).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, keys: list[str], watermark: str, tie_break: list[str] | None = None) -> DataFrame:
    """Newest row per key; text keys compare trimmed and case-blind.

    Spark keeps only the best row per key in each map task before the shuffle (window group limit),
    so a hot key does not gather its rows in one task.
    """
    kinds = {i.name: i.kind for i in infos(df)}
    by = [F.lower(F.trim(col(k))) if kinds[k] == "text" else col(k) for k in keys]
    ties = [F.desc(c) for c in tie_break] if tie_break else [F.desc(h) for h in row_fingerprint(infos(df))]
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(watermark), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def neighbourhood_duplicates(df: DataFrame, key: str, columns: list[str], window: int = 15, threshold: float = 0.92,
                             block: int = 20_000) -> DataFrame:
    """Sorted neighbourhood: rows similar to one of the ``window - 1`` rows before them in text order.

    Equal texts collapse first, so a run of copies cannot fill the window. Positions are global;
    the table is cut into overlapping blocks, so each task sorts one block. Returns the keys to drop.
    """
    text = F.concat_ws(" ", *[F.coalesce(as_text(i), F.lit("")) for i in infos(df, columns)])
    rows = df.select(col(key).alias("_key"), text.alias("_text"))
    groups = rows.groupBy("_text").agg(F.min("_key").alias("_first"))
    numbered = global_row_number(groups, [F.asc("_text")], "_row")
    blocks = overlapping_blocks(numbered, "_row", block, window - 1)
    w = Window.partitionBy("_block").orderBy("_row")
    near = F.lit(False)
    for k in range(1, window):
        before = F.lag("_text", k).over(w)
        size_ok = F.least(F.length(before), F.length("_text")) >= threshold * F.greatest(F.length(before), F.length("_text"))
        near = near | F.coalesce(size_ok & (similarity(before, F.col("_text")) >= threshold), F.lit(False))
    judged = blocks.withColumn("_near", near).filter("_native").select("_text", "_first", "_near")
    joined = rows.join(judged, "_text")
    return joined.filter(F.col("_near") | (F.col("_key") != F.col("_first"))).select(F.col("_key").alias(key))


def remove_neighbourhood_duplicates(df: DataFrame, key: str, columns: list[str], **params) -> DataFrame:
    return df.join(neighbourhood_duplicates(df, key, columns, **params), key, "left_anti")


def apply_config_tables(df: DataFrame, column: str, invalid: DataFrame | None = None, default: DataFrame | None = None) -> DataFrame:
    """Null the values listed in ``invalid(value)`` and fill nulls from ``default(value)`` in one pass; of several defaults the smallest counts."""
    out = df
    value = col(column)
    if invalid is not None:
        # spellings of one value are one entry: they must not multiply the rows
        listed = invalid.select(F.lower(F.trim("value")).alias("_bad")).distinct().withColumn("_hit", F.lit(True))
        out = out.join(listed, F.lower(F.trim(value.cast("string"))) == F.col("_bad"), "left").drop("_bad")
        value = F.when(F.col("_hit").isNull(), value)
    if default is not None:
        out = out.crossJoin(F.broadcast(default.agg(F.min("value").alias("_default"))))
        value = F.coalesce(value, F.col("_default").cast(df.schema[column].dataType))
    return out.withColumn(column, value).drop("_hit", "_default")


def duplicate_key_probe(df: DataFrame, key: str, rsd: float = 0.02) -> DataFrame:
    """Cheap hint that a key repeats: rows minus approximate distinct keys, no shuffle of keys."""
    return df.agg(F.count(col(key)).alias("n"), F.approx_count_distinct(col(key), rsd).alias("approx_keys")).withColumn(
        "suspect", F.col("n") - F.col("approx_keys") > rsd * F.col("n"))


def null_probe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Is there any null left? One existence flag per column from one scan."""
    wide = df.agg(*[F.coalesce(F.bool_or(col(c).isNull()), F.lit(False)).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("has_null")) for c in columns])))
