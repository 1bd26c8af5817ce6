"""Meaning of columns: subtypes with privacy level and fill strategy, tags, importance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv

# Per subtype: semantic type, privacy level, fill strategy, transform hints.
SUBTYPES = {
    "email": ("id", "high", "flag", ("trim", "lowercase", "sanitize_email")),
    "phone": ("id", "high", "flag", ("trim", "normalize_phone")),
    "ssn": ("id", "high", "flag", ("trim",)),
    "zip_code": ("id", "medium", "fill_mode", ("trim",)),
    "uuid": ("id", "none", "flag", ("trim",)),
    "currency": ("metric", "none", "fill_zero", ("coerce_numeric",)),
    "age": ("metric", "low", "fill_median", ("coerce_numeric",)),
    "percentage": ("metric", "none", "fill_zero", ("coerce_numeric",)),
    "status_flag": ("categorical", "none", "fill_mode", ("trim", "uppercase")),
    "country": ("categorical", "none", "fill_mode", ("trim",)),
    "gender": ("categorical", "low", "fill_mode", ("trim", "uppercase")),
    "boolean_int": ("categorical", "none", "fill_zero", ("standardize_boolean",)),
    "date": ("date", "none", "none", ("parse_dates",)),
    "ip_address": ("id", "low", "flag", ("trim",)),
    "url": ("string", "none", "flag", ("trim",)),
    "etl_metadata": ("metadata", "none", "none", ()),
    "metric": ("metric", "none", "fill_zero", ("coerce_numeric",)),
    "text": ("string", "none", "fill_mode", ("trim",)),
}
# Name rules in order of precedence.
NAME_RULES = (
    ("etl_metadata", ("etl", "dwh", "load_id", "batch_id", "ingested_at", "loaded_at")),
    ("email", ("email", "mail")),
    ("phone", fv.PHONE_NAME_HINTS),
    ("ssn", ("ssn", "social", "sin")),
    ("zip_code", ("zip", "postal", "pincode")),
    ("uuid", ("uuid", "guid")),
    ("currency", ("amount", "price", "fee", "cost", "revenue", "sales", "income", "salary", "balance")),
    ("age", ("age", "years")),
    ("percentage", ("rate", "pct", "percent", "percentage")),
    ("status_flag", ("status", "state", "active", "flag", "is_", "has_")),
    ("country", ("country", "nation")),
    ("gender", ("gender", "sex")),
)


def _has(words) -> Column:
    """Whether the column name has one of the words, as a word of its own or in the plural."""
    return F.lower("column_name").rlike("(^|[^a-z0-9])(" + "|".join(re.escape(w.strip("_")) for w in words) + ")s?($|[^a-z0-9])")


def describe(shares: DataFrame, key_candidates: tuple[str, ...] = ()) -> DataFrame:
    """Semantic descriptor per column: value shares first, then names, then the storage type.

    An id column becomes ``pk`` when it is a key candidate, else ``fk`` when it is named like a key.
    """
    by_value = (
        F.when(F.col("n") == 0, None)
        .when(F.col("s_email") >= 0.5, "email").when(F.col("s_uuid") >= 0.7, "uuid").when(F.col("s_ipv4") >= 0.7, "ip_address")
        .when(F.col("s_url") >= 0.6, "url").when(F.col("s_iso_date") >= 0.5, "date").when(F.col("s_ssn") >= 0.7, "ssn")
        .when(F.col("s_zip") >= 0.7, "zip_code").when((F.col("s_phone") >= 0.6) & _has(fv.PHONE_NAME_HINTS), "phone")
        .when(F.col("s_bool") >= 0.8, "boolean_int")
    )
    by_name = F.lit(None).cast("string")
    for sub, words in reversed(NAME_RULES):
        by_name = F.when(_has(words), sub).otherwise(by_name)
    kind = F.col("dtype")
    by_dtype = F.when(kind.isin("integer", "float"), "metric").when(kind == "date", "date").otherwise("text")
    confidence = F.when(by_value.isNotNull(), 0.9).when(by_name.isNotNull(), 0.7).when(kind == "date", 0.6).otherwise(0.5)
    rule = F.coalesce(by_value, by_name, by_dtype)
    table = F.create_map(*[x for sub, (st, pii, fill, hints) in SUBTYPES.items() for x in (
        F.lit(sub), F.struct(F.lit(st).alias("semantic_type"), F.lit(pii).alias("pii_level"), F.lit(fill).alias("fill_strategy"),
                             F.array(*[F.lit(h) for h in hints]).cast("array<string>").alias("transform_hints")))])
    d = shares.withColumn("_sub", rule).withColumn("_d", table[F.col("_sub")])
    key_named = F.lower("column_name").rlike("(id|key)$")
    is_id = F.col("_d.semantic_type") == "id"
    sub_type = F.when(is_id & F.col("column_name").isin(*key_candidates), "pk").when(is_id & key_named, "fk").when(
        F.col("_sub").isin("metric", "text") | ((F.col("_sub") == "date")), "unknown").otherwise(F.col("_sub"))
    return d.select(
        "dataset", "column_name", F.col("_d.semantic_type"), sub_type.alias("sub_type"), F.col("_d.pii_level"), F.col("_d.fill_strategy"),
        F.col("_d.transform_hints"), confidence.alias("confidence"),
        F.when(F.col("_sub") == "age", 0.0).when(F.col("_sub") == "percentage", 0.0).alias("valid_min"),
        F.when(F.col("_sub") == "age", 120.0).when(F.col("_sub") == "percentage", 100.0).alias("valid_max"),
    )


def column_tags(shares: DataFrame) -> DataFrame:
    """Five-way tag: date, id, metric, categorical or text."""
    name, kind = F.lower("column_name"), F.col("dtype")
    tag = (
        F.when(kind == "date", "date").when(name.rlike("date|time|dob|stamp|_at$"), "date")
        .when(name.rlike("phone|email|ssn|zip|postal|(id|key|code|num)$"), "id")
        .when(kind.isin("integer", "float"), "metric")
        .when(name.rlike("credit|fee|amount|price|quantity|qty|count|score|grade|val"), "metric")
        .when(name.rlike("status|gender|category|type|state|country|city|active|flag"), "categorical")
        .otherwise("text")
    )
    return shares.select("dataset", "column_name", tag.alias("tag"))


def column_importance(profile: DataFrame, descriptors: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Importance per column: declared in a manifest, else key candidates and ids first."""
    j = profile.join(F.broadcast(descriptors.select("column_name", "semantic_type", "confidence")), "column_name", "left")
    declared = F.lit(None).cast("string")
    if manifest is not None:
        j = j.join(F.broadcast(manifest.select("dataset", "column_name", F.col("importance").alias("_declared"))), ["dataset", "column_name"], "left")
        declared = F.col("_declared")
    likely_key = F.col("is_key_candidate") & F.lower("column_name").rlike("id$|key$|code$|uuid")
    importance = F.coalesce(declared, F.when(F.col("is_key_candidate") | F.lower("column_name").rlike("id$|key$"), "high")
                            .when(F.col("semantic_type") == "metric", "medium").otherwise("low"))
    return j.select("dataset", "column_name", importance.alias("importance"), likely_key.alias("likely_key"), "confidence")


def manifest_gaps(df: DataFrame, dataset: str, primary_key: list[str], columns: list[str]) -> DataFrame:
    """Declared keys and columns the data does not have."""
    have = {c.lower() for c in df.columns}
    rows = [(dataset, c, "missing_primary_key") for c in primary_key if c.lower() not in have]
    rows += [(dataset, c, "missing_column") for c in columns if c.lower() not in have]
    return df.sparkSession.createDataFrame(rows, "dataset string, column_name string, problem string")
