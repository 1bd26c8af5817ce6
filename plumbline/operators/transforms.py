"""Column transforms. Each takes a DataFrame and a column and returns a DataFrame; chains of them
collapse into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_values as fv
from plumbline.functions.columns import ColumnInfo, as_double, any_word, col, infos, parse_date, strip
from plumbline.operators.ordering import exact_percentiles, global_row_number, quantile_chunks


def _info(df: DataFrame, name: str) -> ColumnInfo:
    return next(i for i in infos(df) if i.name == name)


def is_text(i: ColumnInfo) -> bool:
    return i.kind == "text"


# --- expressions: one value in, one value out --------------------------------------------------

def trim_value(c: Column) -> Column:
    return strip(c)


def boolean_value(c: Column, null_is_false: bool = False) -> Column:
    v = F.lower(F.trim(c.cast("string")))
    flag = F.when(v.isin(*fv.TRUE_WORDS), 1).otherwise(0)
    return flag if null_is_false else F.when(c.isNotNull(), flag)


def email_value(c: Column, strict: bool = False) -> Column:
    v = F.lower(strip(c))
    ok = v.rlike(r"^[^@]*@[^@]*\.[^@]*$") if strict else F.contains(v, F.lit("@"))
    return F.when(ok, v)


def phone_value(c: Column, strict: bool = False) -> Column:
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    if strict:
        return F.when(c.cast("string").rlike(fv.PHONE) & (F.length(digits) >= 7), digits)
    return digits


def hash_value(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def mask_last4(c: Column) -> Column:
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(c.isNull(), None).when(F.length(digits) < 4, "***").otherwise(F.concat(F.lit("***"), F.right(digits, F.lit(4))))


def numeric_target(name: str) -> str:
    lowered = name.lower()
    return "decimal(18,2)" if any_word(lowered, ("amount", "price")) else ("bigint" if lowered.endswith(("id", "key")) else "decimal(18,4)")


def target_type(name: str, dtype: T.DataType) -> str:
    """SQL type a typed load uses for a column, from its type and its name."""
    i = ColumnInfo(name, dtype)
    if i.kind == "date":
        return "date" if isinstance(dtype, T.DateType) else "timestamp"
    if i.kind == "boolean":
        return "boolean"
    if i.kind == "integer":
        return "bigint"
    if any_word(name, ("amount", "price")):
        return "decimal(18,2)"
    if i.kind == "float":
        return "decimal(18,4)" if isinstance(dtype, T.DecimalType) else "double"
    return "string"


def currency_value(c: Column) -> Column:
    negative = c.rlike(r"^[ ]*\(.*\)[ ]*$")
    number = as_double(F.regexp_replace(c, r"[^0-9.\-]", ""))
    return F.when(negative, -F.abs(number)).otherwise(number)


def tidy_text(c: Column, casing: str | None = None) -> Column:
    v = F.regexp_replace(strip(c), "[ \t\r\n]+", " ")
    blank = F.lower(v).isin("nan", "null", "none", "tbd", "tba", "n/a", "na", "-", "--", "")
    v = {"title": F.initcap, "lower": F.lower, None: lambda x: x}[casing](v)
    return F.when(~blank, v)


# Ids that stand for a missing id.
SENTINEL_IDS = ("0", "0.0", "-999", "999", "1111", "1234", "9876", "9999", "9999999", "999999",
                "nan", "null", "###", "none", "tbd", "n/a")


def tidy_id(c: Column) -> Column:
    v = F.regexp_replace(strip(c.cast("string")), r"\.0$", "")
    return F.when(~F.lower(v).isin(*SENTINEL_IDS) & (v != ""), v)


def mask_value(name: str, c: Column, numeric: bool) -> Column:
    lowered = name.lower()
    text = c.cast("string")
    if numeric:
        return c
    if "email" in lowered:
        found = F.regexp_extract(F.trim(text), r"^([^@]{1,2})[^@]*(@.+)$", 0) != ""
        masked = F.when(found, F.concat(F.regexp_extract(F.trim(text), r"^([^@]{1,2})[^@]*(@.+)$", 1), F.lit("***"),
                                        F.regexp_extract(F.trim(text), r"^([^@]{1,2})[^@]*(@.+)$", 2))).otherwise("***")
    elif "phone" in lowered or "mobile" in lowered:
        digits = F.regexp_replace(text, "[^0-9]", "")
        masked = F.when(F.length(digits) <= 4, "***").otherwise(F.concat(F.lit("***"), F.right(digits, F.lit(4))))
    elif any_word(lowered, ("password", "secret", "token", "api_key", "apikey")):
        masked = F.lit("***")
    else:
        masked = F.when(F.length(text) <= 4, "***").otherwise(F.concat(F.left(text, F.lit(2)), F.lit("***"), F.right(text, F.lit(2))))
    return F.when(c.isNotNull(), masked)


# --- actions -------------------------------------------------------------------------------------

def _text_action(fn):
    """Text actions leave numbers and dates alone."""

    def action(df: DataFrame, column: str, **params) -> DataFrame:
        return df.withColumn(column, fn(col(column), **params)) if is_text(_info(df, column)) else df

    return action


def _value_action(fn):
    def action(df: DataFrame, column: str, **params) -> DataFrame:
        return df.withColumn(column, fn(col(column), **params))

    return action


trim = _text_action(lambda c: trim_value(c))
lowercase = _text_action(lambda c: F.lower(c))
uppercase = _text_action(lambda c: F.upper(c))
cast_integer = _value_action(lambda c: as_double(F.trim(c.cast("string"))).try_cast("bigint"))
parse_dates = _value_action(lambda c: parse_date(F.trim(c.cast("string"))))
sanitize_email = _value_action(email_value)
normalize_phone = _value_action(phone_value)
hash_column = _value_action(hash_value)
mask_column = _value_action(mask_last4)
standardize_boolean = _value_action(boolean_value)
range_clip = _value_action(lambda c, low=0.0: F.when(as_double(c.cast("string")).isNotNull(), F.greatest(F.lit(float(low)), as_double(c.cast("string")))))
regex_replace = _value_action(lambda c, pattern=r"[^\p{L}\p{N}_ \t\r\n]", replacement="": F.regexp_replace(c.cast("string"), pattern, replacement))
currency_normalize = _value_action(currency_value)
tidy_text_column = _value_action(tidy_text)
tidy_id_column = _value_action(tidy_id)


def coerce_numeric(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    return df.withColumn(column, F.trim(col(column).cast("string")).try_cast(to or numeric_target(column)))


def default_fill(i: ColumnInfo):
    """Default fill value by type: number 0; text and dates stay null."""
    return 0 if i.is_numeric else None


def fill_nulls(df: DataFrame, column: str, value=None, strategy: str = "value") -> DataFrame:
    """Constant, mean, median or mode. Statistics come back as one broadcast row."""
    i = _info(df, column)
    if strategy == "value":
        fill = value if value is not None else default_fill(i)
        return df if fill is None else df.withColumn(column, F.coalesce(col(column), F.lit(fill).cast(i.dtype)))
    if strategy == "mean":
        stat = df.agg(F.avg(as_double(col(column).cast("string"))).alias("_fill"))
    elif strategy == "median":
        stat = exact_percentiles(df, {"v": as_double(col(column).cast("string"))}, (0.5,)).select(F.col("v__0").alias("_fill"))
    elif strategy == "mode":
        counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        # ties go to the smallest value
        best = counts.agg(F.max("n").alias("n"))
        stat = counts.join(F.broadcast(best), "n").agg(F.min("v").alias("_fill"))
    else:
        raise ValueError(f"unknown fill strategy {strategy!r}")
    out = df.crossJoin(F.broadcast(stat))
    dtype = "double" if strategy in ("mean", "median") and i.is_numeric else i.dtype
    return out.withColumn(column, F.coalesce(col(column).cast(dtype), F.col("_fill").cast(dtype))).drop("_fill")


def zero_to_null(df: DataFrame, column: str, sentinels=fv.SENTINELS) -> DataFrame:
    c = col(column)
    text = F.lower(F.trim(c.cast("string")))
    hit = text.isin("0", "###", "nan", "null") | F.coalesce(as_double(text).isin(*[float(s) for s in sentinels]), F.lit(False))
    return df.withColumn(column, F.when(~hit, c))


def placeholders_to_null(df: DataFrame, words=("", "n/a", "na", "null", "unknown")) -> DataFrame:
    """Every text column at once."""
    return df.select(*[
        F.when(~F.lower(strip(col(i.name))).isin(*words), col(i.name)).alias(i.name) if is_text(i) else col(i.name)
        for i in infos(df)
    ])


def replace_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(str(v)))])
    c = col(column).cast("string")
    return df.withColumn(column, F.coalesce(F.try_element_at(table, c), c))


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def nullify_future_dates(df: DataFrame, column: str, as_of: str | None = None) -> DataFrame:
    d = parse_date(F.trim(col(column))) if is_text(_info(df, column)) else col(column).cast("timestamp")
    now = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    return df.withColumn(column, F.when(d <= now, d))


def enforce_valid_values(df: DataFrame, column: str, allowed: list, never_drop_rows: bool = False) -> DataFrame:
    listed = col(column).isNull() | F.lower(col(column).cast("string")).isin(*[str(v).lower() for v in allowed])
    return df.withColumn(column, F.when(listed, col(column))) if never_drop_rows else df.filter(listed)


def require_any(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(F.coalesce(*[col(c).cast("string") for c in columns]).isNotNull())


def mask_sensitive(df: DataFrame, words=fv.SENSITIVE_WORDS) -> DataFrame:
    return df.select(*[
        mask_value(i.name, col(i.name), i.is_numeric or i.kind == "boolean").alias(i.name) if any_word(i.name, words) else col(i.name)
        for i in infos(df)
    ])


def prefix_columns(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


# --- outliers -----------------------------------------------------------------------------------

def outlier_bounds(df: DataFrame, column: str, factor: float = 1.5, method: str = "iqr") -> DataFrame:
    """One row ``(_lo, _hi, _mid)``. ``p5_p95`` widens the 5–95 % range by ``factor`` times its width."""
    probs = (0.25, 0.5, 0.75) if method == "iqr" else (0.05, 0.5, 0.95)
    p = exact_percentiles(df, {"v": as_double(col(column).cast("string"))}, probs)
    width = F.col("v__2") - F.col("v__0")
    return p.select((F.col("v__0") - factor * width).alias("_lo"), (F.col("v__2") + factor * width).alias("_hi"), F.col("v__1").alias("_mid"))


def _with_bounds(df, column, factor, method):
    return df.crossJoin(F.broadcast(outlier_bounds(df, column, factor, method))), as_double(col(column).cast("string"))


def flag_outliers(df: DataFrame, column: str, factor: float = 1.5, method: str = "iqr") -> DataFrame:
    b, v = _with_bounds(df, column, factor, method)
    out = F.coalesce((v < F.col("_lo")) | (v > F.col("_hi")), F.lit(False))
    return b.withColumn(f"{column}_outlier_flagged", out).drop("_lo", "_hi", "_mid")


def clip_outliers(df: DataFrame, column: str, factor: float = 1.5, method: str = "iqr") -> DataFrame:
    b, v = _with_bounds(df, column, factor, method)
    return b.withColumn(column, F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi", "_mid")


def cap_outliers(df: DataFrame, column: str, factor: float = 1.5, method: str = "iqr") -> DataFrame:
    b, v = _with_bounds(df, column, factor, method)
    return b.withColumn(column, F.when((v < F.col("_lo")) | (v > F.col("_hi")), F.col("_mid")).otherwise(v)).drop("_lo", "_hi", "_mid")


# --- nested -------------------------------------------------------------------------------------

def flatten_nested(df: DataFrame, explode_arrays: bool = True, sep: str = "_") -> DataFrame:
    """Struct fields to columns; arrays of structs to rows. Repeats until nothing is nested."""
    while True:
        structs = [f for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
        arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if structs:
            parts = []
            for f in df.schema.fields:
                if isinstance(f.dataType, T.StructType):
                    parts += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields]
                else:
                    parts.append(col(f.name))
            df = df.select(*parts)
        elif arrays and explode_arrays:
            df = df.withColumn(arrays[0].name, F.explode_outer(col(arrays[0].name)))
        else:
            return df


def flatten_json_text(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text with a known schema to columns."""
    return flatten_nested(df.withColumn(column, F.from_json(col(column), schema)))


# --- ordered fills --------------------------------------------------------------------------------

def order_number(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.cast("timestamp").cast("double") if _info(df, column).kind == "date" else c.cast("double")


def fill_directional(df: DataFrame, column: str, partition_by: list[str], order_by: str, tie_break: str, backward: bool = False) -> DataFrame:
    """Last (or next) known value in order.

    Every group is cut into quantile chunks of the order column. Chunk summaries carry the value
    across chunks, so even a group with a third of all rows is spread over tasks.
    """
    tagged = quantile_chunks(df, order_number(df, order_by))
    place = F.struct(F.col(order_by), F.col(tie_break))
    known = F.when(col(column).isNotNull(), place)
    pick = F.min_by if backward else F.max_by
    summary = tagged.groupBy(*partition_by, "_chunk").agg(pick(col(column), known).alias("_last"))
    chunk_order = F.desc("_chunk") if backward else F.asc("_chunk")
    over_chunks = Window.partitionBy(*partition_by).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*partition_by, "_chunk", F.last("_last", ignorenulls=True).over(over_chunks).alias("_carry"))
    rows_order = [F.desc(order_by), F.desc(tie_break)] if backward else [F.asc(order_by), F.asc(tie_break)]
    within = Window.partitionBy(*partition_by, "_chunk").orderBy(*rows_order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_fill", F.last(col(column), ignorenulls=True).over(within))
    condition = [local[k].eqNullSafe(carried[k]) for k in [*partition_by, "_chunk"]]
    joined = local.join(carried, condition, "left").select(*[local[c] for c in local.columns], carried["_carry"])
    return joined.withColumn(column, F.coalesce("_fill", "_carry")).drop("_fill", "_carry", "_chunk")


def fill_sequence(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """Running number from 1 over the whole table, in the order of columns that identify a row."""
    numbered = global_row_number(df.drop(column), [F.asc(c) for c in order_by], "_seq")
    return numbered.withColumn(column, F.col("_seq") + 1).drop("_seq")


# --- pipelines of steps -----------------------------------------------------------------------------

ACTIONS = {
    "trim": trim, "lowercase": lowercase, "uppercase": uppercase, "fill_nulls": fill_nulls, "coerce_numeric": coerce_numeric,
    "cast_type": cast_integer, "parse_dates": parse_dates, "sanitize_email": sanitize_email, "normalize_phone": normalize_phone,
    "hash": hash_column, "mask": mask_column, "standardize_boolean": standardize_boolean, "zero_to_null": zero_to_null,
    "flag_outliers": flag_outliers, "clip_outliers": clip_outliers, "cap_outliers": cap_outliers, "range_clip": range_clip,
    "replace_values": replace_values, "regex_replace": regex_replace, "drop_column": drop_columns,
    "nullify_future_dates": nullify_future_dates, "currency_normalize": currency_normalize, "tidy_text": tidy_text_column,
    "tidy_id": tidy_id_column,
}
