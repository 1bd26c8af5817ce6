"""Column and table profiles: one aggregate scan plus one value census."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.functions.columns import (
    ColumnInfo, as_double, as_text, col, g1_skew, infos, missing, parse_date, present, share, strip,
)
from plumbline.operators.census import census_summary, value_census
from plumbline.operators.ordering import exact_percentiles, ordered_ranks
from plumbline.session import checkpoint

# wider aggregates fall out of whole-stage code generation and cost more than another column-pruned scan
MAX_AGGREGATES = 48


def aggregate_long(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Evaluate one aggregate scan and return it as long rows.

    ``rows`` holds, per output row, the output columns as aggregate expressions or plain values.
    The list is cut so that one scan never compiles more than ``MAX_AGGREGATES`` expressions.
    """
    width = max(1, sum(isinstance(v, Column) for v in rows[0].values()))
    step = max(1, MAX_AGGREGATES // width)
    parts = []
    for start in range(0, len(rows), step):
        batch = rows[start:start + step]
        flat = [v.alias(f"_{i}_{k}") for i, r in enumerate(batch) for k, v in r.items() if isinstance(v, Column)]
        structs = [
            F.struct(*[(F.col(f"_{i}_{k}") if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in r.items()])
            for i, r in enumerate(batch)
        ]
        parts.append(df.agg(*flat).select(F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def table_profile(df: DataFrame, dataset: str) -> DataFrame:
    """Row count, column count and the size of the rows as JSON text."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.length(F.to_json(F.struct("*"))).cast("long")).alias("volume_bytes"),
    ).select(F.lit(dataset).alias("dataset"), "row_count",
             F.lit(len(df.columns)).cast("long").alias("column_count"), "volume_bytes")


def base_metrics(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """Counts and extremes per column from one scan without a data shuffle."""
    rows = []
    for i in infos(df, columns):
        c = col(i.name)
        number = c.cast("double") if i.is_numeric else F.lit(None).cast("double")
        number = F.nanvl(number, F.lit(None).cast("double"))
        text = c if i.kind == "text" else (
            F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss") if i.kind == "date" else F.lit(None).cast("string")
        )
        infinite = F.abs(number) == float("inf")
        rows.append({
            "dataset": dataset,
            "column_name": i.name,
            "dtype": i.kind,
            "row_count": F.count(F.lit(1)),
            "null_count": F.count_if(missing(i)),
            "min_number": F.min(number),
            "max_number": F.max(number),
            "min_text": F.min(text),
            "max_text": F.max(text),
            "zeros": F.count_if(number == 0),
            "negatives": F.count_if(number < 0),
            "infinities": F.count_if(infinite),
        })
    return aggregate_long(df, rows)


def column_profile(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, extremes, exact distincts, duplicates and key candidacy."""
    metrics = base_metrics(df, dataset, columns)
    summary = census_summary(value_census(df, columns)).select(
        "column_name", "unique_count", "duplicate_value_count", "top_value", "top_count", "entropy"
    )
    return metrics.join(F.broadcast(summary), "column_name", "left").select(
        "dataset", "column_name", "dtype", "row_count", "null_count",
        share(F.col("null_count"), F.col("row_count")).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "duplicate_value_count", "min_number", "max_number", "min_text", "max_text",
        "zeros", "negatives", "infinities", "top_value", "top_count",
        F.round("entropy", 6).alias("entropy"),
        ((F.col("null_count") == 0) & (F.col("unique_count") == F.col("row_count")) & (F.col("row_count") > 0))
        .alias("is_key_candidate"),
    )


def approximate_distincts(df: DataFrame, dataset: str, columns: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """Distinct counts from sketches: no shuffle of values, for very large tables."""
    return aggregate_long(df, [
        {
            "dataset": dataset, "column_name": i.name,
            "approx_unique": F.approx_count_distinct(as_text(i) if i.kind == "nested" else col(i.name), rsd),
        }
        for i in infos(df, columns)
    ])


def numeric_stats(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, G1 skewness and exact p5, median, p95 per numeric column."""
    numeric = [i for i in infos(df, columns) if i.is_numeric]
    percentiles = exact_percentiles(df, {i.name: col(i.name) for i in numeric}, (0.05, 0.5, 0.95))
    rows = []
    for i in numeric:
        v = F.nanvl(col(i.name).cast("double"), F.lit(None).cast("double"))
        rows.append({
            "dataset": dataset, "column_name": i.name, "n": F.count(v), "mean": F.avg(v),
            "std": F.stddev_samp(v), "skew": F.skewness(v), "kurt": F.kurtosis(v),
            "min_number": F.min(v), "max_number": F.max(v),
        })
    moments = aggregate_long(df, rows)
    wide = F.array(*[
        F.struct(F.lit(i.name).alias("column_name"), F.col(f"{i.name}__0").alias("p5"),
                 F.col(f"{i.name}__1").alias("median"), F.col(f"{i.name}__2").alias("p95"))
        for i in numeric
    ])
    n = F.col("n")
    return moments.join(F.broadcast(percentiles.select(F.inline(wide))), "column_name").select(
        "dataset", "column_name", "n",
        F.round("mean", 6).alias("mean"),
        F.round("median", 6).alias("median"),
        F.round(F.when(n >= 3, F.col("std")), 6).alias("std"),
        F.round(g1_skew(n, F.col("skew")), 6).alias("skew"),
        F.round("kurt", 6).alias("kurtosis"),
        F.round(F.when(n >= 8, F.col("p5")), 6).alias("p5"),
        F.round(F.when(n >= 8, F.col("p95")), 6).alias("p95"),
    )


def extended_profile(df: DataFrame, dataset: str) -> DataFrame:
    """Whole-table figures: missing cells, duplicate rows, constant and high-cardinality columns."""
    profile = column_profile(df, dataset)
    from plumbline.operators.keys import duplicate_row_counts

    table = profile.groupBy("dataset").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("null_count").alias("missing_cells"),
        F.sum("zeros").alias("zero_cells"),
        F.sum("infinities").alias("infinite_cells"),
        F.count_if(F.col("unique_count") == 1).alias("constant_columns"),
        F.count_if((F.col("dtype") == "text") & (F.col("unique_count") > 50)).alias("high_cardinality_columns"),
    )
    dups = duplicate_row_counts(df).select(F.col("n_extra").alias("duplicate_rows"))
    return table.crossJoin(F.broadcast(dups)).withColumn(
        "missing_pct", share(F.col("missing_cells"), F.col("row_count") * F.col("column_count"))
    )


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """All pairs of columns in one aggregate; Spearman correlates average ranks."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    source = df.select(*[col(c).cast("double").alias(c) for c in columns])
    if method == "spearman":
        source = average_ranks(source, columns)
    rows = [
        {
            "column_a": a, "column_b": b,
            "correlation": F.corr(col(a), col(b)),
        }
        for a, b in pairs
    ]
    return aggregate_long(source, rows).withColumn("correlation", F.round("correlation", 6))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each value by its average rank; ranks come from value counts, not from a sort of rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("name"), col(c).alias("v")) for c in columns])
    counts = (
        df.select(F.inline(entries)).filter("v IS NOT NULL")
        .groupBy("name", "v").agg(F.count(F.lit(1)).alias("cnt"))
    )
    ranks = ordered_ranks(counts, ["name"], "v", "cnt").withColumn(
        "rank", F.col("before") + (F.col("cnt") + 1) / 2.0
    )
    out = df
    for c in columns:
        lookup = ranks.filter(F.col("name") == c).select(F.col("v").alias(c), F.col("rank").alias(f"_rank_{c}"))
        out = out.join(lookup, c, "left")
    return out.select(*[F.col(f"_rank_{c}").alias(c) for c in columns])


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.9) -> DataFrame:
    return correlations(df, columns).filter(F.abs("correlation") >= threshold)


# --- shapes of text values -------------------------------------------------------------------

def type_mix(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """Share of values of each scalar type per column; text is judged by what it parses to."""
    rows = []
    for i in infos(df, columns):
        n, flags = present(i), scalar_type_flags(i)
        rows.append({
            "dataset": dataset, "column_name": i.name, "n": F.count_if(n),
            **{f"pct_{k}": F.round(F.try_divide(F.count_if(n & v).cast("double"), F.count_if(n).cast("double")), 6)
               for k, v in flags.items()},
        })
    return aggregate_long(df, rows)


def scalar_type_flags(i: ColumnInfo) -> dict[str, Column]:
    no, yes = F.lit(False), F.lit(True)
    flags = dict.fromkeys(("string", "integer", "float", "boolean", "list", "dict"), no)
    if i.kind == "text":
        t = F.trim(col(i.name))
        integer = t.rlike(r"^[+-]?[0-9]+$")
        # a cast or parse that fails costs far more than a pattern, and "and" may be reordered: a case guards both
        number = F.when(t.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), as_double(t)).isNotNull() & ~integer
        boolean = F.lower(t).isin("true", "false")
        # brackets alone do not make a value nested: it must parse
        parses = F.when(t.rlike(r"(?s)^(\[.*\]|\{.*\})$"), F.try_parse_json(t)).isNotNull()
        is_list, is_dict = t.rlike(r"(?s)^\[.*\]$") & parses, t.rlike(r"(?s)^\{.*\}$") & parses
        flags.update(integer=integer, float=number, boolean=boolean, list=is_list, dict=is_dict,
                     string=~(integer | number | boolean | is_list | is_dict))
    elif i.kind == "nested":
        flags["list" if i.dtype.typeName() == "array" else "dict"] = yes
    elif i.kind == "date":
        flags["string"] = yes
    else:
        flags[i.kind] = yes
    return flags


def json_path_types(df: DataFrame, column: str) -> DataFrame:
    """path, type, n, share of every place inside the JSON text of a column; ``$`` is the value, ``[]`` any element of a list.

    Text that does not parse counts as ``invalid`` at ``$``. Values are opened level by level, and each level is counted
    before the next, so what travels is one row per path and type.
    """
    spark = df.sparkSession
    level = checkpoint(df.filter(col(column).isNotNull()).select(F.lit("$").alias("path"), F.try_parse_json(col(column).cast("string")).alias("v")))
    counts = []
    while not level.isEmpty():
        kind = F.coalesce(F.lower(F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)), F.lit("invalid"))
        kind = F.when(kind == "bigint", "integer").when(kind.isin("double", "decimal", "float"), "number").when(kind == "void", "null").otherwise(kind)
        counts.append(checkpoint(level.groupBy("path", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))))
        inner = spark.sql("SELECT path, e.key AS key, e.value AS v FROM {level}, LATERAL variant_explode(v) AS e", level=level)
        # key is null for elements of a list
        level = checkpoint(inner.select(F.concat("path", F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit("[]"))).alias("path"), "v"))
    if not counts:
        return spark.createDataFrame([], "path string, type string, n long, share double")
    found = reduce(DataFrame.unionByName, counts)
    total = F.sum("n").over(Window.partitionBy("path"))
    return found.withColumn("share", F.round(F.col("n") / total, 6))


def value_shares(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """Share of values that look like an e-mail, UUID, date … for every column, in one scan."""
    rows = []
    for i in infos(df, columns):
        n = present(i)
        t = F.trim(as_text(i))
        shapes = {
            "uuid": t.rlike(fv.UUID_ANY),
            "ipv4": t.rlike(fv.IPV4),
            "url": F.lower(t).rlike(fv.URL_START),
            "at_sign": F.contains(t, F.lit("@")),
            "email": t.rlike(fv.EMAIL),
            "bool": F.lower(t).isin(*fv.BOOLEAN_WORDS),
            "iso_date": t.rlike(fv.ISO_DATE_START),
            "date": parse_date(t).isNotNull(),
            "digits": t.rlike(fv.DIGITS),
            "ssn": t.rlike(fv.SSN),
            "zip": t.rlike(fv.ZIP),
            "phone": t.rlike(fv.PHONE),
        }
        rows.append({
            "dataset": dataset, "column_name": i.name, "dtype": i.kind, "n": F.count_if(n),
            "mean_length": F.avg(F.when(n, F.length(as_text(i)))),
            **{f"s_{k}": F.try_divide(F.count_if(n & v).cast("double"), F.count_if(n).cast("double"))
               for k, v in shapes.items()},
        })
    return aggregate_long(df, rows)


def _name_has(words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower("column_name"), F.lit(w)) for w in words])


def _name_ends(*ends) -> Column:
    return reduce(lambda a, b: a | b, [F.lower("column_name").endswith(e) for e in ends])


def semantic_types(shares: DataFrame) -> DataFrame:
    """First rule that fits decides the semantic type of a column."""
    kind = (
        F.when(_name_has(fv.PHONE_NAME_HINTS), "phone")
        .when(F.col("n") == 0, "unknown")
        .when(F.col("s_uuid") >= 0.7, "uuid")
        .when(F.col("s_ipv4") >= 0.6, "ip_address")
        .when(F.col("s_url") >= 0.5, "url")
        .when(F.col("s_at_sign") >= 0.5, "email")
        .when(F.col("s_bool") >= 0.8, "boolean_like")
        .when(F.col("s_iso_date") >= 0.5, "date")
        .when(F.col("s_date") >= 0.7, "date")
        .when(F.col("s_digits") >= 0.9, "numeric_id")
        .when(F.col("mean_length") > 50, "free_text")
        .otherwise("categorical")
    )
    return shares.select("dataset", "column_name", "n", kind.alias("semantic_type"))


def storage_hints(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """How a text column should be stored, from what its values parse to."""
    rows = []
    for i in infos(df, columns):
        if i.kind not in ("text", "nested"):
            continue
        n = present(i)
        t = F.trim(as_text(i))
        rows.append({
            "dataset": dataset, "column_name": i.name, "n": F.count_if(n),
            "_nested": F.count_if(n & (t.rlike(fv.JSON_SHAPE) if i.kind == "text" else F.lit(True))),
            "_bool": F.count_if(n & F.lower(t).isin(*fv.BOOLEAN_WORDS)),
            "_num": F.count_if(n & as_double(t).isNotNull()),
            "_mark": F.count_if(n & t.rlike("[-/:T]")),
            "_date": F.count_if(n & parse_date(t).isNotNull()),
        })
    n = F.col("n")
    hint = (
        F.when(n == 0, "unknown")
        .when(F.col("_nested") == n, "nested")
        .when(F.col("_bool") / n > 0.8, "boolean_like")
        .when(F.col("_num") / n > 0.8, "numeric_like")
        .when((F.col("_mark") / n >= 0.2) & (F.col("_date") / n > 0.8), "datetime_like")
        .when((F.col("_num") == 0) & (F.col("_date") == 0) & (F.col("_nested") == 0), "string")
        .otherwise("mixed")
    )
    return aggregate_long(df, rows).select("dataset", "column_name", "n", hint.alias("storage_hint"))


def date_format_census(df: DataFrame, column: str, variants: bool = False) -> DataFrame:
    """Count of values per date shape. The four-shape form tells parseable from unparsed values."""
    t = F.trim(col(column))
    live = df.filter(col(column).isNotNull() & (t != "")).select(t.alias("t"))
    label = F.lit(None).cast("string")
    for name, pattern in reversed((fv.DATE_VARIANTS if variants else fv.DATE_SHAPES).items()):
        label = F.when(F.col("t").rlike(pattern), name).otherwise(label)
    if not variants:
        parsed = parse_date(F.col("t")).isNotNull()
        label = F.when(~parsed, "unparsed").otherwise(F.coalesce(label, F.lit("other/timestamp")))
    counts = live.groupBy(label.alias("format")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .filter("format IS NOT NULL")
        .select(F.lit(column).alias("column_name"), "format", "n", share(F.col("n"), F.col("total"), 4).alias("pct"))
    )


def phone_bucket(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), r"\.0+$", "")
    return (
        F.when(t == "", "empty").when(t.rlike(fv.E164), "e164").when(t.rlike(fv.PHONE), "national").otherwise("invalid")
    )


def phone_format_census(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(col(column).isNotNull())
        .groupBy(phone_bucket(col(column)).alias("format"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(column).alias("column_name"), "format", "n")
    )


# --- null patterns, comparison, histograms ------------------------------------------------------

def null_patterns(df: DataFrame, dataset: str, column: str, category_columns: list[str]) -> DataFrame:
    """Are the nulls of a column tied to one value of a category column (share above 80 %)?"""
    target = F.col("_null")
    entries = F.array(*[F.struct(F.lit(c).alias("cat_col"), col(c).alias("cat_val")) for c in category_columns])
    flagged = df.select(
        missing(next(i for i in infos(df) if i.name == column)).alias("_null"), *[col(c) for c in category_columns]
    )
    by_value = (
        flagged.select("_null", F.inline(entries)).filter("cat_val IS NOT NULL")
        .groupBy("cat_col", "cat_val")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(target).alias("n_null"))
        .withColumn("null_share", F.col("n_null") / F.col("n"))
    )
    worst = by_value.agg(
        F.max("null_share").alias("null_share"),
        F.max_by("cat_col", F.struct("null_share", "cat_col", "cat_val")).alias("cat_col"),
        F.max_by("cat_val", F.struct("null_share", "cat_col", "cat_val")).alias("cat_val"),
    )
    nulls = flagged.agg(F.count_if(target).alias("total_nulls"))
    tied = F.col("null_share") > 0.8
    return nulls.crossJoin(F.broadcast(worst)).select(
        F.lit(dataset).alias("dataset"), F.lit(column).alias("column_name"), "total_nulls",
        F.when(F.col("total_nulls") == 0, "none").when(tied, "MNAR").otherwise("MCAR").alias("pattern"),
        F.when((F.col("total_nulls") > 0) & tied, F.col("cat_col")).alias("concentrated_in_col"),
        F.when((F.col("total_nulls") > 0) & tied, F.col("cat_val")).alias("concentrated_in_value"),
    )


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two profiles side by side, matched on column name, with deltas."""
    fields = ("dtype", "row_count", "null_pct", "unique_count", "min_number", "max_number")
    left = a.select("column_name", *[F.col(f).alias(f"{f}_a") for f in fields])
    right = b.select("column_name", *[F.col(f).alias(f"{f}_b") for f in fields])
    return left.join(right, "column_name", "full_outer").withColumn(
        "presence",
        F.when(F.col("row_count_b").isNull(), "only_a").when(F.col("row_count_a").isNull(), "only_b").otherwise("both"),
    ).withColumn("null_pct_delta", F.round(F.col("null_pct_b") - F.col("null_pct_a"), 6)).withColumn(
        "unique_delta", F.col("unique_count_b") - F.col("unique_count_a")
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram per numeric column; the last bin includes the maximum."""
    ends = df.agg(
        *[F.min(col(c).cast("double")).alias(f"{c}__lo") for c in columns],
        *[F.max(col(c).cast("double")).alias(f"{c}__hi") for c in columns],
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), col(c).cast("double").alias("v"),
                 F.col(f"{c}__lo").alias("lo"), F.col(f"{c}__hi").alias("hi"))
        for c in columns
    ])
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))))
    return (
        df.select(*[col(c) for c in columns]).crossJoin(F.broadcast(ends)).select(F.inline(entries))
        .filter("v IS NOT NULL")
        .groupBy("column_name", F.coalesce(index, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .select("column_name", "bin",
                F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 6).alias("bin_start"), "n")
    )


def null_ranking(profile: DataFrame, top: int) -> DataFrame:
    """Columns with the largest null share first (a top-k report)."""
    return profile.select("dataset", "column_name", "null_count", "null_pct").orderBy(
        F.desc("null_pct"), "column_name"
    ).limit(top)
