"""Validation checks.

Three plan shapes cover all of them:

* row checks: a predicate per column, all of them in one aggregate scan without a shuffle;
* bounded checks: the predicate needs statistics, which return as one broadcast row;
* census checks: anything about distinct values, answered from one value census.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.functions.columns import (
    ColumnInfo, any_word, as_double, as_timestamp, col, g1_skew, infos, missing, parse_date, present, share, strip,
)
from plumbline.operators.census import census_summary, value_census
from plumbline.operators.ordering import exact_percentiles
from plumbline.operators.profile import aggregate_long, phone_bucket, scalar_type_flags

ISSUE_COLUMNS = ("dataset", "column_name", "issue_type", "severity", "n_bad", "n_checked", "pct")
TRUE, FALSE = F.lit, F.lit


@dataclass(frozen=True)
class Settings:
    """Parameters of the checks; ``semantics`` maps a column to its semantic type."""

    semantics: dict[str, str] | None = None
    as_of: str | None = None
    placeholders: tuple = fv.PLACEHOLDERS
    sentinels: tuple = fv.SENTINELS
    required: tuple = ()
    rules_active: bool = False
    long_text: int = 4000
    dominant_share: float = 0.92
    skew: float = 2.0
    key_null_share: float = 0.25
    placeholder_min_count: int = 5
    placeholder_min_share: float = 0.02

    def tag(self, info: ColumnInfo) -> str:
        given = (self.semantics or {}).get(info.name)
        if given:
            return given
        if info.kind == "date":
            return "date"
        name = info.lower
        if info.kind == "text":
            if "email" in name:
                return "email"
            if "uuid" in name or "guid" in name:
                return "uuid"
            if any_word(name, ("phone", "mobile", "fax")):
                return "phone"
            if "url" in name:
                return "url"
            if any_word(name, ("date", "dob")) or name.endswith("_at"):
                return "date"
        return ""

    def now(self) -> Column:
        return F.to_timestamp(F.lit(self.as_of)) if self.as_of else F.current_timestamp()


def finish_issues(df: DataFrame) -> DataFrame:
    return df.select(
        "dataset", "column_name", "issue_type", "severity",
        F.col("n_bad").cast("long").alias("n_bad"), F.col("n_checked").cast("long").alias("n_checked"),
        share(F.col("n_bad"), F.col("n_checked")).alias("pct"),
    )


def no_issues(spark) -> DataFrame:
    """An issues table without rows."""
    return spark.createDataFrame([], "dataset string, column_name string, issue_type string, severity string, n_bad long, n_checked long, pct double")


# --- row checks ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class RowCheck:
    """``measures`` are row predicates to count; ``verdict`` turns the counts into a finding."""

    issue_type: str
    severity: str
    applies: Callable[[ColumnInfo, Settings], bool]
    measures: Callable[[ColumnInfo, Settings], dict[str, Column]]
    verdict: Callable[[dict[str, Column]], tuple[Column, Column, Column]]


ROW_CHECKS: dict[str, RowCheck] = {}


def row_check(issue_type, severity, applies, bad, checked=None, min_n=1, above=0.0, below=None):
    """Register a check that fires on the share of bad rows."""

    def measures(i, s):
        return {"bad": bad(i, s), "n": checked(i, s) if checked else present(i)}

    def verdict(m):
        fires = (m["bad"] > 0) & (m["n"] >= min_n)
        if above:
            fires &= m["bad"] > m["n"] * above
        if below is not None:
            fires &= m["bad"] < m["n"] * below
        return m["bad"], m["n"], fires

    ROW_CHECKS[issue_type] = RowCheck(issue_type, severity, applies, measures, verdict)


def counted_check(issue_type, severity, applies, measures, verdict):
    """Register a check whose finding combines several counts."""
    ROW_CHECKS[issue_type] = RowCheck(issue_type, severity, applies, measures, verdict)


def register_check(name: str, predicate: Callable[[DataFrame], Column], severity: str = "medium"):
    """User hook: a named predicate over whole rows, true for bad rows."""
    USER_CHECKS[name] = (predicate, severity)


USER_CHECKS: dict[str, tuple[Callable[[DataFrame], Column], str]] = {}


def _text(i, s):
    return i.kind == "text"


def _tag(*tags):
    return lambda i, s: i.kind == "text" and s.tag(i) in tags


def _date(i, s):
    return i.kind == "date" or (i.kind == "text" and s.tag(i) == "date")


def _metric(i, s):
    return i.is_numeric and not i.is_id_like


def _named(words):
    return lambda i, s: i.kind == "text" and any_word(i.name, words)


def _numeric_value(i):
    return col(i.name).cast("double") if i.is_numeric else as_double(F.trim(col(i.name)))


def _not_empty(i, s):
    return present(i) & (strip(col(i.name)) != "")


def _no_match(pattern):
    return lambda i, s: present(i) & ~col(i.name).rlike(pattern)


def _match(pattern):
    return lambda i, s: col(i.name).rlike(pattern)


def _age_token(i, s):
    words = i.lower.replace("-", "_").split("_")
    return i.kind in ("integer", "float", "text") and "age" in words


def _dated(predicate):
    return lambda i, s: predicate(as_timestamp(i), s)


def _has_date(i, s):
    return as_timestamp(i).isNotNull()


row_check("nulls", "low",
          lambda i, s: not s.rules_active or i.name in s.required,
          lambda i, s: missing(i), checked=lambda i, s: F.lit(True))
row_check("placeholder_nulls", "low", _text,
          lambda i, s: F.lower(strip(col(i.name))).isin(*s.placeholders))
row_check("invalid_numeric", "medium", _tag("numeric", "metric"),
          lambda i, s: present(i) & as_double(F.trim(col(i.name))).isNull())
row_check("invalid_email", "medium", _tag("email"), _no_match(fv.EMAIL))
row_check("invalid_phone", "medium", _tag("phone"), _no_match(fv.PHONE))
row_check("invalid_uuid", "high", _tag("uuid"), _no_match(fv.UUID_V1_TO_V5))
row_check("invalid_url", "medium", _tag("url"),
          lambda i, s: present(i) & ~F.lower(col(i.name)).rlike(fv.URL))
row_check("invalid_date_format", "medium", _tag("date"),
          lambda i, s: present(i) & parse_date(F.trim(col(i.name))).isNull())
row_check("negative_values", "medium", _metric, lambda i, s: col(i.name) < 0, checked=lambda i, s: present(i))
row_check("sentinel_numeric_value", "medium",
          lambda i, s: _metric(i, s) or (i.kind == "text" and s.tag(i) in ("numeric", "numeric_id")),
          lambda i, s: _numeric_value(i).isin(*[float(v) for v in s.sentinels]),
          checked=lambda i, s: _numeric_value(i).isNotNull())
row_check("suspicious_zero", "medium",
          lambda i, s: i.is_id_like and i.kind in ("integer", "float", "text"),
          lambda i, s: col(i.name) == 0 if i.is_numeric else col(i.name).isin("0", "0.0"))
row_check("whitespace", "low", _text,
          lambda i, s: col(i.name).rlike(fv.OUTER_SPACE) | (strip(col(i.name)) == ""))
row_check("internal_whitespace", "low", _text, _match(fv.INNER_SPACES))
row_check("html_tags_in_text", "medium", _text, _match(fv.HTML_TAG))
row_check("punctuation_only_value", "medium", _text, _match(fv.PUNCTUATION_ONLY))
row_check("empty_string_values", "low", _text, lambda i, s: strip(col(i.name)) == "")
row_check("extremely_long_strings", "low", _text, lambda i, s: F.length(col(i.name)) > s.long_text)
row_check("leading_zeros_on_numeric_id", "low",
          lambda i, s: i.kind == "text" and i.is_id_like, _match(fv.LEADING_ZERO))
row_check("impossible_date", "high", _tag("date"),
          lambda i, s: F.trim(col(i.name)).rlike(fv.ISO_DATE_START + "|" + fv.US_DATE_START)
          & parse_date(F.trim(col(i.name))).isNull())
row_check("non_ascii_characters", "low", _text, _match(fv.NON_ASCII), min_n=10, below=0.5)
row_check("control_characters_in_text", "medium", _text, _match(fv.CONTROL_CHARACTER), min_n=5)
row_check("all_caps_values", "low", _named(fv.LABEL_WORDS),
          lambda i, s: (col(i.name) == F.upper(col(i.name))) & col(i.name).rlike(r"\p{L}"), min_n=6, below=0.9)
row_check("string_with_only_digits_in_text_column", "medium",
          lambda i, s: i.kind == "text" and not i.lower.endswith(("id", "code", "zip"))
          and s.tag(i) not in ("numeric_id", "id", "phone", "zip", "postal_code"),
          lambda i, s: strip(col(i.name)).rlike(fv.DIGITS), min_n=10, above=0.1, below=0.9)
row_check("repeated_token_in_string", "low", _named(fv.TOKEN_WORDS),
          lambda i, s: F.lower(strip(col(i.name))).rlike(r"^([^ \t\r\n]+)[ \t\r\n]+\1([ \t\r\n]|$)"), min_n=10)
row_check("implausible_age", "high", _age_token,
          lambda i, s: (_numeric_value(i) < 0) | (_numeric_value(i) > 150),
          checked=lambda i, s: _numeric_value(i).isNotNull(), min_n=5)
row_check("implausible_percentage", "medium",
          lambda i, s: i.kind in ("integer", "float", "text") and any_word(i.name, fv.PERCENT_WORDS),
          lambda i, s: (_numeric_value(i) < 0) | (_numeric_value(i) > 100),
          checked=lambda i, s: _numeric_value(i).isNotNull(), min_n=5)
row_check("round_number_anomaly", "low", _metric, lambda i, s: F.lit(False))  # replaced below
row_check("numeric_precision_anomaly", "low", lambda i, s: i.kind == "float" and not i.is_id_like,
          lambda i, s: present(i) & (col(i.name) == F.floor(col(i.name))), min_n=20, above=0.2, below=0.8)
row_check("future_dates", "high", _date,
          _dated(lambda d, s: d > s.now() + F.expr("INTERVAL 1 DAY")), checked=_has_date)
row_check("ancient_dates", "medium", _date,
          _dated(lambda d, s: d < F.to_timestamp(F.lit("1900-01-01"))), checked=_has_date)
row_check("date_clumping_jan1", "medium", _date,
          _dated(lambda d, s: (F.month(d) == 1) & (F.dayofmonth(d) == 1)), checked=_has_date, min_n=20, above=0.2)
row_check("date_clumping_month_end", "low", _date,
          _dated(lambda d, s: F.last_day(d) == F.to_date(d)), checked=_has_date, min_n=20, above=0.3)
row_check("weekend_date_anomaly", "low",
          lambda i, s: _date(i, s) and any_word(i.name, fv.BUSINESS_DATE_WORDS),
          _dated(lambda d, s: F.weekday(d) >= 5), checked=_has_date, min_n=20, above=0.15)
row_check("mixed_types", "medium", _text,
          lambda i, s: as_double(F.trim(col(i.name))).isNotNull(), checked=_not_empty, above=0.2, below=0.8)
row_check("high_null_ratio_in_key_column", "high", lambda i, s: i.is_id_like,
          lambda i, s: missing(i), checked=lambda i, s: F.lit(True), above=0.25)

counted_check(
    "round_number_anomaly", "low", _metric,
    lambda i, s: {"n": present(i),
                  "k": (col(i.name) % 1000 == 0) & (col(i.name) != 0),
                  "h": (col(i.name) % 100 == 0) & (col(i.name) != 0)},
    lambda m: (
        F.when(m["k"] > m["n"] * 0.3, m["k"]).otherwise(m["h"]), m["n"],
        (m["n"] >= 50) & ((m["k"] > m["n"] * 0.3) | (m["h"] > m["n"] * 0.5)),
    ),
)
counted_check(
    "mixed_date_formats", "medium", _tag("date"),
    lambda i, s: {"n": _not_empty(i, s), "iso": strip(col(i.name)).rlike(fv.ISO_DATE_START),
                  "us": strip(col(i.name)).rlike(fv.US_DATE_START), "eu": strip(col(i.name)).rlike(fv.EU_DATE_START)},
    lambda m: (
        m["iso"] + m["us"] + m["eu"], m["n"],
        (m["n"] >= 10) & ((m["iso"] > 0).cast("int") + (m["us"] > 0).cast("int") + (m["eu"] > 0).cast("int") >= 2),
    ),
)
counted_check(
    "timezone_inconsistency", "medium", _tag("date"),
    lambda i, s: {"n": present(i), "tz": col(i.name).rlike(fv.TIME_ZONE_MARK)},
    lambda m: (
        F.least(m["tz"], m["n"] - m["tz"]), m["n"],
        (m["n"] >= 10) & (F.least(m["tz"], m["n"] - m["tz"]) > m["n"] * 0.05),
    ),
)


def _words(i, words):
    return F.lower(strip(col(i.name))).isin(*words)


counted_check(
    "ambiguous_boolean", "medium", lambda i, s: i.kind == "text" and s.tag(i) == "boolean_like",
    lambda i, s: {"n": present(i), **{f"w_{w}": _words(i, [w]) for w in fv.TRUE_WORDS + fv.FALSE_WORDS}},
    lambda m: (
        m["n"], m["n"],
        (m["n"] > 10) & (reduce(lambda a, b: a + b, [
            (m[f"w_{w}"] > 0).cast("int") for w in fv.TRUE_WORDS + fv.FALSE_WORDS]) >= 3),
    ),
)
counted_check(
    "boolean_inconsistency", "medium", lambda i, s: i.kind == "text" and s.tag(i) == "boolean_like",
    lambda i, s: {"n": present(i), **{f"f_{k}": _words(i, v) for k, v in fv.BOOLEAN_FAMILIES.items()}},
    lambda m: (
        reduce(lambda a, b: a + b, [m[f"f_{k}"] for k in fv.BOOLEAN_FAMILIES]), m["n"],
        reduce(lambda a, b: a + b, [(m[f"f_{k}"] > 0).cast("int") for k in fv.BOOLEAN_FAMILIES]) >= 2,
    ),
)
counted_check(
    "mixed_phone_formats", "low", _tag("phone"),
    lambda i, s: {"n": present(i), **{b: phone_bucket(col(i.name)) == b for b in ("e164", "national", "invalid")}},
    lambda m: (
        m["n"] - F.greatest(m["e164"], m["national"], m["invalid"]), m["n"],
        sum([(m[b] > 0).cast("int") for b in ("e164", "national", "invalid")], F.lit(0)) >= 2,
    ),
)
counted_check(
    "mixed_scalar_types", "medium", _text,
    lambda i, s: {"n": present(i),
                  "str": present(i) & scalar_type_flags(i)["string"],
                  "num": present(i) & (scalar_type_flags(i)["integer"] | scalar_type_flags(i)["float"])},
    lambda m: (F.least(m["str"], m["num"]), m["n"],
               (m["n"] > 0) & (m["str"] >= m["n"] * 0.1) & (m["num"] >= m["n"] * 0.1)),
)


def name_shape(c: Column) -> Column:
    t = strip(c)
    letters = t.rlike(r"\p{L}")
    return (
        F.when(t.rlike(fv.INNER_SPACES), "double_space")
        .when(letters & (t == F.upper(t)), "upper")
        .when(letters & (t == F.lower(t)), "lower")
        .when(letters, "title")
    )


counted_check(
    "name_format_inconsistency", "low", _named(("name",)),
    lambda i, s: {"n": present(i), **{k: name_shape(col(i.name)) == k for k in ("title", "upper", "lower", "double_space")}},
    lambda m: (
        m["title"] + m["upper"] + m["lower"] + m["double_space"]
        - F.greatest(m["title"], m["upper"], m["lower"], m["double_space"]),
        m["n"],
        sum([(m[k] > 0).cast("int") for k in ("title", "upper", "lower", "double_space")], F.lit(0)) >= 2,
    ),
)
counted_check(
    "integer_stored_as_float", "low", lambda i, s: i.kind == "float",
    lambda i, s: {"n": present(i), "whole": present(i) & (col(i.name) == F.floor(col(i.name)))},
    lambda m: (m["whole"], m["n"], (m["n"] > 0) & (m["whole"] == m["n"])),
)
counted_check(
    "nested_structure", "medium", lambda i, s: i.kind in ("nested", "text"),
    lambda i, s: {"n": present(i),
                  "bad": present(i) if i.kind == "nested" else col(i.name).rlike(fv.JSON_SHAPE)},
    lambda m: (m["bad"], m["n"], (m["n"] > 0) & (m["bad"] == m["n"])),
)


def run_row_checks(
    df: DataFrame, dataset: str, settings: Settings = Settings(), only: Iterable[str] | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """All row checks that apply, fused into one aggregate per ~300 expressions."""
    names = list(only) if only is not None else list(ROW_CHECKS)
    rows = []
    for i in infos(df, columns):
        for name in names:
            check = ROW_CHECKS[name]
            if not check.applies(i, settings):
                continue
            m = {k: F.count_if(v) for k, v in check.measures(i, settings).items()}
            n_bad, n_checked, fires = check.verdict(m)
            severity = "high" if name == "nulls" and i.name in settings.required else check.severity
            rows.append({
                "dataset": dataset, "column_name": i.name,
                "issue_type": "nulls" if name == "placeholder_nulls" else name,
                "severity": severity,
                "n_bad": n_bad, "n_checked": n_checked, "fires": fires,
            })
    if not rows:
        return df.sparkSession.createDataFrame([], "dataset string, column_name string, issue_type string, "
                                               "severity string, n_bad long, n_checked long, pct double")
    return finish_issues(aggregate_long(df, rows).filter("fires"))


def row_level_flags(df: DataFrame, settings: Settings = Settings(), only: Iterable[str] | None = None) -> dict[str, tuple[str, Column]]:
    """``{"column:issue": (severity, predicate)}`` for row checks with one bad-row predicate."""
    out = {}
    for i in infos(df):
        for name in (list(only) if only is not None else list(ROW_CHECKS)):
            check = ROW_CHECKS[name]
            if check.applies(i, settings):
                measures = check.measures(i, settings)
                if "bad" in measures:
                    out[f"{i.name}:{name}"] = (check.severity, F.coalesce(measures["bad"], F.lit(False)))
    return out


def violations(df: DataFrame, dataset: str, key_cols: list[str], settings: Settings = Settings(),
               only: Iterable[str] | None = None) -> DataFrame:
    """One row per bad value: ``(dataset, issue_type, column_name, row_key, value)``."""
    flags = row_level_flags(df, settings, only)
    text = {i.name: F.to_json(col(i.name)) if i.kind == "nested" else col(i.name).cast("string") for i in infos(df)}
    key = F.concat_ws("|", *[col(k).cast("string") for k in key_cols])
    entries = F.array(*[
        F.when(p, F.struct(F.lit(n.split(":")[1]).alias("issue_type"), F.lit(n.split(":")[0]).alias("column_name"),
                           text[n.split(":")[0]].alias("value")))
        for n, (_, p) in flags.items()
    ])
    return df.select(key.alias("row_key"), F.inline(F.array_compact(entries))).select(
        F.lit(dataset).alias("dataset"), "issue_type", "column_name", "row_key", "value"
    )


def run_user_checks(df: DataFrame, dataset: str) -> DataFrame:
    rows = [
        {"dataset": dataset, "column_name": "[row]", "issue_type": name,
         "severity": severity, "n_bad": F.count_if(predicate(df)), "n_checked": F.count(F.lit(1))}
        for name, (predicate, severity) in USER_CHECKS.items()
    ]
    return finish_issues(aggregate_long(df, rows).filter("n_bad > 0"))


# --- bounded checks ------------------------------------------------------------------------------

def _issues_from_bounds(df, dataset, bounds, items) -> DataFrame:
    """``items``: (column, issue, severity, value, bad predicate, verdict on (bad, n))."""
    rows = []
    for name, issue, severity, value, bad, fires in items:
        n_bad, n = F.count_if(bad), F.count(value)
        rows.append({
            "dataset": dataset, "column_name": name, "issue_type": issue,
            "severity": severity, "n_bad": n_bad, "n_checked": n, "fires": fires(n_bad, n),
        })
    return finish_issues(aggregate_long(df.crossJoin(F.broadcast(bounds)), rows).filter("fires"))


def _value(i: ColumnInfo) -> Column:
    return F.nanvl(col(i.name).cast("double"), F.lit(None).cast("double"))


def iqr_outliers(df: DataFrame, dataset: str, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    numeric = [i for i in infos(df, columns) if i.is_numeric and not i.is_id_like]
    bounds = exact_percentiles(df, {i.name: _value(i) for i in numeric}, (0.25, 0.75)).select(
        *[F.col(f"{i.name}__0").alias(f"_{i.name}_q1") for i in numeric],
        *[F.col(f"{i.name}__1").alias(f"_{i.name}_q3") for i in numeric],
    )
    items = []
    for i in numeric:
        q1, q3, v = F.col(f"_{i.name}_q1"), F.col(f"_{i.name}_q3"), _value(i)
        iqr = q3 - q1
        bad = (iqr > 0) & ((v < q1 - factor * iqr) | (v > q3 + factor * iqr))
        items.append((i.name, "numeric_outliers_iqr", "medium", v, bad,
                      lambda b, n: (n >= 20) & (b > 0) & (b < n * 0.3)))
    return _issues_from_bounds(df, dataset, bounds, items)


def zscore_outliers(df: DataFrame, dataset: str, columns: list[str] | None = None, limit: float = 4.0) -> DataFrame:
    numeric = [i for i in infos(df, columns) if i.is_numeric and not i.is_id_like]
    bounds = df.agg(*[F.avg(_value(i)).alias(f"_{i.name}_m") for i in numeric],
                    *[F.stddev_samp(_value(i)).alias(f"_{i.name}_s") for i in numeric])
    items = []
    for i in numeric:
        m, s, v = F.col(f"_{i.name}_m"), F.col(f"_{i.name}_s"), _value(i)
        items.append((i.name, "numeric_outliers_zscore", "high", v, (s > 0) & (F.abs(v - m) > limit * s),
                      lambda b, n: (n >= 20) & (b > 0) & (b < n * 0.05)))
    return _issues_from_bounds(df, dataset, bounds, items)


def length_outliers(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    texts = [i for i in infos(df, columns) if i.kind == "text"]
    bounds = df.agg(*[F.avg(F.length(col(i.name))).alias(f"_{i.name}_m") for i in texts],
                    *[F.stddev_samp(F.length(col(i.name))).alias(f"_{i.name}_s") for i in texts])
    items = []
    for i in texts:
        m, s, v = F.col(f"_{i.name}_m"), F.col(f"_{i.name}_s"), F.length(col(i.name))
        items.append((i.name, "string_length_outlier", "low", v, (s > 0) & (m > 1) & (v > m + 4 * s),
                      lambda b, n: (n >= 20) & (b > 0) & (b < n * 0.1)))
    return _issues_from_bounds(df, dataset, bounds, items)


def skewed_distributions(df: DataFrame, dataset: str, settings: Settings = Settings(), columns: list[str] | None = None) -> DataFrame:
    rows = []
    for i in infos(df, columns):
        if i.is_numeric and not i.is_id_like:
            v = _value(i)
            n = F.count(v)
            rows.append({
                "dataset": dataset, "column_name": i.name,
                "issue_type": "skewed_distribution", "severity": "low",
                "n_bad": n, "n_checked": n, "fires": F.abs(g1_skew(n, F.skewness(v))) > settings.skew,
            })
    return finish_issues(aggregate_long(df, rows).filter("fires"))


def wide_date_spans(df: DataFrame, dataset: str, settings: Settings = Settings(), years: float = 50.0) -> DataFrame:
    rows = []
    for i in infos(df):
        if _date(i, settings):
            d = as_timestamp(i)
            n = F.count(d)
            rows.append({
                "dataset": dataset, "column_name": i.name,
                "issue_type": "very_wide_date_span", "severity": "low",
                "n_bad": n, "n_checked": n,
                "fires": (n >= 10) & (F.datediff(F.max(d), F.min(d)) / 365.25 > years),
            })
    return finish_issues(aggregate_long(df, rows).filter("fires"))


# --- census checks ---------------------------------------------------------------------------------

def _census_issue(summary: DataFrame, dataset: str, issue: str, severity: str, fires: Column, n_bad: Column) -> DataFrame:
    return finish_issues(summary.filter(fires).select(
        F.lit(dataset).alias("dataset"), "column_name", F.lit(issue).alias("issue_type"),
        F.lit(severity).alias("severity"), n_bad.alias("n_bad"), F.col("n_values").alias("n_checked"),
    ))


CENSUS_CHECKS = ("low_variance_numeric", "constant_column", "dominant_value_skew", "binary_like_column",
                 "very_high_cardinality", "duplicate_uuid", "potential_primary_key")


def run_census_checks(df: DataFrame, dataset: str, settings: Settings = Settings(), only: Iterable[str] | None = None,
                      columns: list[str] | None = None) -> DataFrame:
    """Checks on distinct values: one census, one row per column, then all verdicts at once."""
    wanted = set(only if only is not None else CENSUS_CHECKS)
    chosen = infos(df, columns)
    kinds = F.create_map(*[x for i in chosen for x in (F.lit(i.name), F.lit(i.kind))])
    tags = F.create_map(*[x for i in chosen for x in (F.lit(i.name), F.lit(settings.tag(i)))])
    summary = census_summary(value_census(df, columns)).withColumn("kind", kinds[F.col("column_name")]).withColumn(
        "tag", tags[F.col("column_name")]
    )
    n, u, top = F.col("n_values"), F.col("unique_count"), F.col("top_count")
    numeric = F.col("kind").isin("integer", "float")
    findings = {
        "low_variance_numeric": ("low", numeric & (n > 50) & (u <= 2) & (top >= n * 0.98), top),
        "constant_column": ("low", u == 1, n),
        "dominant_value_skew": ("low", (n > 0) & (top >= n * settings.dominant_share), top),
        "binary_like_column": ("low", (u == 2) & (F.col("kind") != "boolean"), n),
        "very_high_cardinality": ("low", (F.col("kind") == "text") & (n > 0) & (u > n * 0.9), u),
        "duplicate_uuid": ("high", (F.col("tag") == "uuid") & (u < n), n - u),
        "potential_primary_key": ("low", (n > 0) & (u == n) & (n == F.col("row_count")), F.lit(0).cast("long")),
    }
    entries = F.array(*[
        F.struct(F.lit(k).alias("issue_type"), F.lit(sev).alias("severity"), bad.cast("long").alias("n_bad"), fires.alias("fires"))
        for k, (sev, fires, bad) in findings.items() if k in wanted
    ])
    return finish_issues(
        summary.select(F.lit(dataset).alias("dataset"), "column_name", F.col("n_values").alias("n_checked"), F.inline(entries))
        .filter("fires")
    )


def case_findings(df: DataFrame, dataset: str, settings: Settings = Settings(), columns: list[str] | None = None) -> DataFrame:
    """Values that differ only by case, per text column.

    ``case_inconsistency`` counts the rows of colliding values; ``duplicate_insensitive_values``
    counts surplus spellings of categorical columns.
    """
    chosen = [i.name for i in infos(df, columns) if i.kind == "text"]
    categorical = [i.name for i in infos(df, chosen) if settings.tag(i) in ("categorical", "status", "enum")]
    trimmed = df.select(*[strip(col(c)).alias(c) for c in chosen])
    lowered = (
        value_census(trimmed, chosen).filter("value IS NOT NULL")
        .groupBy("column_name", F.lower("value").alias("folded"))
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    )
    per_column = lowered.groupBy("column_name").agg(
        F.sum("n").alias("n_values"),
        F.sum(F.col("spellings") - 1).alias("surplus"),
        F.coalesce(F.sum(F.when(F.col("spellings") > 1, F.col("n"))), F.lit(0)).alias("rows"),
    )
    same = _census_issue(per_column, dataset, "case_inconsistency", "low", F.col("surplus") > 0, F.col("rows"))
    listed = F.col("column_name").isin(*categorical) if categorical else F.lit(False)
    return same.unionByName(_census_issue(
        per_column, dataset, "duplicate_insensitive_values", "low",
        listed & (F.col("surplus") > 0) & (F.col("n_values") >= 10), F.col("surplus"),
    ))


def systematic_placeholders(df: DataFrame, dataset: str, settings: Settings = Settings()) -> DataFrame:
    """Placeholder tokens that recur: at least 5 rows and 2 % of a column."""
    from pyspark.sql import Window

    chosen = [i.name for i in infos(df) if i.kind == "text"]
    trimmed = df.select(*[F.lower(strip(col(c))).alias(c) for c in chosen])
    census = value_census(trimmed, chosen)
    totals = census.groupBy("column_name").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n_checked"))
    return (
        census.filter(F.col("value").isin(*settings.placeholders))
        .join(F.broadcast(totals), "column_name")
        .filter((F.col("n") >= settings.placeholder_min_count) & (F.col("n") >= F.col("n_checked") * settings.placeholder_min_share))
        .select(F.lit(dataset).alias("dataset"), "column_name", F.lit("systematic_placeholder").alias("issue_type"),
                F.lit("medium").alias("severity"), F.col("value").alias("token"), F.col("n").alias("n_bad"), "n_checked",
                share(F.col("n"), F.col("n_checked")).alias("pct"))
    )


# --- schema checks ---------------------------------------------------------------------------------

def schema_checks(df: DataFrame, dataset: str, header: list[str] | None = None, expected: list[str] | None = None,
                  wide: int = 200) -> DataFrame:
    """Checks that need column names only; ``empty_dataset`` reads one row at most."""
    names = header if header is not None else df.columns
    found = []

    def add(column, issue, severity):
        found.append((dataset, column, issue, severity, 1, len(names), round(1 / max(1, len(names)), 6)))

    if len(names) > wide:
        add("[table]", "very_wide_table", "low")
    seen_exact, seen_lower = set(), {}
    for n in names:
        if n != n.strip() or " " in n:
            add(n, "column_name_whitespace", "low")
        if n in seen_exact:
            add(n, "duplicate_column_names", "high")
        elif n.lower() in seen_lower:
            add(n, "case_insensitive_column_collision", "medium")
        seen_exact.add(n)
        seen_lower.setdefault(n.lower(), n)
    if expected is not None and list(expected) != list(names):
        add("[table]", "schema_mismatch", "high")
    spark = df.sparkSession
    schema = ("dataset string, column_name string, issue_type string, severity string, "
              "n_bad long, n_checked long, pct double")
    fixed = spark.createDataFrame(found, schema)
    empty = df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(dataset).alias("dataset"), F.lit("[table]").alias("column_name"), F.lit("empty_dataset").alias("issue_type"),
        F.lit("high").alias("severity"), F.lit(0).cast("long").alias("n_bad"), F.lit(0).cast("long").alias("n_checked"),
        F.lit(None).cast("double").alias("pct"),
    )
    return fixed.unionByName(empty)


def suppress(issues: DataFrame, issue_types: Iterable[str]) -> DataFrame:
    """Drop the findings a dataset is known to produce."""
    listed = list(issue_types)
    return issues.filter(~F.col("issue_type").isin(*listed)) if listed else issues


def suggest_checks(profile: DataFrame, semantics: DataFrame, not_null_share: float = 0.95) -> DataFrame:
    """Checks worth running next time, derived from a profile."""
    p = profile.join(F.broadcast(semantics.select("column_name", "semantic_type")), "column_name", "left")
    n = F.col("row_count") - F.col("null_count")
    rules = F.array_compact(F.array(
        F.when(1 - F.col("null_pct") >= not_null_share, "not_null"),
        F.when(F.col("is_key_candidate"), "unique"),
        F.when(F.col("semantic_type") == "email", "email_pattern"),
        F.when(F.col("semantic_type") == "uuid", "uuid_pattern"),
        F.when(F.col("semantic_type") == "date", "date_parseable"),
        F.when((F.col("unique_count") >= 1) & (F.col("unique_count") <= 25) & (n > 0), "in_set"),
    ))
    return p.select("dataset", "column_name", F.explode(rules).alias("suggested_check"))
