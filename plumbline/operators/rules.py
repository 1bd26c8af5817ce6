"""User rules supplied as data: value lists, assertions, conditions and cross-field rules."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import any_word, as_double, as_timestamp, col, infos, strip
from plumbline.operators.checks import finish_issues, no_issues
from plumbline.operators.profile import aggregate_long


def matches_column(key: str, dataset: str, column: str) -> bool:
    """``dataset.column`` or any dotted key that ends in it; a bare name fits every dataset."""
    k, full = key.lower().strip(), f"{dataset}.{column}".lower()
    return k in (full, column.lower()) or k.endswith("." + full) or (full.endswith("." + k) and "." in k)


def _text(name: str) -> Column:
    return F.trim(col(name).cast("string"))


def _number(name: str) -> Column:
    return as_double(F.trim(col(name).cast("string")))


def _outside(v: Column, low, high) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (v < float(low))
    if high is not None:
        bad = bad | (v > float(high))
    return bad


def referenced_columns(df: DataFrame, expression: str) -> list[str]:
    return [c for c in df.columns if re.search(rf"(?<![A-Za-z0-9_]){re.escape(c)}(?![A-Za-z0-9_])", expression)]


def rule_predicates(df: DataFrame, dataset: str, rules: list[dict]) -> list[dict]:
    """Turn rules into ``{issue_type, column, severity, bad, checked}`` with Column predicates."""
    out = []
    kinds = {i.name: i for i in infos(df)}

    def add(rule, issue, column, bad, checked, severity="medium"):
        out.append({"issue_type": issue, "column": column, "severity": rule.get("severity", severity),
                    "bad": F.coalesce(bad, F.lit(False)), "checked": checked})

    for rule in rules:
        kind = rule["type"]
        if rule.get("dataset") and not fnmatch.fnmatch(dataset, rule["dataset"]):
            continue
        if kind == "valid_values":
            for key, allowed in rule["values"].items():
                for name in df.columns:
                    if matches_column(key, dataset, name):
                        c = F.lower(col(name).cast("string"))
                        add(rule, "invalid_lookup_value", name, ~c.isin(*[str(v).lower() for v in allowed]), col(name).isNotNull())
        elif kind == "assertion":
            columns = referenced_columns(df, rule["assertion"])
            holds = F.coalesce(F.expr(rule["assertion"]), F.lit(False))
            add(rule, "custom_rule_violation", ",".join(columns) or "[formula]", ~holds, F.lit(True))
        elif kind == "formula":
            columns = referenced_columns(df, rule["assertion"])
            numbers = {c: _number(c) for c in columns}
            usable = reduce(lambda a, b: a & b, [v.isNotNull() for v in numbers.values()], F.lit(True))
            # each reference is read as a number, whatever the column's type
            text = rule["assertion"]
            for c in columns:
                text = re.sub(rf"(?<![A-Za-z0-9_]){re.escape(c)}(?![A-Za-z0-9_])", f"try_cast(trim(cast(`{c}` as string)) as double)", text)
            add(rule, "formula_rule_violation", ",".join(columns), usable & ~F.coalesce(F.expr(text), F.lit(False)), usable)
        elif kind == "conditional_not_null":
            when = _text(rule["when_column"]) == str(rule["when_value"])
            add(rule, kind, rule["then_column"], when & col(rule["then_column"]).isNull(), when)
        elif kind == "conditional_range":
            when, then = _text(rule["when_column"]) == str(rule["when_value"]), rule["then_column"]
            v = _number(then)
            bad = (v.isNull() & col(then).isNotNull()) | _outside(v, rule.get("min"), rule.get("max"))
            add(rule, kind, then, when & F.coalesce(bad, F.lit(False)), when)
        elif kind in ("mutual_exclusion", "at_least_one"):
            filled = F.size(F.array_compact(F.array(*[F.when(col(c).isNotNull(), F.lit(1)) for c in rule["columns"]])))
            bad = filled > 1 if kind == "mutual_exclusion" else filled == 0
            add(rule, kind, ",".join(rule["columns"]), bad, F.lit(True))
        elif kind in ("one_of", "not_one_of"):
            c = rule["column"]
            listed = col(c).cast("string").isin(*[str(v) for v in rule["params"]])
            add(rule, f"custom_{kind}", c, ~listed if kind == "one_of" else listed, col(c).isNotNull())
        elif kind in ("range", "domain"):
            c, p = rule["column"], rule.get("params", rule)
            v = _number(c)
            add(rule, "custom_range" if kind == "range" else "out_of_range", c, _outside(v, p.get("min"), p.get("max")), v.isNotNull())
        elif kind == "regex":
            c = rule["column"]
            add(rule, "custom_regex", c, ~col(c).cast("string").rlike(rule["params"]), col(c).isNotNull())
        elif kind == "not_null":
            c = rule["column"]
            add(rule, "custom_not_null", c, col(c).isNull() | (strip(col(c).cast("string")) == ""), F.lit(True))
        elif kind == "date_order":
            a, b = as_timestamp(kinds[rule["start"]]), as_timestamp(kinds[rule["end"]])
            add(rule, "cross_field_date_order", f"{rule['start']},{rule['end']}", b < a, a.isNotNull() & b.isNotNull())
        elif kind == "non_negative":
            v = _number(rule["column"])
            add(rule, "cross_field_non_negative", rule["column"], v < 0, v.isNotNull())
        elif kind == "allowed_pairs":
            a, b, pairs = rule["left"], rule["right"], rule["pairs"]
            flat = [x for k, v in pairs.items() if k != "*" for x in (F.lit(str(k)), F.array(*[F.lit(str(i)) for i in v]))]
            default = F.array(*[F.lit(str(i)) for i in pairs["*"]]) if "*" in pairs else F.lit(None)
            allowed = F.coalesce(F.try_element_at(F.create_map(*flat), col(a).cast("string")), default)
            both = col(a).isNotNull() & col(b).isNotNull()
            add(rule, "cross_field_allowed_pairs", f"{a},{b}",
                both & allowed.isNotNull() & ~F.array_contains(allowed, col(b).cast("string")), both)
        elif kind == "required_columns":
            for c in rule["columns"]:
                if c not in df.columns:
                    add(rule, "missing_required_column", c, F.lit(True), F.lit(True), "high")
        elif kind == "non_nullable":
            for c in rule["columns"]:
                add(rule, "non_nullable_has_nulls", c, col(c).isNull(), F.lit(True), "high")
        else:
            raise ValueError(f"unknown rule type {kind!r}")
    return out


def apply_rules(df: DataFrame, dataset: str, rules: list[dict]) -> DataFrame:
    """Issues for all rules from one aggregate scan; a value list of any length is one hash set per task."""
    rows = [
        {"dataset": dataset, "column_name": p["column"], "issue_type": p["issue_type"],
         "severity": p["severity"], "n_bad": F.count_if(p["bad"]), "n_checked": F.count_if(p["checked"])}
        for p in rule_predicates(df, dataset, rules)
    ]
    return finish_issues(aggregate_long(df, rows).filter("n_bad > 0")) if rows else no_issues(df.sparkSession)


def lookup_issues(df: DataFrame, dataset: str, column: str, allowed: DataFrame, severity: str = "medium") -> DataFrame:
    """Values missing from a lookup table of any size. Values are counted first, so the join sees
    each distinct value once and the size of neither side needs to be known."""
    counts = df.filter(col(column).isNotNull()).groupBy(F.lower(col(column).cast("string")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    names = allowed.select(F.lower(F.col(allowed.columns[0])).alias("v"), F.lit(True).alias("known")).distinct()
    totals = counts.join(names, "v", "left").agg(
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_bad"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"),
    )
    return finish_issues(totals.filter("n_bad > 0").select(
        F.lit(dataset).alias("dataset"), F.lit(column).alias("column_name"), F.lit("invalid_lookup_value").alias("issue_type"),
        F.lit(severity).alias("severity"), "n_bad", "n_checked"))


def rule_violations(df: DataFrame, dataset: str, rules: list[dict], key_cols: list[str]) -> DataFrame:
    """The rows behind the findings, one per broken rule."""
    key = F.concat_ws("|", *[col(k).cast("string") for k in key_cols])
    entries = F.array(*[
        F.when(p["bad"], F.struct(F.lit(p["issue_type"]).alias("issue_type"), F.lit(p["column"]).alias("column_name")))
        for p in rule_predicates(df, dataset, rules)
    ])
    return df.select(F.lit(dataset).alias("dataset"), key.alias("row_key"), F.inline(F.array_compact(entries)))


def all_null_columns(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """Non-nullable columns without a single value."""
    rows = [{"dataset": dataset, "column_name": c, "issue_type": "all_null_column", "severity": "high",
             "n_bad": F.count_if(col(c).isNull()), "n_checked": F.count(F.lit(1))} for c in columns]
    return finish_issues(aggregate_long(df, rows).filter("n_bad = n_checked AND n_checked > 0"))


def mine_rules(df: DataFrame, dataset: str, max_domain: int = 25, ordered: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rules the data already obeys: never-null columns, small domains, and ``a <= b`` pairs.

    Small domains come from the value census, the rest from one scan.
    """
    from plumbline.operators.census import value_census

    chosen = infos(df)
    numeric = [i.name for i in chosen if i.is_numeric and not i.is_id_like]
    dates = [i.name for i in chosen if i.kind == "date"]
    pairs = ordered if ordered is not None else [
        (a, b) for group in (numeric, dates) for a in group for b in group if a != b
    ]
    rows = [{"rule_type": "non_nullable", "column_name": i.name, "detail": "", "n_broken": F.count_if(col(i.name).isNull()),
             "n": F.count(F.lit(1))} for i in chosen]
    rows += [{"rule_type": "assertion", "column_name": f"{a},{b}", "detail": f"{a} <= {b}", "n_broken": F.count_if(col(a) > col(b)),
              "n": F.count_if(col(a).isNotNull() & col(b).isNotNull())} for a, b in pairs]
    held = aggregate_long(df, rows).filter("n_broken = 0 AND n > 0").select("rule_type", "column_name", "detail")
    texts = [i.name for i in chosen if i.kind == "text"]
    domains = None
    if texts:
        census = value_census(df, texts).filter("value IS NOT NULL")
        sizes = census.groupBy("column_name").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= max_domain)
        domains = (
            census.join(F.broadcast(sizes), "column_name")
            .groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("detail"))
            .select(F.lit("valid_values").alias("rule_type"), "column_name", "detail")
        )
    out = held if domains is None else held.unionByName(domains)
    return out.select(F.lit(dataset).alias("dataset"), "rule_type", "column_name", "detail")
