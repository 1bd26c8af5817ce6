"""Ordered cleaning: steps given as data are sorted into fixed phases and folded over a table.

``run_steps`` takes steps that change values only. ``run_plan`` takes all: its state is the table of good rows and the
rows that left it, each with the step that turned it out, so a plan returns (good, rejects, audit). All rejecting steps
of a phase become one tagged projection, whatever their number; it is checkpointed, and both sides read that.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, col, infos, row_fingerprint, strip
from plumbline.operators.load import typed_copy
from plumbline.operators.transforms import ACTIONS, flatten_json_text, flatten_nested
from plumbline.session import checkpoint

# Phase order of the actions.
PHASES = (
    ("standardize", ("trim", "lowercase", "uppercase", "tidy_text", "tidy_id", "replace_values", "regex_replace", "standardize_boolean")),
    ("nulls", ("zero_to_null", "fill_nulls")),
    ("validate", ("sanitize_email", "normalize_phone")),
    ("reject", ("reject_null", "reject_unlisted", "reject_unmatched", "reject_outside", "reject_when", "reject_all_null")),
    ("types", ("coerce_numeric", "cast_type", "parse_dates", "currency_normalize", "nullify_future_dates", "range_clip")),
    ("outliers", ("flag_outliers", "clip_outliers", "cap_outliers")),
    ("privacy", ("hash", "mask")),
    ("shape", ("flatten", "drop_column")),
    ("orphans", ("reject_orphans",)),
    ("deduplicate", ("deduplicate",)),
    ("copy", ("copy",)),
)
ORDER = {action: k for k, (_, actions) in enumerate(PHASES) for action in actions}
PHASE_OF = {action: phase for phase, actions in PHASES for action in actions}
PLAN_ONLY = {a for phase, actions in PHASES if phase in ("reject", "orphans", "deduplicate", "copy") for a in actions} | {"flatten"}
REJECTS = "step_no int, phase string, reason string, column_name string, row_json string"
TRANSFORM_ACTIONS = {"flag_outliers", "clip_outliers", "cap_outliers", "hash", "mask", "drop_column"}


@dataclass(frozen=True)
class Step:
    action: str
    column: str
    params: dict = field(default_factory=dict)


def ordered(steps: list[Step]) -> list[Step]:
    return sorted(steps, key=lambda s: ORDER[s.action])


def run_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Phase order, then the given order. Row-wise steps collapse into one projection."""
    beyond = sorted({s.action for s in steps} & PLAN_ONLY)
    if beyond:
        raise ValueError(f"{', '.join(beyond)}: only run_plan can run these, they change which rows there are")
    for s in ordered(steps):
        df = ACTIONS[s.action](df, s.column, **s.params)
    return df


def split_phases(steps: list[Step]) -> tuple[list[Step], list[Step]]:
    """Cleansing steps, and the transform steps that run only behind the gate."""
    return ([s for s in steps if s.action not in TRANSFORM_ACTIONS], [s for s in steps if s.action in TRANSFORM_ACTIONS])


def run_gated(df: DataFrame, steps: list[Step], passed: bool) -> tuple[DataFrame, DataFrame | None]:
    """Cleansed table, and the transformed one when the gate passed."""
    cleanse, transform = split_phases(steps)
    clean = run_steps(df, cleanse)
    return clean, (run_steps(clean, transform) if passed else None)


# --- plans with side outputs ----------------------------------------------------------------------

@dataclass
class Outcome:
    """Good rows, rows that left (``REJECTS``: a row once per reason), and rows that were changed instead of rejected."""

    good: DataFrame
    rejects: DataFrame
    audit: DataFrame


def broken(df: DataFrame, step: Step) -> Column:
    """Whether a row breaks a rejecting step; null where the rule says nothing is false."""
    p = step.params
    if step.action == "reject_when":
        found = F.expr(p["condition"])
    elif step.action == "reject_all_null":
        found = F.coalesce(*[col(c).cast("string") for c in p["columns"]]).isNull()
    else:
        c = col(step.column)
        if step.action == "reject_null":
            found = c.isNull() | (strip(c.cast("string")) == "")
        elif step.action == "reject_unlisted":
            found = ~F.lower(c.cast("string")).isin(*[str(v).lower() for v in p["allowed"]])
        elif step.action == "reject_unmatched":
            found = ~c.cast("string").rlike(p["pattern"])
        else:
            v = as_double(F.trim(c.cast("string")))
            found = c.isNotNull() & (v.isNull() | (v < p.get("low", float("-inf"))) | (v > p.get("high", float("inf"))))
    return F.coalesce(found, F.lit(False))


def _turned_out(df: DataFrame, number, phase: str, reason, column) -> DataFrame:
    """Rows of ``df`` as rejects; the arguments are columns or values."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    payload = F.to_json(F.struct(*[col(c) for c in df.columns if not c.startswith("_plan_")]), {"ignoreNullFields": "false"})
    return df.select(lit(number).cast("int").alias("step_no"), F.lit(phase).alias("phase"), lit(reason).alias("reason"), lit(column).alias("column_name"), payload.alias("row_json"))


def _reject(df: DataFrame, steps: list[tuple[int, Step]], never_drop: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rejecting steps at once: every step judges the row as the phase found it, so their order does not matter."""
    entries = [
        F.when(broken(df, s), F.struct(F.lit(n).alias("n"), F.lit(s.params.get("reason", s.action)).alias("reason"), F.lit(s.column).alias("column")))
        for n, s in steps]
    tagged = checkpoint(df.withColumn("_plan_why", F.array_compact(F.array(*entries))))
    some = tagged.filter(F.size("_plan_why") > 0)
    listed = _turned_out(some.withColumn("_plan_r", F.explode("_plan_why")), F.col("_plan_r.n"), "reject", F.col("_plan_r.reason"), F.col("_plan_r.column"))
    if not never_drop:
        return tagged.filter(F.size("_plan_why") == 0).drop("_plan_why"), listed, listed.limit(0)
    names = sorted({s.column for _, s in steps if s.action not in ("reject_when", "reject_all_null")})
    hit = lambda c: F.exists("_plan_why", lambda r: r["column"] == F.lit(c))
    kept = tagged.withColumns({c: F.when(~hit(c), col(c)) for c in names}).drop("_plan_why")
    return kept, listed.limit(0), listed


def _orphans(df: DataFrame, n: int, s: Step) -> tuple[DataFrame, DataFrame]:
    """Rows whose key no row of the table ``parent`` has; null keys stay. Parents are counted before they are joined."""
    known = s.params["parent"].select(col(s.params["parent_key"]).alias("_plan_k")).filter("_plan_k IS NOT NULL").distinct()
    keyed = checkpoint(df)
    same = col(s.column) == F.col("_plan_k")
    lost = keyed.filter(col(s.column).isNotNull()).join(known, same, "left_anti")
    good = keyed.filter(col(s.column).isNotNull()).join(known, same, "left_semi").unionByName(keyed.filter(col(s.column).isNull()))
    return good, _turned_out(lost, n, "orphans", s.params.get("reason", "orphan"), s.column)


def _duplicates(df: DataFrame, n: int, s: Step) -> tuple[DataFrame, DataFrame]:
    """All rows but the first of each key, in the order given (``order_by``, the last one with ``latest``); ties by the whole row.

    Rows with a key that is wholly null are no copies of each other. The first row of a key comes from an aggregate, which
    map tasks reduce, and both sides are told apart by row numbers: a hot key is one row wherever rows meet.
    """
    columns = s.params.get("columns") or [s.column]
    latest = s.params.get("latest", False)
    given = [part for c in s.params.get("order_by", []) for part in (col(c).isNotNull() if latest else col(c).isNull(), col(c))]
    rows = checkpoint(df.withColumn("_plan_id", F.monotonically_increasing_id()))
    place = F.struct(*[c.alias(f"o{k}") for k, c in enumerate([*given, *row_fingerprint(infos(df)), F.col("_plan_id")])])
    keyed = rows.filter(F.coalesce(*[col(c).cast("string") for c in columns]).isNotNull())
    firsts = keyed.groupBy(*[col(c) for c in columns]).agg((F.max_by if latest else F.min_by)("_plan_id", place).alias("_plan_first"))
    lost = checkpoint(keyed.select("_plan_id").join(firsts.select(F.col("_plan_first").alias("_plan_id")), "_plan_id", "left_anti"))
    good = rows.join(lost, "_plan_id", "left_anti").drop("_plan_id")
    return good, _turned_out(rows.join(lost, "_plan_id", "left_semi"), n, "deduplicate", s.params.get("reason", "duplicate"), ",".join(columns))


def run_plan(df: DataFrame, steps: list[Step], never_drop_rows: bool = False) -> Outcome:
    """All steps in phase order. A row leaves at the first phase that turns it out, with every reason of that phase.

    With ``never_drop_rows`` rejecting steps null the value instead and orphan keys become null; what they would have
    turned out is in ``audit``. Duplicates are dropped all the same. Steps are numbered as given, from 0.
    """
    numbered = sorted(enumerate(steps), key=lambda x: ORDER[x[1].action])
    empty = df.sparkSession.createDataFrame([], REJECTS)
    rejects, audit = [empty], [empty]
    for phase, _ in PHASES:
        mine = [(n, s) for n, s in numbered if PHASE_OF[s.action] == phase]
        if not mine:
            continue
        if phase == "reject":
            df, out, seen = _reject(df, mine, never_drop_rows)
            rejects.append(out)
            audit.append(seen)
            continue
        for n, s in mine:
            if phase == "orphans":
                good, out = _orphans(df, n, s)
                if never_drop_rows:
                    known = s.params["parent"].select(col(s.params["parent_key"]).alias("_plan_k")).filter("_plan_k IS NOT NULL").distinct()
                    lost = df.filter(col(s.column).isNotNull()).join(known, col(s.column) == F.col("_plan_k"), "left_anti")
                    good = good.unionByName(lost.withColumn(s.column, F.lit(None).cast(df.schema[s.column].dataType)))
                    audit.append(out)
                else:
                    rejects.append(out)
                df = good
            elif phase == "deduplicate":
                df, out = _duplicates(df, n, s)
                rejects.append(out)
            elif s.action == "flatten":
                df = flatten_json_text(df, s.column, s.params["schema"]) if "schema" in s.params else flatten_nested(df, **s.params)
            elif s.action == "copy":
                df = typed_copy(df, **s.params)
            else:
                df = ACTIONS[s.action](df, s.column, **s.params)
    return Outcome(df, reduce(DataFrame.unionByName, rejects), reduce(DataFrame.unionByName, audit))


def plan_summary(outcome: Outcome) -> DataFrame:
    """step_no, phase, reason, column_name, n_rows of what a plan turned out or changed, and one row for the good rows."""
    counted = outcome.rejects.withColumn("kind", F.lit("rejected")).unionByName(outcome.audit.withColumn("kind", F.lit("changed")))
    by_step = counted.groupBy("kind", "step_no", "phase", "reason", "column_name").agg(F.count(F.lit(1)).alias("n_rows"))
    good = outcome.good.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("good").alias("kind"), F.lit(None).cast("int").alias("step_no"), *[F.lit(None).cast("string").alias(c) for c in ("phase", "reason", "column_name")], "n_rows")
    return by_step.unionByName(good)
