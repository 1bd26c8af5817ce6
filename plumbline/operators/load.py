"""Load operators: extracts, SCD merges, typed copies and reject quarantine, as functions that
return the new state; writing is a thin step on top."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.functions.columns import as_double, col, infos, parse_date, row_fingerprint, strip
from plumbline.operators.ordering import quantile_chunks
from plumbline.operators.transforms import email_value, order_number, phone_value, target_type

OPEN_END = "9999-12-31 00:00:00"


# --- extract -------------------------------------------------------------------------------------

def extract(df: DataFrame, mode: str, watermark: str | None = None, last_value=None) -> DataFrame:
    """Full, or only rows beyond the last watermark; the filter reaches the scan."""
    if mode == "full" or last_value is None:
        return df
    return df.filter(col(watermark) > F.lit(last_value).cast(df.schema[watermark].dataType))


def pick_watermark(df: DataFrame) -> str | None:
    """Modification-like date column first, else the first date-like column."""
    dated = [i for i in infos(df) if i.kind == "date" or any(w in i.lower for w in ("date", "time")) or i.lower.endswith("_at")]
    for i in dated:
        if any(w in i.lower for w in ("modified", "update", "change")) or i.lower.endswith("_at"):
            return i.name
    return dated[0].name if dated else None


def advance_watermark(state: DataFrame, process: str, df: DataFrame, watermark: str) -> DataFrame:
    """State with the process's new maximum; an empty batch keeps the old value."""
    new = df.agg(F.max(col(watermark)).cast("timestamp").alias("watermark")).filter("watermark IS NOT NULL").select(
        F.lit(process).alias("process"), "watermark")
    return state.select("process", "watermark").unionByName(new).groupBy("process").agg(F.max("watermark").alias("watermark"))


# --- merges --------------------------------------------------------------------------------------

def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which null is a value; ``right`` carries the keys as ``_key_<name>``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_key_{k}"]) for k in keys])


def renamed_keys(df: DataFrame, keys: list[str]) -> list[Column]:
    return [df[k].alias(f"_key_{k}") for k in keys]


def one_per_key(staged: DataFrame, keys: list[str], latest_by: str | None = None) -> DataFrame:
    """One row per key, null keys included: the latest, ties and missing order by the largest other values."""
    rest = [i.name for i in infos(staged) if i.name not in (*keys, latest_by) and i.kind != "nested"]
    order = [F.desc_nulls_last(col(c)) for c in [*([latest_by] if latest_by else []), *rest]] or [F.lit(0)]
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return staged.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def without_late(target: DataFrame, staged: DataFrame, keys: list[str], latest_by: str) -> DataFrame:
    """Staged rows that are not older than what the target holds of their key."""
    held = target.groupBy(*renamed_keys(target, keys)).agg(F.max(latest_by).alias("_held"))
    return staged.join(held, same_keys(staged, held, keys), "left").filter(
        F.col("_held").isNull() | (staged[latest_by] >= F.col("_held"))).select(*[staged[c] for c in staged.columns])


def merge_scd1(target: DataFrame, staged: DataFrame, keys: list[str], mode: str = "incremental") -> DataFrame:
    """Full: the staged table replaces the target. Incremental: matching keys are replaced.

    Null keys match null keys. Of several staged rows of a key one is taken (``one_per_key``).
    """
    if mode == "full":
        return staged
    staged = one_per_key(staged, keys)
    touched = staged.select(*renamed_keys(staged, keys)).distinct()
    kept = target.join(touched, same_keys(target, touched, keys), "left_anti")
    return kept.unionByName(staged, allowMissingColumns=True)


def merge_scd2(target: DataFrame, staged: DataFrame, keys: list[str], as_of: str, mode: str = "always") -> DataFrame:
    """Expire the current row of every staged key and append the new current row.

    Null keys match null keys, and of several staged rows of a key one is taken (``one_per_key``).
    ``only_changed`` leaves keys alone whose attributes hash to the same value. Only the current
    rows take part in the join; history passes through untouched.
    """
    staged = one_per_key(staged, keys)
    attributes = [c for c in staged.columns if c not in keys]
    start = F.to_timestamp(F.lit(as_of))
    history, current = target.filter(~F.col("is_current")), target.filter("is_current")
    new = staged
    if mode == "only_changed":
        def fingerprint(df):
            return F.struct(*row_fingerprint([i for i in infos(df) if i.name in attributes]))

        known = current.select(*renamed_keys(current, keys), fingerprint(current).alias("_old"))
        marked = staged.withColumn("_new", fingerprint(staged))
        new = marked.join(known, same_keys(marked, known, keys), "left").filter(
            F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).select(*staged.columns)
    touched = new.select(*renamed_keys(new, keys), F.lit(True).alias("_touched")).distinct()
    expired = current.join(touched, same_keys(current, touched, keys), "left").drop(*[f"_key_{k}" for k in keys]).withColumn(
        "valid_to", F.when(F.col("_touched"), start).otherwise(F.col("valid_to"))
    ).withColumn("is_current", F.col("_touched").isNull()).drop("_touched")
    opened = new.withColumn("valid_from", start).withColumn("valid_to", F.to_timestamp(F.lit(OPEN_END))).withColumn("is_current", F.lit(True))
    return history.unionByName(expired).unionByName(opened)


def start_scd2(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumn("valid_from", F.to_timestamp(F.lit(as_of))).withColumn(
        "valid_to", F.to_timestamp(F.lit(OPEN_END))).withColumn("is_current", F.lit(True))


def history_as_of(target: DataFrame, moment: str) -> DataFrame:
    at = F.to_timestamp(F.lit(moment))
    return target.filter((F.col("valid_from") <= at) & (F.col("valid_to") > at))


def validity_from_events(df: DataFrame, keys: list[str], changed_at: str) -> DataFrame:
    """History table from change events: each row is valid until the next change of its key.

    A key's events are cut into quantile chunks of time, so a hot key is spread over tasks; the last
    event of a chunk takes its end from the first event of the key's next chunk.
    """
    tagged = quantile_chunks(df, order_number(df, changed_at))
    firsts = tagged.groupBy(*keys, "_chunk").agg(F.min(changed_at).alias("_first"))
    following_chunk = firsts.select(
        *keys, "_chunk", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_next_chunk"))
    local = tagged.withColumn("_next", F.lead(changed_at).over(Window.partitionBy(*keys, "_chunk").orderBy(changed_at)))
    condition = [local[k].eqNullSafe(following_chunk[k]) for k in [*keys, "_chunk"]]
    joined = local.join(following_chunk, condition, "left").select(*[local[c] for c in local.columns], following_chunk["_next_chunk"])
    following = F.coalesce("_next", "_next_chunk")
    return joined.withColumn("valid_from", F.col(changed_at)).withColumn(
        "valid_to", F.coalesce(following, F.lit(OPEN_END).cast(df.schema[changed_at].dataType))
    ).withColumn("is_current", following.isNull()).drop("_next", "_next_chunk", "_chunk")


def append(target: DataFrame, staged: DataFrame) -> DataFrame:
    return target.unionByName(staged, allowMissingColumns=True)


def typed_copy(df: DataFrame, batch_id: str, loaded_at: str, types: dict[str, str] | None = None) -> DataFrame:
    """Every column cast to its load type (bad values become null) plus audit columns."""
    types = types or {}
    cast = [
        (F.trim(col(i.name)) if i.kind == "text" else col(i.name)).try_cast(types.get(i.name) or target_type(i.name, i.dtype)).alias(i.name)
        if i.kind != "nested" else col(i.name)
        for i in infos(df)
    ]
    moment = F.to_timestamp(F.lit(loaded_at))
    return df.select(*cast, F.lit(batch_id).alias("etl_batch_id"), moment.alias("etl_created_at"), moment.alias("etl_updated_at"))


# --- rejects -------------------------------------------------------------------------------------

@dataclass
class LoadRules:
    """Which columns a staged row must satisfy."""

    keys: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    emails: list[str] = field(default_factory=list)
    phones: list[str] = field(default_factory=list)
    any_of: list[list[str]] = field(default_factory=list)

    def reasons(self) -> list[tuple[str, str, Column, bool]]:
        """(reason, column, bad-row predicate, rejects): audits do not reject."""
        def blank(c):
            return col(c).isNull() | (strip(col(c).cast("string")) == "")

        out = [("null_key", c, blank(c), True) for c in self.keys]
        out += [("invalid_numeric", c, col(c).isNotNull() & as_double(F.trim(col(c).cast("string"))).isNull(), True) for c in self.numeric]
        out += [("null_required", c, blank(c), True) for c in self.required]
        out += [("invalid_date", c, ~blank(c) & parse_date(F.trim(col(c).cast("string"))).isNull(), False) for c in self.dates]
        out += [("invalid_email", c, ~blank(c) & email_value(col(c), strict=True).isNull(), c in self.required) for c in self.emails]
        out += [("invalid_phone", c, ~blank(c) & phone_value(col(c), strict=True).isNull(), c in self.required) for c in self.phones]
        out += [("all_null_group", ",".join(g), F.coalesce(*[col(c).cast("string") for c in g]).isNull(), True) for g in self.any_of]
        return [(r, c, F.coalesce(p, F.lit(False)), hard) for r, c, p, hard in out]


def tag_rejects(df: DataFrame, rules: LoadRules) -> DataFrame:
    """Add ``_reasons``: every broken rule of the row, from one projection."""
    entries = [
        F.when(p, F.struct(F.lit(r).alias("reason"), F.lit(c).alias("column_name"), F.lit(hard).alias("rejects")))
        for r, c, p, hard in rules.reasons()
    ]
    return df.withColumn("_reasons", F.array_compact(F.array(*entries)))


def clean_values(df: DataFrame, rules: LoadRules, every: bool = False) -> DataFrame:
    """Null the values that break a soft rule (every rule under never-drop-rows)."""
    for reason, c, bad, hard in rules.reasons():
        if "," not in c and reason not in ("null_key", "null_required") and (every or not hard):
            df = df.withColumn(c, F.when(~bad, col(c)))
    return df


def split_rejects(df: DataFrame, rules: LoadRules, process: str, table: str, at: str, never_drop_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``. Quarantine has one row per broken rule with the row as JSON.

    With ``never_drop_rows`` nothing is rejected: offending values become null.
    """
    tagged = tag_rejects(df, rules)
    payload = F.to_json(F.struct(*[col(c) for c in df.columns]))
    quarantine = tagged.filter(F.size("_reasons") > 0).select(
        F.lit(process).alias("process"), F.lit(table).alias("table_name"), payload.alias("row_json"), F.explode("_reasons").alias("r")
    ).select("process", "table_name", "row_json", "r.reason", "r.column_name", "r.rejects", F.to_timestamp(F.lit(at)).alias("rejected_at"))
    if never_drop_rows:
        return clean_values(df, rules, every=True), quarantine
    good = tagged.filter(~F.exists("_reasons", lambda r: r.rejects)).drop("_reasons")
    return clean_values(good, rules), quarantine


# --- run control ---------------------------------------------------------------------------------

def assert_loaded(target: DataFrame, staged: DataFrame) -> DataFrame:
    """One row; ``ok`` is false when staging has rows and the target is empty."""
    a = target.limit(1).agg(F.count(F.lit(1)).alias("target_has"))
    b = staged.limit(1).agg(F.count(F.lit(1)).alias("staged_has"))
    return a.crossJoin(F.broadcast(b)).withColumn("ok", ~((F.col("staged_has") > 0) & (F.col("target_has") == 0)))


def require_loaded(target: DataFrame, staged: DataFrame) -> None:
    """Fails the load when staging has rows and the target is empty."""
    if not assert_loaded(target, staged).first()["ok"]:
        raise ValueError("staging has rows but the target is empty")


def append_run_log(entry: DataFrame, path: str) -> None:
    """Adds start, end, status or error of a run to the log."""
    entry.coalesce(1).write.mode("append").parquet(path)


def last_runs(spark, path: str) -> DataFrame:
    """The last entry of every process in the log."""
    w = Window.partitionBy("process").orderBy(F.desc("started"), F.desc_nulls_last("ended"))
    return spark.read.parquet(path).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def run_log_row(spark, process: str, started: str, ended: str | None, status: str, error: str | None = None) -> DataFrame:
    return spark.createDataFrame([(process, started, ended, status, error)],
                                 "process string, started string, ended string, status string, error string").select(
        "process", F.to_timestamp("started").alias("started"), F.to_timestamp("ended").alias("ended"), "status", "error")
