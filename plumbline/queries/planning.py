"""Queries for plans with rejects and for sources that break while they are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.steps import Step, plan_summary, run_plan
from plumbline.queries.registry import query
from plumbline.session import scratch_dir
from plumbline.sources.readers import Catalog

EMAIL = "^[a-z0-9.]+@[a-z0-9.]+[.][a-z]+$"


def _contact_steps(t) -> list[Step]:
    return [
        Step("deduplicate", "account_uuid", {"order_by": ["cust_id"]}),
        Step("reject_unmatched", "email", {"pattern": EMAIL, "reason": "bad_email"}),
        Step("trim", "email"), Step("lowercase", "email"), Step("trim", "full_name"),
        Step("reject_null", "full_name", {"reason": "no_name"}),
        Step("reject_unlisted", "status", {"allowed": ["active", "closed"], "reason": "unknown_status"}),
        Step("reject_outside", "age", {"low": 0, "high": 120}),
        Step("reject_when", "city", {"condition": "city = 'Elsewhere' AND age > 30", "reason": "elsewhere"}),
        Step("reject_orphans", "cust_id", {"parent": t["orders"], "parent_key": "o_custkey", "reason": "no_order"}),
    ]


_TIDY = """
SELECT cust_id, trim(full_name) AS full_name, lower(trim(email)) AS email, status, age, city, account_uuid FROM contacts"""
_RULES = [
    (1, "bad_email", "email", f"email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL}')"),
    (5, "no_name", "full_name", "full_name IS NULL OR trim(full_name) = ''"),
    (6, "unknown_status", "status", "status IS NOT NULL AND lower(status) NOT IN ('active', 'closed')"),
    (7, "reject_outside", "age", "age < 0 OR age > 120"),
    (8, "elsewhere", "city", "city = 'Elsewhere' AND age > 30"),
]
_REJECTED = " UNION ALL ".join(f"SELECT cust_id, {n} AS step_no, 'reject' AS phase, '{reason}' AS reason, '{c}' AS column_name FROM tidy WHERE {rule}" for n, reason, c, rule in _RULES)
_PLAN = f"""SELECT * FROM (
WITH tidy AS ({_TIDY}), r AS ({_REJECTED}), kept AS (SELECT * FROM tidy WHERE cust_id NOT IN (SELECT cust_id FROM r)),
 keyed AS (SELECT * FROM kept WHERE cust_id IN (SELECT o_custkey FROM orders)), ranked AS (SELECT *, row_number() OVER (PARTITION BY account_uuid ORDER BY cust_id) AS k FROM keyed),
 gone AS (SELECT * FROM r UNION ALL SELECT cust_id, 9, 'orphans', 'no_order', 'cust_id' FROM kept WHERE cust_id NOT IN (SELECT o_custkey FROM orders)
   UNION ALL SELECT cust_id, 0, 'deduplicate', 'duplicate', 'account_uuid' FROM ranked WHERE k > 1)"""


@query("plan_good_rows", "J10", _PLAN + " SELECT cust_id, full_name, email, status, age FROM ranked WHERE k = 1) q")
def _(t):
    return run_plan(t["contacts"], _contact_steps(t)).good.select("cust_id", "full_name", "email", "status", "age")


@query("plan_rejected_rows", "J10", _PLAN + " SELECT cust_id, CAST(step_no AS INTEGER) AS step_no, phase, reason, column_name FROM gone) q")
def _(t):
    out = run_plan(t["contacts"], _contact_steps(t)).rejects
    return out.select(F.get_json_object("row_json", "$.cust_id").cast("long").alias("cust_id"), "step_no", "phase", "reason", "column_name")


@query("plan_summary", "J10", _PLAN + """
SELECT 'rejected' AS kind, CAST(step_no AS INTEGER) AS step_no, phase, reason, column_name, count(*) AS n_rows FROM gone GROUP BY ALL
UNION ALL SELECT 'good', NULL, NULL, NULL, NULL, count(*) FROM ranked WHERE k = 1) q""")
def _(t):
    return plan_summary(run_plan(t["contacts"], _contact_steps(t)))


@query("plan_never_drops_rows", "J10", f"""SELECT * FROM (
WITH tidy AS ({_TIDY}), changed AS (SELECT cust_id, account_uuid, CASE WHEN {_RULES[0][3]} THEN NULL ELSE email END AS email, CASE WHEN {_RULES[1][3]} THEN NULL ELSE full_name END AS full_name,
  CASE WHEN {_RULES[2][3]} THEN NULL ELSE status END AS status, CASE WHEN {_RULES[3][3]} THEN NULL ELSE age END AS age FROM tidy),
 keyed AS (SELECT CASE WHEN cust_id IN (SELECT o_custkey FROM orders) THEN cust_id END AS cust_id, account_uuid, email, full_name, status, age FROM changed)
SELECT count(*) AS n_rows, count(cust_id) AS n_ids, count(email) AS n_emails, count(full_name) AS n_names, count(status) AS n_statuses, count(age) AS n_ages FROM keyed) q""")
def _(t):
    steps = [s for s in _contact_steps(t) if s.action != "deduplicate"]
    good = run_plan(t["contacts"], steps, never_drop_rows=True).good
    return good.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count(c).alias(n) for c, n in (("cust_id", "n_ids"), ("email", "n_emails"), ("full_name", "n_names"), ("status", "n_statuses"), ("age", "n_ages"))])


@query("source_broken_files", "A10", """
SELECT bucket, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS sum_keys, CAST(2 AS BIGINT) AS n_failures FROM (SELECT *, CAST(o_orderkey % 10 AS INTEGER) AS bucket FROM orders) o
WHERE bucket NOT IN (3, 8) GROUP BY bucket""")
def _(t):
    """Orders in ten folders; the files of two of them are no Parquet. The rest loads, each bad file is an error."""
    folder = f"{scratch_dir(t.spark)}/orders_parquet"
    rows = t["orders"].select("o_orderkey", F.pmod("o_orderkey", F.lit(10)).cast("int").alias("bucket"))
    rows.filter("bucket NOT IN (3, 8)").repartition("bucket").write.partitionBy("bucket").parquet(folder)
    rows.filter("bucket IN (3, 8)").select(F.col("o_orderkey").cast("string").alias("value"), "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").text(folder)
    found = Catalog(t.spark).load([{"path": folder, "format": "parquet", "name": "orders"}], verify=True)
    n = found.errors().agg(F.count(F.lit(1)).alias("n_failures"))
    return found.tables["orders"].groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("sum_keys")).crossJoin(F.broadcast(n))


@query("stream_merge_compacted", "K5", """
SELECT user_id, event_type, n_versions FROM (SELECT user_id, event_type, CAST(1 AS BIGINT) AS n_versions, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) e WHERE k = 1""")
def _(t):
    """The last event of each user, merged day group by day group, then compacted into one version."""
    from plumbline.operators.integrity import keep_latest
    from plumbline.operators.load import merge_scd1
    from plumbline.streaming import streams

    path = f"{scratch_dir(t.spark)}/users"
    events = t["events"].select("user_id", "event_type", "ts")
    for k in range(3):
        newest = keep_latest(events.filter(F.pmod(F.xxhash64("ts"), F.lit(3)) == k), ["user_id"], "ts", ["event_type"])

        def merge(target, new):
            if target is None:
                return new
            return merge_scd1(target, streams.without_late(target, new, ["user_id"], "ts"), ["user_id"])

        streams.merge_into_buckets(newest, path, ["user_id"], merge, k, 8, compact_after=None)
    streams.compact(t.spark, path, ["user_id"])
    n = streams.live_versions(t.spark, path)
    return streams.read_merged(t.spark, path).select("user_id", "event_type", F.lit(n).cast("long").alias("n_versions"))


@query("stream_window_drift", "K3", """
WITH m AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS d, CAST(count(*) AS DOUBLE) AS n_rows, round(count(*) FILTER (WHERE value < 5) / CAST(count(*) AS DOUBLE), 6) AS low,
   round(count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS error FROM events GROUP BY 1),
 c AS (SELECT * FROM m WHERE strftime(d, '%Y-%m-%d') < (SELECT strftime(max(ts) - INTERVAL 1 DAY, '%Y-%m-%d') FROM events)),
 p AS (SELECT *, lag(n_rows) OVER w AS pn, lag(low) OVER w AS pl, lag(error) OVER w AS pe FROM c WINDOW w AS (ORDER BY d))
SELECT strftime(d, '%Y-%m-%d') AS day, 'row_count_drift' AS signal, 'n_rows' AS metric, pn AS before, n_rows AS after FROM p WHERE abs(n_rows - pn) > 0.03 * pn
UNION ALL SELECT strftime(d, '%Y-%m-%d'), 'rate_drift', 'low', pl, low FROM p WHERE abs(low - pl) > 0.01
UNION ALL SELECT strftime(d, '%Y-%m-%d'), 'rate_drift', 'error', pe, error FROM p WHERE abs(error - pe) > 0.01""")
def _(t):
    from plumbline.queries.sourcing import stream_of
    from plumbline.streaming import streams

    base = scratch_dir(t.spark)
    bad = {"low": F.col("value") < 5, "error": F.col("event_type") == "error"}
    streams.stream_window_drift(stream_of(t, "events"), "ts", bad, base + "/drift", base + "/ck", rate_change=0.01, row_change=0.03).awaitTermination()
    return streams.read_window_drift(t.spark, base + "/drift").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "signal", "metric", "before", "after")


@query("profile_json_paths", "B8 C73", """
WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 5 = 0 THEN 'deep' ELSE 'flat' END AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1),
 t(k, path, type) AS (VALUES ('bad', '$', 'invalid'), ('deep', '$', 'object'), ('flat', '$', 'object'), ('flat', '$.k', 'integer'), ('deep', '$.k', 'string'), ('deep', '$.l', 'array'),
   ('deep', '$.l[]', 'integer'), ('deep', '$.l[]', 'number'), ('deep', '$.l[]', 'object'), ('deep', '$.l[].m', 'null')),
 c AS (SELECT path, type, CAST(sum(n) AS BIGINT) AS n FROM e JOIN t USING (k) GROUP BY path, type)
SELECT path, type, n, round(n / CAST(sum(n) OVER (PARTITION BY path) AS DOUBLE), 6) AS share FROM c""")
def _(t):
    from plumbline.operators import profile

    text = F.when(F.col("event_id") % 7 == 0, "{oops}").when(F.col("event_id") % 5 == 0, '{"k": "text", "l": [1, 2.5, {"m": null}]}').otherwise(F.col("props"))
    return profile.json_path_types(t["events"].filter("props IS NOT NULL").select(text.alias("j")), "j")
