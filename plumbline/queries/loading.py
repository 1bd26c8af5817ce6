"""Queries for joins, integrity, de-duplication and loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import integrity as it
from plumbline.operators import load
from plumbline.operators.load import LoadRules
from plumbline.operators.transforms import prefix_columns
from plumbline.queries.profiling import parsed_sql
from plumbline.session import scratch_dir
from plumbline.queries.registry import matches, query

_FK = "cust_id IN (SELECT c_custkey FROM customer)"


@query("join_parent_left", "I1 H32", """
SELECT order_id, total_price, cust_id, c_name AS customer_c_name, c_acctbal AS customer_c_acctbal FROM orders_fk LEFT JOIN customer ON c_custkey = cust_id""")
def _(t):
    return it.join_parent(t["orders_fk"], t["customer"], "cust_id", "c_custkey", "left", "customer_:all").select(
        "order_id", "total_price", "cust_id", "customer_c_name", "customer_c_acctbal")


@query("join_parent_inner", "I1", "SELECT order_id, cust_id, c_mktsegment FROM orders_fk JOIN customer ON c_custkey = cust_id")
def _(t):
    return it.join_parent(t["orders_fk"], t["customer"], "cust_id", "c_custkey", "inner").select("order_id", "cust_id", "c_mktsegment")


@query("join_fact_view", "I2", """
SELECT n_nationkey, n.name, r.name AS region_name FROM (SELECT n_nationkey, n_name AS name, n_regionkey AS regionkey FROM nation) n JOIN (SELECT r_regionkey AS regionkey, r_name AS name FROM region) r ON n.regionkey = r.regionkey""")
def _(t):
    nation = t["nation"].withColumnsRenamed({"n_name": "name", "n_regionkey": "regionkey"})
    region = t["region"].withColumnsRenamed({"r_name": "name", "r_regionkey": "regionkey"})
    return it.join_parent(nation, region, "regionkey", "regionkey", "inner", "region_").select("n_nationkey", "name", "region_name")


@query("join_never_drops_rows", "I3", "SELECT order_id, c_name FROM orders_fk LEFT JOIN customer ON c_custkey = cust_id")
def _(t):
    return it.join_parent(t["orders_fk"], t["customer"], "cust_id", "c_custkey", "inner", never_drop_rows=True).select("order_id", "c_name")


@query("join_many_to_many_bridge", "I4", "SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def _(t):
    return it.bridge(t["customer"], t["supplier"], "c_nationkey", "s_nationkey")


@query("integrity_reject_orphans", "I5", f"""
SELECT order_id, cust_id, 'kept' AS part FROM orders_fk WHERE cust_id IS NULL OR {_FK} UNION ALL SELECT order_id, cust_id, 'rejected' FROM orders_fk WHERE NOT ({_FK})""")
def _(t):
    good, bad = it.enforce_reference(t["orders_fk"], t["customer"], "cust_id", "c_custkey")
    return good.select("order_id", "cust_id", F.lit("kept").alias("part")).unionByName(bad.select("order_id", "cust_id", F.lit("rejected").alias("part")))


@query("integrity_null_fill", "I6", f"SELECT order_id, CASE WHEN {_FK} THEN cust_id END AS cust_id FROM orders_fk")
def _(t):
    return it.enforce_reference(t["orders_fk"], t["customer"], "cust_id", "c_custkey", "null_fill_fk").select("order_id", "cust_id")


@query("integrity_unknown_parents", "I7", """
SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT DISTINCT cust_id, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM orders_fk WHERE cust_id NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    return it.enforce_reference(t["orders_fk"], t["customer"], "cust_id", "c_custkey", "create_unknown_dim_record").select("c_custkey", "c_name", "c_nationkey")


@query("integrity_flag_orphans", "I8", f"SELECT order_id, cust_id IS NOT NULL AND NOT coalesce({_FK}, FALSE) AS cust_id_orphan FROM orders_fk")
def _(t):
    return it.enforce_reference(t["orders_fk"], t["customer"], "cust_id", "c_custkey", "flag").select("order_id", "cust_id_orphan")


@query("dedup_whole_rows", "I9", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipmode_x FROM lines_dup")
def _(t):
    return it.drop_duplicates(t["lines_dup"])


@query("dedup_first_by_order", "I9", """
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(t):
    return it.drop_duplicates(t["orders"], ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("dedup_keep_latest", "I10", """
SELECT lower(trim(priority)) AS priority, customer_id, order_id FROM (SELECT order_id, customer_id, order_date, CASE WHEN order_id % 2 = 0 THEN ' ' || priority ELSE lower(priority) END AS priority FROM shipments) s
QUALIFY row_number() OVER (PARTITION BY lower(trim(priority)), customer_id ORDER BY order_date DESC, order_id DESC) = 1""")
def _(t):
    messy = t["shipments"].withColumn("priority", F.when(F.col("order_id") % 2 == 0, F.concat(F.lit(" "), "priority")).otherwise(F.lower("priority")))
    return it.keep_latest(messy, ["priority", "customer_id"], "order_date", ["order_id"]).select(
        F.lower(F.trim("priority")).alias("priority"), "customer_id", "order_id")


@query("config_lookup_tables", "I12", """
SELECT cust_id, CASE WHEN lower(trim(city)) IN ('city1', 'city2', 'elsewhere') OR city IS NULL THEN 'Springfield' ELSE city END AS city FROM contacts""")
def _(t):
    bad = t.spark.createDataFrame([("CITY1",), (" city2",), ("Elsewhere",)], "value string")
    return it.apply_config_tables(t["contacts"], "city", bad, t.spark.createDataFrame([("Springfield",)], "value string")).select("cust_id", "city")


@query("probe_duplicate_keys", "I13")
def _(t):
    return it.duplicate_key_probe(t["lineitem"], "l_orderkey")


@query("probe_remaining_nulls", "I14", """
SELECT 'cust_id' AS column_name, FALSE AS has_null FROM contacts HAVING count(*) = count(cust_id) UNION ALL SELECT 'email', TRUE FROM contacts HAVING count(*) > count(email)""")
def _(t):
    return it.null_probe(t["contacts"], ["cust_id", "email"])


# --- loads ---------------------------------------------------------------------------------------

@query("load_incremental_extract", "J1", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00'")
def _(t):
    return load.extract(t["orders"], "incremental", "o_orderdate", "1997-01-01 00:00:00").select("o_orderkey", "o_totalprice")


@query("load_watermark_choice", "J2 J3", """
SELECT 'orders' AS process, strftime(max(o_orderdate), '%Y-%m-%d') AS watermark, 'o_orderdate' AS watermark_column FROM orders
UNION ALL SELECT 'lineitem', strftime(max(l_shipdate), '%Y-%m-%d'), 'l_shipdate' FROM lineitem""")
def _(t):
    state = t.spark.createDataFrame([("orders", "1992-01-01 00:00:00")], "process string, watermark string").select("process", F.to_timestamp("watermark").alias("watermark"))
    picked = {n: load.pick_watermark(t[n]) for n in ("orders", "lineitem")}
    for n, c in picked.items():
        state = load.advance_watermark(state, n, t[n], c)
    names = F.create_map(*[x for n, c in picked.items() for x in (F.lit(n), F.lit(c))])
    return state.select("process", F.date_format("watermark", "yyyy-MM-dd").alias("watermark"), names[F.col("process")].alias("watermark_column"))


_STAGED = "(SELECT c_custkey, upper(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '!' ELSE '' END AS c_mktsegment FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 50000000, c_mktsegment FROM customer WHERE c_custkey % 10 = 3)"


def _target(t):
    return t["customer"].select("c_custkey", "c_mktsegment")


def _staged(t):
    c = t["customer"]
    changed = c.filter("c_custkey % 4 = 0").select("c_custkey", F.concat(F.upper("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "!").otherwise("")).alias("c_mktsegment"))
    return changed.unionByName(c.filter("c_custkey % 10 = 3").select((F.col("c_custkey") + 50000000).alias("c_custkey"), "c_mktsegment"))


@query("load_scd1_incremental", "J4", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_STAGED} s) UNION ALL SELECT * FROM {_STAGED} s")
def _(t):
    return load.merge_scd1(_target(t), _staged(t), ["c_custkey"])


@query("load_scd1_full", "J4 J6", f"SELECT * FROM {_STAGED} s")
def _(t):
    return load.merge_scd1(_target(t), _staged(t), ["c_custkey"], "full")


def _scd2_sql(only_changed):
    touched = f"SELECT s.c_custkey FROM {_STAGED} s LEFT JOIN customer c ON c.c_custkey = s.c_custkey WHERE {'c.c_custkey IS NULL OR c.c_mktsegment <> s.c_mktsegment' if only_changed else 'TRUE'}"
    return f"""SELECT c_custkey, c_mktsegment, '2020-01-01' AS valid_from, CASE WHEN c_custkey IN ({touched}) THEN '2024-06-01' ELSE '9999-12-31' END AS valid_to, c_custkey NOT IN ({touched}) AS is_current FROM customer
 UNION ALL SELECT c_custkey, c_mktsegment, '2024-06-01', '9999-12-31', TRUE FROM {_STAGED} s WHERE c_custkey IN ({touched})"""


def _scd2(t, mode):
    target = load.start_scd2(_target(t), "2020-01-01 00:00:00")
    return load.merge_scd2(target, _staged(t), ["c_custkey"], "2024-06-01 00:00:00", mode)


def _scd2_out(df):
    return df.select("c_custkey", "c_mktsegment", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "is_current")


@query("load_scd2_always", "J5", _scd2_sql(False))
def _(t):
    return _scd2_out(_scd2(t, "always"))


@query("load_scd2_only_changed", "J5", _scd2_sql(True))
def _(t):
    return _scd2_out(_scd2(t, "only_changed"))


@query("load_scd2_as_of", "J5", f"""
SELECT c_custkey, c_mktsegment FROM customer""")
def _(t):
    return load.history_as_of(_scd2(t, "always"), "2022-01-01 00:00:00").select("c_custkey", "c_mktsegment")


@query("load_history_from_events", "J5", """
SELECT event_id, user_id, CASE WHEN nxt IS NULL THEN '9999-12-31' ELSE strftime(nxt, '%Y-%m-%d') END AS valid_to, nxt IS NULL AS is_current FROM (
 SELECT event_id, user_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) x""")
def _(t):
    h = load.validity_from_events(t["events"].select("event_id", "user_id", "ts"), ["user_id"], "ts")
    return h.select("event_id", "user_id", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "is_current")


@query("load_append", "J6", f"SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT * FROM {_STAGED} s")
def _(t):
    return load.append(_target(t), _staged(t))


@query("load_typed_copy", "J7", """
SELECT cust_id, full_name, CAST(round(amount, 2) AS DOUBLE) AS amount, TRY_CAST(score_text AS BIGINT) AS score_text, 'b1' AS etl_batch_id, '2024-06-01' AS loaded FROM contacts""".replace("full_name,", "trim(full_name) AS full_name,"))
def _(t):
    df = load.typed_copy(t["contacts"], "b1", "2024-06-01 00:00:00", {"score_text": "bigint"})
    return df.select("cust_id", "full_name", F.col("amount").cast("double").alias("amount"), "score_text", "etl_batch_id", F.date_format("etl_created_at", "yyyy-MM-dd").alias("loaded"))


_RULES = LoadRules(keys=["full_name"], numeric=["score_text"], required=["email"], dates=["signup_date"], emails=["email"], phones=["phone"])
_T = "regexp_replace({c}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def _blank(c):
    return f"({c} IS NULL OR {_T.format(c=c)} = '')"


_EMAIL_BAD = f"(NOT {_blank('email')} AND NOT regexp_matches({_T.format(c='email')}, '^[^@]*@[^@]*\\.[^@]*$'))"
_PHONE_BAD = f"(NOT {_blank('phone')} AND NOT ({matches('phone', fv.PHONE)} AND length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 7))"
_DATE_BAD = f"({parsed_sql('trim(signup_date)')} IS NULL)"
_NUM_BAD = "(TRY_CAST(score_text AS DOUBLE) IS NULL)"


@query("load_reject_quarantine", "J8", f"""
SELECT reason, column_name, rejects, cust_id FROM (
 SELECT 'null_key' AS reason, 'full_name' AS column_name, TRUE AS rejects, CAST(cust_id AS VARCHAR) AS cust_id FROM contacts WHERE {_blank('full_name')}
 UNION ALL SELECT 'invalid_numeric', 'score_text', TRUE, CAST(cust_id AS VARCHAR) FROM contacts WHERE {_NUM_BAD}
 UNION ALL SELECT 'null_required', 'email', TRUE, CAST(cust_id AS VARCHAR) FROM contacts WHERE {_blank('email')}
 UNION ALL SELECT 'invalid_date', 'signup_date', FALSE, CAST(cust_id AS VARCHAR) FROM contacts WHERE {_DATE_BAD}
 UNION ALL SELECT 'invalid_email', 'email', TRUE, CAST(cust_id AS VARCHAR) FROM contacts WHERE {_EMAIL_BAD}
 UNION ALL SELECT 'invalid_phone', 'phone', FALSE, CAST(cust_id AS VARCHAR) FROM contacts WHERE {_PHONE_BAD}) x""")
def _(t):
    _, bad = load.split_rejects(t["contacts"], _RULES, "nightly", "contacts", "2024-06-01 00:00:00")
    return bad.select("reason", "column_name", "rejects", F.get_json_object("row_json", "$.cust_id").alias("cust_id"))


@query("load_accepted_rows", "J8", f"""
SELECT cust_id, CASE WHEN NOT {_DATE_BAD} THEN signup_date END AS signup_date, CASE WHEN NOT coalesce({_PHONE_BAD}, FALSE) THEN phone END AS phone FROM contacts
WHERE NOT {_blank('full_name')} AND NOT {_NUM_BAD} AND NOT {_blank('email')} AND NOT coalesce({_EMAIL_BAD}, FALSE)""")
def _(t):
    good, _ = load.split_rejects(t["contacts"], _RULES, "nightly", "contacts", "2024-06-01 00:00:00")
    return good.select("cust_id", "signup_date", "phone")


@query("load_never_drop_rows", "J9", f"""
SELECT cust_id, full_name, CASE WHEN NOT {_NUM_BAD} THEN score_text END AS score_text, CASE WHEN NOT coalesce({_EMAIL_BAD}, FALSE) THEN email END AS email FROM contacts""")
def _(t):
    good, _ = load.split_rejects(t["contacts"], _RULES, "nightly", "contacts", "2024-06-01 00:00:00", never_drop_rows=True)
    return good.select("cust_id", "full_name", "score_text", "email")


@query("load_assertion", "J12", """
SELECT 'empty_target' AS run, NOT ((SELECT count(*) FROM orders) > 0) AS ok UNION ALL SELECT 'loaded', TRUE WHERE (SELECT count(*) FROM orders) > 0""")
def _(t):
    o = t["orders"]
    empty = load.assert_loaded(o.filter("o_orderkey < 0"), o).select(F.lit("empty_target").alias("run"), "ok")
    return empty.unionByName(load.assert_loaded(o, o).select(F.lit("loaded").alias("run"), "ok"))


@query("load_run_log", "J13", """
SELECT o_orderstatus AS process, 'ok' AS status, count(*) AS rows_loaded FROM orders GROUP BY o_orderstatus""")
def _(t):
    # one load per order status, each logged when it starts and when it ends; the log is read back
    path = scratch_dir(t.spark) + "/log"
    loads = t["orders"].groupBy(F.col("o_orderstatus").alias("process")).agg(F.count(F.lit(1)).alias("rows_loaded"))
    for ended, status in ((None, "running"), ("2024-06-01 00:05:00", "ok")):
        load.append_run_log(loads.select(
            "process", F.to_timestamp(F.lit("2024-06-01 00:00:00")).alias("started"), F.to_timestamp(F.lit(ended)).alias("ended"),
            F.lit(status).alias("status"), F.lit(None).cast("string").alias("error"), "rows_loaded"), path)
    return load.last_runs(t.spark, path).select("process", "status", "rows_loaded")

