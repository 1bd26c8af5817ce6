"""Queries for readers, writers and streams. They write a whole table and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.checks import Settings
from plumbline.operators.load import LoadRules
from plumbline.queries.registry import issue_sql, query, union_sql
from plumbline.session import scratch_dir
from plumbline.sources import readers, writers
from plumbline.streaming import streams


@query("source_csv_round_trip", "A1 A12", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch_dir(t.spark) + "/customer"
    writers.write(t["customer"], path, "csv")
    return readers.read_csv(t.spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("source_sampled_rows", "A2")
def _(t):
    return readers.sample_rows(t["lineitem"], 5000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("source_reservoir", "A5")
def _(t):
    return readers.reservoir(t["orders"], 1000, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("source_json_documents", "A3", "SELECT n_nationkey AS meta_nation_id, n_name AS meta_name, c_custkey AS id, c_mktsegment AS info_segment FROM nation JOIN customer ON c_nationkey = n_nationkey")
def _(t):
    # one document per customer: a header and a list of one record, three levels deep
    doc = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.struct(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("name"),
                 F.array(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment")).alias("info"))).alias("customers")).alias("meta"))
    path = scratch_dir(t.spark) + "/docs"
    writers.write(doc, path, "json")
    return readers.explode_document(t.spark.read.json(path)).select(
        F.col("meta_nation_id").cast("int").alias("meta_nation_id"), "meta_name", "id", "info_segment")


@query("source_json_lines_corrupt", "A4", """
SELECT CASE WHEN event_id % 10 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type,
 CASE WHEN event_id % 10 = 0 THEN 'broken ' || CAST(event_id AS VARCHAR) END AS value FROM events""")
def _(t):
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = scratch_dir(t.spark) + "/lines"
    t["events"].select(line.alias("l")).write.text(path)
    return readers.read_jsonl(t.spark, path).select("event_id", "event_type", "value")


@query("source_xml_records", "A6 A12", "SELECT p_partkey AS id, p_brand AS tags_brand, p_type AS tags_kind FROM part")
def _(t):
    rows = t["part"].select(F.col("p_partkey").alias("id"), F.array(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))).alias("tags"))
    base = scratch_dir(t.spark)
    # a second, empty tag makes the child a repeated element, as in real files
    two = rows.withColumn("tags", F.concat("tags", F.array(F.struct(F.lit("-").alias("brand"), F.lit("-").alias("kind")))))
    two.write.format("xml").option("rowTag", "part").option("rootTag", "parts").save(base + "/parts")
    writers.xml_to_parquet(t.spark, base + "/parts", "part", base + "/parquet")
    return readers.read_parquet(t.spark, base + "/parquet").filter("tags_brand <> '-'").select("id", "tags_brand", "tags_kind")


_TABLED = "replace(replace(replace(html, '<ul>', '<table>'), '</ul>', '</table>'), '</li>', '</td></tr>')"


@query("source_html_tables", "A8", """
SELECT page_id, CAST(r - 1 AS INTEGER) AS row_no, CAST(0 AS INTEGER) AS col_no, trim(replace(replace(replace(replace(replace(regexp_replace(cell, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS value FROM (
 SELECT page_id, unnest(regexp_extract_all(body, '(?is)<td>(.*?)</td>', 1)) AS cell, generate_subscripts(regexp_extract_all(body, '(?is)<td>(.*?)</td>', 1), 1) AS r FROM (
 SELECT page_id, regexp_extract(replace(h, '<li>', '<tr><td>'), '(?is)<table[^>]*>(.*?)</table>', 1) AS body FROM (SELECT page_id, """ + _TABLED + """ AS h FROM pages) a) b) c""")
def _(t):
    html = F.expr(_TABLED.replace("html", "html"))
    return readers.html_table_rows(t["pages"].select("page_id", F.replace(html, F.lit("<li>"), F.lit("<tr><td>")).alias("html")), "page_id", "html")


@query("source_catalog", "A7 A10", """
SELECT 'customer' AS dataset, count(*) AS row_count FROM customer UNION ALL SELECT 'b_customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'failed: missing', 0""")
def _(t):
    catalog = readers.Catalog(t.spark).load([
        {"path": f"{t.sf_dir}/customer.parquet", "source": "a"}, {"path": f"{t.sf_dir}/missing.parquet"},
        {"path": f"{t.sf_dir}/customer.parquet", "source": "b"}, {"path": f"{t.sf_dir}/orders.parquet"}])
    out = catalog.errors().select(F.concat(F.lit("failed: "), "name").alias("dataset"), F.lit(0).cast("long").alias("row_count"))
    for name, df in catalog.tables.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset"), "row_count"))
    return out


@query("sink_formats", "A12", union_sql([f"SELECT '{f}' AS format, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders" for f in ("parquet", "csv", "json")]))
def _(t):
    base, out = scratch_dir(t.spark), None
    for fmt in ("parquet", "csv", "json"):
        writers.write(t["orders"], f"{base}/{fmt}", fmt)
        back = {"parquet": readers.read_parquet, "csv": readers.read_csv, "json": readers.read_jsonl}[fmt](t.spark, f"{base}/{fmt}")
        one = back.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("o_orderkey").cast("long")).alias("key_sum")).select(F.lit(fmt).alias("format"), "row_count", "key_sum")
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_lakehouse_mirror", "A13", """
SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0""")
def _(t):
    path = scratch_dir(t.spark) + "/mirror"
    c = t["customer"]
    writers.mirror(c.select("c_custkey"), path)
    writers.mirror(c.select("c_custkey", "c_mktsegment"), path)
    writers.mirror(c.filter("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment"), path, "append")
    writers.mirror(c.filter("c_custkey < 0").select("c_custkey", "c_mktsegment"), path)
    return readers.read_parquet(t.spark, path)


# --- streams --------------------------------------------------------------------------------------

def stream_of(t, table):
    schema = t[table].schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)


@query("stream_validation", "K1", union_sql([
    issue_sql("events", "user_id", "suspicious_zero", "medium", "user_id = 0"),
    issue_sql("events", "event_id", "suspicious_zero", "medium", "event_id = 0"),
    issue_sql("events", "value", "negative_values", "medium", "value < 0"),
    issue_sql("events", "value", "sentinel_numeric_value", "medium", "value IN (0, 999, 1234)"),
    issue_sql("events", "props", "nested_structure", "medium", "regexp_matches(props, '^[ \\t\\r\\n]*[\\[{].*[\\]}][ \\t\\r\\n]*$')", fires="n_bad = n_checked")]))
def _(t):
    base = scratch_dir(t.spark)
    streams.validate_stream(stream_of(t, "events"), "events", base + "/issues", base + "/ck", Settings(as_of="2025-01-01"),
                            ["suspicious_zero", "negative_values", "sentinel_numeric_value", "nested_structure"]).awaitTermination()
    return t.spark.read.parquet(base + "/issues").drop("batch_id")


@query("stream_reject_split", "K2", """
SELECT event_id, 'good' AS part FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'null_required' FROM events WHERE event_type = 'error'""")
def _(t):
    base = scratch_dir(t.spark)
    marked = stream_of(t, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    for q in streams.split_stream(marked, LoadRules(keys=["event_id"], required=["kind"]), base + "/good", base + "/bad", base + "/ck"):
        q.awaitTermination()
    good = t.spark.read.parquet(base + "/good").select("event_id", F.lit("good").alias("part"))
    bad = t.spark.read.parquet(base + "/bad").select(F.get_json_object("row_json", "$.event_id").cast("long").alias("event_id"), F.col("reason").alias("part"))
    return good.unionByName(bad)




def _rates():
    return {"low": F.col("value") < 5, "error": F.col("event_type") == "error"}


_METRICS = """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n_rows, count(*) FILTER (WHERE value < 5) AS low_bad, count(*) FILTER (WHERE event_type = 'error') AS error_bad,
 round(count(*) FILTER (WHERE value < 5) / CAST(count(*) AS DOUBLE), 6) AS low_rate, round(count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS error_rate FROM events GROUP BY 1"""


@query("stream_window_metrics_batch", "K3", _METRICS)
def _(t):
    m = streams.window_metrics(t["events"], "ts", _rates())
    return m.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).withColumnRenamed("window_start", "day")


@query("stream_window_metrics", "K3", f"SELECT day, n_rows, low_bad, error_bad FROM ({_METRICS}) m WHERE day < (SELECT strftime(max(ts) - INTERVAL 1 DAY, '%Y-%m-%d') FROM events)")
def _(t):
    base = scratch_dir(t.spark)
    streams.stream_window_metrics(stream_of(t, "events"), "ts", _rates(), base + "/m", base + "/ck").awaitTermination()
    return t.spark.read.parquet(base + "/m").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_rows", "low_bad", "error_bad")


@query("stream_deduplication", "K4", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    base = scratch_dir(t.spark)
    unique = streams.deduplicate_stream(stream_of(t, "events"), ["user_id", "event_type"], "ts", "3650 days")
    streams.write_stream(unique.select("user_id", "event_type"), base + "/d", base + "/ck").awaitTermination()
    return t.spark.read.parquet(base + "/d")


@query("stream_scd1_upsert", "K5", """
SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def _(t):
    base = scratch_dir(t.spark)
    rows = stream_of(t, "events").select("user_id", "ts", "event_type", "value")
    streams.upsert_stream(rows, base + "/users", ["user_id"], base + "/ck", latest_by="ts", buckets=8).awaitTermination()
    return streams.read_merged(t.spark, base + "/users").select("user_id", "event_type", "value")


@query("stream_scd2_upsert", "K5", """
SELECT user_id, event_type, TRUE AS is_current FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1
UNION ALL SELECT user_id, 'seen', FALSE FROM events GROUP BY user_id""")
def _(t):
    base = scratch_dir(t.spark)
    # two runs of the stream on one target: first a marker per user, then the latest event
    first = stream_of(t, "events").select("user_id", "ts", F.lit("seen").alias("event_type"))
    streams.upsert_stream(first, base + "/users", ["user_id"], base + "/ck1", "ts", 2, lambda b: "2024-01-01 00:00:00", 8).awaitTermination()
    later = stream_of(t, "events").select("user_id", "ts", "event_type")
    offset = 1000
    q = later.writeStream.foreachBatch(lambda df, b: streams.merge_into_buckets(
        _latest(df), base + "/users", ["user_id"], lambda old, new: streams.merge_scd2(old, new, ["user_id"], "2024-06-01 00:00:00"), b + offset, 8))
    q.option("checkpointLocation", base + "/ck2").trigger(availableNow=True).start().awaitTermination()
    return streams.read_merged(t.spark, base + "/users").select("user_id", "event_type", "is_current")


def _latest(df):
    from plumbline.operators.integrity import keep_latest

    return keep_latest(df, ["user_id"], "ts", ["event_type"])
