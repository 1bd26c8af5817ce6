"""Query registry: every entry has a Spark callable and, where SQL can say it, an oracle query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Derived tables that plant known defects. The text is plain SQL that Spark and the oracle both run
# over the whole source table; names in braces are source tables.
DERIVED = {
    "contacts": """
SELECT c_custkey AS cust_id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL
       WHEN c_custkey % 23 = 0 THEN '  ' || c_name || ' '
       WHEN c_custkey % 29 = 0 THEN 'John  Smith'
       WHEN c_custkey % 11 = 1 THEN 'N/A'
       WHEN c_custkey % 37 = 0 THEN '<b>' || c_name || '</b>'
       WHEN c_custkey % 41 = 0 THEN '---'
       WHEN c_custkey % 43 = 0 THEN 'ACME LIMITED'
       WHEN c_custkey % 47 = 0 THEN 'John John Smith'
       WHEN c_custkey % 53 = 0 THEN c_name || chr(7)
       WHEN c_custkey % 59 = 0 THEN c_name || 'é'
       WHEN c_custkey % 61 = 0 THEN '   '
       WHEN c_custkey % 67 = 0 THEN lower(c_name)
       ELSE c_name END AS full_name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL
       WHEN c_custkey % 11 = 0 THEN 'user' || CAST(c_custkey AS STRING) || '.example.com'
       WHEN c_custkey % 19 = 0 THEN 'user' || CAST(c_custkey AS STRING) || '@example'
       WHEN c_custkey % 7 = 0 THEN ' User' || CAST(c_custkey AS STRING) || '@Example.COM '
       ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN c_custkey % 9 = 0 THEN NULL
       WHEN c_custkey % 14 = 0 THEN 'call me'
       WHEN c_custkey % 5 = 0 THEN '(415) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
       ELSE '+1415555' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS phone,
  CASE WHEN c_custkey % 27 = 1 THEN 'not-a-uuid'
       ELSE substr(md5(CAST(CASE WHEN c_custkey % 25 = 0 THEN 25 ELSE c_custkey END AS STRING)), 1, 8) || '-' ||
            substr(md5(CAST(CASE WHEN c_custkey % 25 = 0 THEN 25 ELSE c_custkey END AS STRING)), 9, 4) || '-4' ||
            substr(md5(CAST(CASE WHEN c_custkey % 25 = 0 THEN 25 ELSE c_custkey END AS STRING)), 14, 3) || '-a' ||
            substr(md5(CAST(CASE WHEN c_custkey % 25 = 0 THEN 25 ELSE c_custkey END AS STRING)), 18, 3) || '-' ||
            substr(md5(CAST(CASE WHEN c_custkey % 25 = 0 THEN 25 ELSE c_custkey END AS STRING)), 21, 12)
       END AS account_uuid,
  CASE WHEN c_custkey % 8 = 0 THEN 'www example com'
       WHEN c_custkey % 6 = 0 THEN 'FTP://files.example.com/' || CAST(c_custkey AS STRING)
       ELSE 'https://example.com/' || CAST(c_custkey AS STRING) END AS website_url,
  CASE WHEN c_custkey % 10 = 0 THEN lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '/0' || CAST(1 + c_custkey % 9 AS STRING) || '/2019'
       WHEN c_custkey % 10 = 1 THEN '2019/0' || CAST(1 + c_custkey % 9 AS STRING) || '/' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')
       WHEN c_custkey % 10 = 2 THEN '15.03.2019'
       WHEN c_custkey % 10 = 3 THEN '2000-02-30'
       WHEN c_custkey % 10 = 4 THEN 'soon'
       WHEN c_custkey % 10 = 5 THEN '2020-01-01T10:00:00Z'
       ELSE '20' || CAST(10 + c_custkey % 10 AS STRING) || '-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') END AS signup_date,
  CASE c_custkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' WHEN 2 THEN 'Y' WHEN 3 THEN '1'
       WHEN 4 THEN 'false' WHEN 5 THEN 'no' ELSE '0' END AS active_flag,
  CASE c_custkey % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'active' WHEN 2 THEN 'ACTIVE' WHEN 3 THEN 'Closed' ELSE 'TBD' END AS status,
  lpad(CAST(c_custkey % 100 AS STRING), 5, '0') AS zip,
  CASE WHEN c_custkey % 97 = 0 THEN 'Elsewhere' ELSE 'City' || CAST(c_custkey % 100 AS STRING) END AS city,
  CASE WHEN c_custkey % 71 = 0 THEN CAST(-5 AS BIGINT) WHEN c_custkey % 73 = 0 THEN CAST(200 AS BIGINT) ELSE c_custkey % 90 END AS age,
  CASE WHEN c_custkey % 79 = 0 THEN CAST(150 AS DOUBLE) ELSE CAST(c_custkey % 100 AS DOUBLE) END AS interest_rate,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE 'n' || CAST(c_custkey AS STRING) END AS score_text,
  CASE WHEN c_custkey % 3 = 0 THEN '00' || CAST(c_custkey AS STRING) ELSE 'A' || CAST(c_custkey AS STRING) END AS account_code,
  CASE WHEN c_custkey % 83 = 0 THEN CAST(99999999 AS BIGINT) WHEN c_custkey % 10 < 4 THEN NULL ELSE c_custkey - c_custkey % 10 END AS parent_cust_id,
  CASE WHEN c_custkey % 89 = 0 THEN CAST(-999 AS DOUBLE) ELSE c_acctbal END AS amount,
  CASE WHEN c_custkey % 101 = 0 THEN rpad('x', 5000, 'x') WHEN c_custkey % 3 = 1 THEN '12345' ELSE 'checked ' || CAST(c_custkey AS STRING) END AS remark,
  chr(123) || '"tier": ' || CAST(c_custkey % 4 AS STRING) || chr(125) AS attributes
FROM {customer}""",
    "payments": """
SELECT l_orderkey * 10 + l_linenumber AS line_id, l_orderkey AS order_id, l_linenumber AS line_number,
  CASE WHEN l_orderkey % 31 = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 1009 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS amount,
  CASE WHEN l_orderkey % 5 < 2 THEN CAST(5000 AS DOUBLE) * (1 + l_linenumber) ELSE l_extendedprice END AS estimated_amount,
  CASE WHEN l_orderkey % 199 = 0 THEN CAST(10 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS status_level,
  CASE WHEN l_orderkey % 2 = 0 THEN floor(l_extendedprice) ELSE l_extendedprice END AS unit_price,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_discount END AS discount,
  CASE WHEN l_orderkey % 97 = 0 THEN 'Z' ELSE l_returnflag END AS return_flag,
  l_extendedprice * l_quantity AS total_amount, 'EUR' AS currency
FROM {lineitem}""",
    "shipments": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE WHEN o_orderkey % 101 = 0 THEN TIMESTAMP '2099-01-01 00:00:00'
       WHEN o_orderkey % 103 = 0 THEN TIMESTAMP '1850-06-15 00:00:00'
       ELSE CAST(o_orderdate AS TIMESTAMP) END AS order_date,
  CASE WHEN o_orderkey % 37 = 0 THEN CAST(o_orderdate AS TIMESTAMP) - INTERVAL 3 DAY ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 DAY END AS ship_date,
  CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) END AS payment_date,
  CASE WHEN o_orderkey % 5 < 2 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS billing_date,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS refund_amount,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 0.1 ELSE NULL END AS discount_amount,
  o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority
FROM {orders}""",
    "lines_dup": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipmode_x FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag AS l_shipmode_x FROM {lineitem}
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag AS l_shipmode_x FROM {lineitem} WHERE l_orderkey % 50 = 0
) u""",
    "orders_fk": """
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 61 = 0 THEN o_custkey + 90000000 WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS cust_id,
  o_orderstatus AS order_status, o_totalprice AS total_price, CAST(o_orderdate AS TIMESTAMP) AS order_date, o_orderpriority AS priority
FROM {orders}""",
}


class Tables:
    """Lazy access to the test tables and the derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in DERIVED:
            sources = {t: self[t] for t in TABLES if "{" + t + "}" in DERIVED[name]}
            return self.spark.sql(DERIVED[name], **sources)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ITEMS: dict[str, tuple[str, ...]] = {}


def derived_sql(name: str) -> str:
    return DERIVED[name].format(**{t: t for t in TABLES})


def with_derived(body: str) -> str:
    """Prefix the derived tables a query mentions."""
    used = [n for n in DERIVED if n in body]
    return ("WITH " + ", ".join(f"{n} AS ({derived_sql(n)})" for n in used) + " " if used else "") + body


def query(name: str, items: str = "", sql: str | None = None):
    """Register a query; ``items`` lists the inventory entries it covers."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ITEMS[name] = tuple(items.split())
        if sql is not None:
            ORACLE[name] = with_derived(sql)
        return fn

    return wrap


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def issue_sql(dataset, column, issue, severity, bad, checked=None, fires="n_bad > 0", source=None) -> str:
    """Oracle text for one row of the issues table."""
    checked = checked or f"{column} IS NOT NULL"
    return (
        f"SELECT {quote(dataset)} AS dataset, {quote(column)} AS column_name, {quote(issue)} AS issue_type, "
        f"{quote(severity)} AS severity, n_bad, n_checked, round(CAST(n_bad AS DOUBLE) / nullif(n_checked, 0), 6) AS pct "
        f"FROM (SELECT count(*) FILTER (WHERE {bad}) AS n_bad, count(*) FILTER (WHERE {checked}) AS n_checked "
        f"FROM {source or dataset}) x WHERE {fires}"
    )


def union_sql(parts) -> str:
    return " UNION ALL ".join(parts)


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quote(pattern)})"
