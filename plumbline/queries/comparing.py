"""Queries for edit similarity, rank association, distribution distances, isolation and keys found by content."""

from __future__ import annotations

from plumbline.operators import association, edits, isolation, relate
from plumbline.queries.registry import query
from plumbline.queries.similarity import _SORTED


def _edit_sql(table: str, key: str, cols: list[str], threshold: float) -> str:
    """Classes of equal sorted words and the pairs of them within the threshold."""
    return f"""
WITH t AS MATERIALIZED (SELECT {key} AS k, {_SORTED.format(cols=', '.join(cols))} AS s FROM {table}),
 g AS MATERIALIZED (SELECT s, min(k) AS id, count(*) AS copies, length(s) AS n FROM t WHERE s <> '' GROUP BY s),
 p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, greatest(a.n, b.n) AS m, CAST(levenshtein(a.s, b.s) AS INTEGER) AS edits FROM g a JOIN g b
   ON a.id < b.id AND abs(a.n - b.n) <= (1 - {threshold}) * greatest(a.n, b.n) + 1e-9 WHERE levenshtein(a.s, b.s) <= (1 - {threshold}) * greatest(a.n, b.n) + 1e-9)"""


def _pairs_sql(*args) -> str:
    return _edit_sql(*args) + "\nSELECT a AS key_a, b AS key_b, edits, round(1.0::DOUBLE - edits / CAST(m AS DOUBLE), 6) AS similarity FROM p"


def _keys_sql(table, key, cols, threshold) -> str:
    return _edit_sql(table, key, cols, threshold) + f"""
SELECT t.k AS {key} FROM t JOIN g ON t.s = g.s WHERE g.copies > 1 OR g.id IN (SELECT a FROM p UNION ALL SELECT b FROM p)"""


_PART = ["p_name", "p_brand", "p_type"]
_ROWS = ["email", "phone", "city", "status"]  # plain ASCII: the oracle measures bytes


@query("near_duplicate_part_pairs", "C18", _pairs_sql("part", "p_partkey", _PART, 0.92))
def _(t):
    return edits.near_duplicate_pairs(t["part"], "p_partkey", _PART, 0.92)


@query("near_duplicate_contact_rows", "C18", "SELECT * FROM (" + _keys_sql("contacts", "cust_id", _ROWS, 0.92) + ") q")
def _(t):
    return edits.near_duplicate_keys(t["contacts"], "cust_id", _ROWS, 0.92)


@query("near_duplicate_benchmark_pairs", "C18", _pairs_sql("benchmark", "item_id", ["text"], 0.6))
def _(t):
    return edits.near_duplicate_pairs(t["benchmark"], "item_id", ["text"], 0.6)


@query("check_near_duplicate_rows", "C18", f"""
SELECT 'contacts' AS dataset, '[row]' AS column_name, 'near_duplicate_rows' AS issue_type, 'medium' AS severity, n_bad, n_checked,
 round(n_bad / CAST(n_checked AS DOUBLE), 6) AS pct FROM (SELECT count(*) AS n_bad FROM ({_keys_sql('contacts', 'cust_id', _ROWS, 0.92)}) k) b,
 (SELECT count(*) AS n_checked FROM contacts) c WHERE n_bad > 0""")
def _(t):
    return edits.near_duplicate_issue(t["contacts"], "contacts", "cust_id", _ROWS, 0.92)


def _kendall_sql(table: str, columns: list[str]) -> str:
    """All pairs of rows, compared one by one."""
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            parts.append(f"""
SELECT '{a}' AS column_a, '{b}' AS column_b, any_value(n) AS n, round(sum(c * d * sign(x - u) * sign(y - v)) / sqrt(CAST(sum(c * d * abs(sign(x - u))) AS DOUBLE) * sum(c * d * abs(sign(y - v)))), 6) AS correlation
FROM (SELECT a.x, a.y, a.c, b.x AS u, b.y AS v, b.c AS d FROM g{i}_{b} a CROSS JOIN g{i}_{b} b) j, (SELECT CAST(sum(c) AS BIGINT) AS n FROM g{i}_{b}) s""")
    with_ = ", ".join(
        f"g{i}_{b} AS MATERIALIZED (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*) AS c FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"
        for i, a in enumerate(columns) for b in columns[i + 1:])
    return f"SELECT * FROM (WITH {with_} {' UNION ALL '.join(parts)}) q"


@query("profile_kendall_correlations", "B7", _kendall_sql("part", ["p_size", "p_retailprice", "p_partkey"]))
def _(t):
    return association.kendall(t["part"], ["p_size", "p_retailprice", "p_partkey"])


@query("profile_kendall_with_ties", "B7", _kendall_sql("contacts", ["age", "interest_rate", "parent_cust_id"]))
def _(t):
    return association.kendall(t["contacts"], ["age", "interest_rate", "parent_cust_id"])


def _distance_sql(a: str, b: str, columns: list[str], bins: int = 10) -> str:
    """``a`` and ``b`` are subqueries with the same columns."""
    parts = []
    for c in columns:
        parts.append(f"""
SELECT '{c}' AS column_name, n_a, n_b, round(ks, 6) AS ks, at_value, psi FROM (
 WITH c AS (SELECT v, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM (SELECT CAST({c} AS DOUBLE) AS v, 1 AS a, 0 AS b FROM {a} WHERE {c} IS NOT NULL
   UNION ALL SELECT CAST({c} AS DOUBLE), 0, 1 FROM {b} WHERE {c} IS NOT NULL) u GROUP BY v),
 r AS (SELECT v, round(abs(sum(a) OVER w / CAST(sum(a) OVER () AS DOUBLE) - sum(b) OVER w / CAST(sum(b) OVER () AS DOUBLE)), 9) AS g FROM c WINDOW w AS (ORDER BY v)),
 e AS (SELECT quantile_cont(CAST({c} AS DOUBLE), [{', '.join(str((k + 1) / bins) for k in range(bins - 1))}]) AS e FROM {a}),
 h AS (SELECT CAST(list_sum(list_transform(e, lambda x: CASE WHEN v > x THEN 1 ELSE 0 END)) AS INTEGER) AS bin, sum(a) AS a, sum(b) AS b FROM c, e GROUP BY 1),
 p AS (SELECT greatest(1e-4, a / CAST(sum(a) OVER () AS DOUBLE)) AS pa, greatest(1e-4, b / CAST(sum(b) OVER () AS DOUBLE)) AS pb FROM h)
 SELECT (SELECT CAST(sum(a) AS BIGINT) FROM c) AS n_a, (SELECT CAST(sum(b) AS BIGINT) FROM c) AS n_b, max(g) AS ks, (SELECT min(v) FROM r WHERE g = (SELECT max(g) FROM r)) AS at_value,
  (SELECT round(sum((pb - pa) * ln(pb / pa)), 6) FROM p) AS psi FROM r) x""")
    return " UNION ALL ".join(parts)


@query("profile_distribution_distances", "B21", _distance_sql(
    "(SELECT * FROM lineitem WHERE l_returnflag = 'R')", "(SELECT * FROM lineitem WHERE l_returnflag <> 'R')", ["l_quantity", "l_extendedprice", "l_discount"]))
def _(t):
    returned = t["lineitem"].filter("l_returnflag = 'R'")
    return association.distribution_distances(returned, t["lineitem"].filter("l_returnflag <> 'R'"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("profile_balance_distances", "B21", _distance_sql(
    "(SELECT c_acctbal AS acctbal, c_nationkey AS nationkey FROM customer)", "(SELECT s_acctbal AS acctbal, s_nationkey AS nationkey FROM supplier)", ["acctbal", "nationkey"]))
def _(t):
    stripped = [t[name].toDF(*[c[2:] for c in t[name].columns]) for name in ("customer", "supplier")]
    return association.distribution_distances(*stripped, ["acctbal", "nationkey"])


def _forest_sql(table: str, key: str, a: str, b: str) -> str:
    """The forest over two columns, level by level."""
    trees, sample, depth = isolation.TREES, isolation.SAMPLE, isolation.DEPTH
    mean = lambda n: f"(CASE WHEN {n} < 2 THEN 0::DOUBLE WHEN {n} = 2 THEN 1::DOUBLE ELSE 2::DOUBLE * (ln(CAST({n} - 1 AS DOUBLE)) + 0.5772156649015329::DOUBLE) - 2::DOUBLE * ({n} - 1) / {n} END)"
    steps = [f"""
base AS MATERIALIZED (SELECT {key} AS k, CAST({a} AS DOUBLE) AS x1, CAST({b} AS DOUBLE) AS x2 FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(CAST(k AS VARCHAR)), x1, x2) - 1 AS p FROM base ORDER BY md5(CAST(k AS VARCHAR)), x1, x2 LIMIT {trees * sample}),
z AS MATERIALIZED (SELECT count(*) AS pn, least(count(*), {sample}) AS s FROM pool),
n0 AS MATERIALIZED (SELECT t, CAST(1 AS BIGINT) AS node, x1, x2 FROM pool, z, (SELECT unnest(range({trees})) AS t) r WHERE ((p - t * s) % pn + pn) % pn < s),
r0 AS MATERIALIZED (SELECT k, x1, x2, t, CAST(1 AS BIGINT) AS node FROM base, (SELECT unnest(range({trees})) AS t) r)"""]
    for d in range(depth + 1):
        steps.append(f"""
s{d} AS MATERIALIZED (SELECT t, node, c, leaf, {d} + {mean('c')} AS path, CASE j WHEN 1 THEN a1 + u * (b1 - a1) ELSE a2 + u * (b2 - a2) END AS cut, j FROM (
  SELECT *, (bits >> 8) / 16777216::DOUBLE AS u, {'true' if d == depth else '(c < 2 OR (b1 <= a1 AND b2 <= a2))'} AS leaf,
   CASE WHEN b1 > a1 AND b2 > a2 THEN 1 + bits % 2 WHEN b1 > a1 THEN 1 ELSE 2 END AS j FROM (
  SELECT t, node, count(*) AS c, min(x1) AS a1, max(x1) AS b1, min(x2) AS a2, max(x2) AS b2, CAST('0x' || substr(md5(t || ':' || node), 1, 8) AS BIGINT) AS bits FROM n{d} GROUP BY t, node) q) q)""")
        if d < depth:
            move = "2 * n.node + CASE WHEN CASE s.j WHEN 1 THEN n.x1 ELSE n.x2 END > s.cut THEN 1 ELSE 0 END AS node"
            steps.append(f"n{d + 1} AS MATERIALIZED (SELECT n.t, {move}, n.x1, n.x2 FROM n{d} n JOIN s{d} s ON n.t = s.t AND n.node = s.node WHERE NOT s.leaf)")
            steps.append(f"r{d + 1} AS MATERIALIZED (SELECT n.k, n.x1, n.x2, n.t, {move} FROM r{d} n JOIN s{d} s ON n.t = s.t AND n.node = s.node WHERE NOT s.leaf)")
    ends = " UNION ALL ".join(f"SELECT r.k, s.path FROM r{d} r JOIN s{d} s ON r.t = s.t AND r.node = s.node WHERE s.leaf" for d in range(depth + 1))
    return f"WITH {', '.join(steps)}, e AS (SELECT k, round(pow(2::DOUBLE, -(sum(path) / {trees} / (SELECT {mean('s')} FROM z))), {isolation.DIGITS}) AS score FROM ({ends}) x GROUP BY k)"


@query("isolation_outlier_rows", "C19", _forest_sql("part", "p_partkey", "p_size", "p_retailprice") + """
SELECT k AS p_partkey, score FROM e WHERE score > (SELECT quantile_cont(score, 0.98) FROM e)""")
def _(t):
    found = isolation.isolated_rows(t["part"], "p_partkey", ["p_size", "p_retailprice"]).filter("is_outlier")
    return found.select("p_partkey", found["_score"].alias("score"))


@query("check_isolated_rows", "C19", _forest_sql("orders", "o_orderkey", "o_totalprice", "o_custkey") + """
SELECT 'orders' AS dataset, 'o_totalprice,o_custkey' AS column_name, 'multivariate_outliers' AS issue_type, 'medium' AS severity, n_bad, n_checked,
 round(n_bad / CAST(n_checked AS DOUBLE), 6) AS pct FROM (SELECT count(*) FILTER (WHERE score > c) AS n_bad, count(*) AS n_checked FROM e, (SELECT quantile_cont(score, 0.98) AS c FROM e) q) x""")
def _(t):
    return isolation.isolation_issue(t["orders"], "orders", "o_orderkey", ["o_totalprice", "o_custkey"])


_KEYED = {
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"], "supplier": ["s_suppkey", "s_nationkey"],
    "nation": ["n_nationkey", "n_regionkey", "n_name"], "region": ["r_regionkey", "r_name"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "part": ["p_partkey", "p_size"],
}


def _overlap_sql(tables: dict[str, list[str]], numbers: str = "key size") -> str:
    def value(c):
        return f"'n' || CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if c.endswith(tuple(numbers.split())) else f"'t' || CAST({c} AS VARCHAR)"

    every = " UNION ALL ".join(f"SELECT '{t}' AS d, '{c}' AS c, v FROM (SELECT DISTINCT {value(c)} AS v FROM {t} WHERE {c} IS NOT NULL) q" for t, cs in tables.items() for c in cs)
    return f"""WITH v AS MATERIALIZED ({every}), s AS (SELECT d, c, count(*) AS n FROM v GROUP BY d, c),
 o AS (SELECT a.d AS dataset_a, a.c AS column_a, b.d AS dataset_b, b.c AS column_b, x.n AS n_a, y.n AS n_b, count(*) AS n_common FROM v a JOIN v b ON a.v = b.v AND a.d <> b.d
   JOIN s x ON x.d = a.d AND x.c = a.c JOIN s y ON y.d = b.d AND y.c = b.c GROUP BY ALL)"""


@query("relate_value_overlaps", "E12", _overlap_sql(_KEYED) + " SELECT * FROM o")
def _(t):
    return relate.value_overlaps({name: t[name] for name in _KEYED}, _KEYED)


@query("relate_potential_join_keys", "E12", _overlap_sql(_KEYED) + """
SELECT *, round(n_common / CAST(n_a AS DOUBLE), 6) AS inclusion, round(n_common / CAST(n_b AS DOUBLE), 6) AS coverage, n_common = n_a AS is_complete FROM o WHERE n_a >= 2 AND n_common >= 0.9 * n_a""")
def _(t):
    return relate.potential_join_keys({name: t[name].select(*cs) for name, cs in _KEYED.items()})


@query("relate_shared_columns", "E12", " UNION ALL ".join(f"""
SELECT '{a}' AS dataset_a, '{x}' AS column_name_a, '{b}' AS dataset_b, '{y}' AS column_name_b, '{x[2:]}' AS key_name, {str(k).lower()} AS key_like, CAST(count(*) AS BIGINT) AS n_rows_a FROM {a}"""
    for a, x, b, y, k in [("customer", "c_nationkey", "supplier", "s_nationkey", True), ("customer", "c_name", "supplier", "s_name", False),
                          ("customer", "c_acctbal", "supplier", "s_acctbal", False)]))
def _(t):
    from pyspark.sql import functions as F

    tables = {name: t[name].select(*[c for c in t[name].columns if c.endswith(("key", "_name", "acctbal"))]) for name in ("customer", "supplier")}
    n = tables["customer"].agg(F.count(F.lit(1)).alias("n_rows_a"))
    return relate.shared_columns(tables).crossJoin(F.broadcast(n))
