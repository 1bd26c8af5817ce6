"""Queries for near duplicates and multivariate outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import integrity, similar
from plumbline.queries.registry import query

_SORTED = """array_to_string(list_sort(list_filter(regexp_split_to_array(lower(concat_ws(' ', {cols})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), ' ')"""
_GRAMS = "list_distinct(list_transform(range(1, greatest(2, length(s) - 1)), lambda i: substr(s, i, 3)))"


def _near_sql(table, key, cols, threshold):
    return f"""
WITH g AS MATERIALIZED (SELECT {key} AS k, {_GRAMS} AS g FROM (SELECT {key}, {_SORTED.format(cols=', '.join(cols))} AS s FROM {table} WHERE coalesce({', '.join(cols)}) IS NOT NULL) x WHERE s <> ''),
 p AS (SELECT ka, kb FROM (SELECT a.k AS ka, b.k AS kb, len(a.g) + len(b.g) AS n, len(list_intersect(a.g, b.g)) AS i FROM g a JOIN g b ON a.k < b.k
   AND len(b.g) >= {threshold} * len(a.g) AND len(a.g) >= {threshold} * len(b.g)) j WHERE i >= {threshold} * (n - i))
SELECT DISTINCT k AS {key} FROM (SELECT ka AS k FROM p UNION ALL SELECT kb FROM p) u"""


@query("near_duplicate_parts", "C18", _near_sql("part", "p_partkey", ["p_name", "p_brand", "p_type"], 0.8))
def _(t):
    return similar.near_duplicate_rows(t["part"], "p_partkey", ["p_name", "p_brand", "p_type"], 0.8)


@query("near_duplicate_benchmark_items", "C18", _near_sql("benchmark", "item_id", ["text"], 0.3))
def _(t):
    return similar.near_duplicate_rows(t["benchmark"], "item_id", ["text"], 0.3)


@query("near_duplicate_documents", "C18", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) < 3 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 f AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c / CAST(a.n + b.n - c AS DOUBLE) >= 0.8::DOUBLE)
SELECT DISTINCT x AS doc_id FROM (SELECT x FROM f UNION ALL SELECT y FROM f) u""")
def _(t):
    return similar.near_duplicate_documents(t["documents"], "doc_id", "text", 0.8)


def _maha(table, key, a, b, extra=""):
    return f"""
SELECT {key}, d FROM (SELECT {key}, ({a} - ma) * ({a} - ma) * sb / det - 2 * ({a} - ma) * ({b} - mb) * sab / det + ({b} - mb) * ({b} - mb) * sa / det AS d FROM {table},
 (SELECT avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS sa, var_samp({b}) AS sb, covar_samp({a}, {b}) AS sab, var_samp({a}) * var_samp({b}) - covar_samp({a}, {b}) * covar_samp({a}, {b}) AS det FROM {table}) s) x"""


@query("check_multivariate_outliers", "C19", f"""
WITH m AS ({_maha('lineitem', 'l_orderkey', 'l_quantity', 'l_extendedprice')})
SELECT 'lineitem' AS dataset, 'l_quantity,l_extendedprice' AS column_name, 'multivariate_outliers' AS issue_type, 'medium' AS severity,
 count(*) FILTER (WHERE d > c) AS n_bad, count(*) AS n_checked, round(count(*) FILTER (WHERE d > c) / CAST(count(*) AS DOUBLE), 6) AS pct FROM m, (SELECT quantile_cont(d, 0.98) AS c FROM m) q""")
def _(t):
    return similar.multivariate_outliers(t["lineitem"], "lineitem", ["l_quantity", "l_extendedprice"])


@query("multivariate_outlier_rows", "C19", f"""
WITH m AS ({_maha('orders', 'o_orderkey', 'o_totalprice', 'CAST(o_custkey AS DOUBLE)')}) SELECT o_orderkey FROM m, (SELECT quantile_cont(d, 0.98) AS c FROM m) q WHERE d > c""")
def _(t):
    return similar.flag_multivariate_outliers(t["orders"], ["o_totalprice", "o_custkey"]).filter("is_outlier").select("o_orderkey")


@query("dedup_sorted_neighbourhood", "I11", """
WITH g AS (SELECT p_name || ' ' || p_brand || ' ' || p_type AS s, min(p_partkey) AS first_key FROM part GROUP BY 1),
 n AS (SELECT s, first_key, row_number() OVER (ORDER BY s) AS r FROM g),
 d AS (SELECT DISTINCT b.s FROM n a JOIN n b ON b.r > a.r AND b.r <= a.r + 14 WHERE 1.0 - levenshtein(a.s, b.s) / CAST(greatest(length(a.s), length(b.s)) AS DOUBLE) >= 0.92)
SELECT p_partkey FROM part JOIN n ON n.s = p_name || ' ' || p_brand || ' ' || p_type WHERE p_partkey = first_key AND n.s NOT IN (SELECT s FROM d)""")
def _(t):
    return integrity.remove_neighbourhood_duplicates(t["part"], "p_partkey", ["p_name", "p_brand", "p_type"]).select("p_partkey")
