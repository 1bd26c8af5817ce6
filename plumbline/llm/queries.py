"""Queries of the training-data operators over their whole tables, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    chat_format, embedding_dedup, exact_dedup, html_text, license_scan, mixing, ngram_join, packing, periodic_runs, quality,
    rule_forest, substring_dedup, whitening,
)
from plumbline.llm.shared import read

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op4_exact_dedup", sql=r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS p,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY p DESC, doc_id) AS k, count(*) OVER (PARTITION BY norm) AS n,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY p DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).drop("tag")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 13) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS place, 2 * source_size AS stop FROM s),
l AS (SELECT *, CAST(stop AS DOUBLE) / weight AS level FROM w),
f AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5::DOUBLE
          - CAST(coalesce(sum(stop) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / CAST(sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS shared FROM l),
c AS (SELECT level, place, shared FROM f WHERE shared < level ORDER BY level, place LIMIT 1),
g AS (SELECT f.source, f.source_size, round(CASE WHEN c.level IS NOT NULL AND (f.level > c.level OR f.level = c.level AND f.place >= c.place)
        THEN least(c.shared * f.weight, CAST(f.stop AS DOUBLE)) ELSE CAST(f.stop AS DOUBLE) END, 6) AS target FROM f LEFT JOIN c ON true),
e AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM g),
k AS (SELECT d.source, key, sum(size) AS words, count(*) AS n FROM d GROUP BY d.source, key HAVING sum(size) > 0),
b AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key) - words AS before FROM k),
x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, b.words, b.n, b.before,
        CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
      LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.key = b.key)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + CASE WHEN before IS NULL OR before > rest THEN 0
    WHEN before + words <= rest THEN size ELSE least((rest - before) // n, size) END AS BIGINT) AS taken FROM x"""


@query("op5_source_mixing", sql=MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(ESCAPED_ROLE) + length(ESCAPED_TEXT) + 23 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""


def _escaped(column: str) -> str:
    """SQL of a text with a backslash inside each control string and every backslash doubled."""
    text = f"replace({column}, '\\', '\\\\')"
    for mark in sorted(chat_format.CONTROL, key=len, reverse=True):
        text = f"replace({text}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return text


@query("op7_chat_formatting", sql=CHAT_SQL.replace("ESCAPED_ROLE", _escaped("role")).replace("ESCAPED_TEXT", _escaped("text")))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = read(spark, sf_dir, "conversations").select(*[F.col(c).cast(t).alias(c) for c, t in extra.dtypes]).unionByName(extra)
    return chat_format.read_back(chat_format.format_conversations(table, tokenizer_path("byte_bpe_50k.tiktoken")))


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@query("op10_ngram_jaccard_join", sql=r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(read(spark, sf_dir, "documents"))


@query("op1_substring_dedup", sql=r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM t)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM m WHERE least < doc_id),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
        CASE WHEN gone IS NULL THEN l ELSE list_select(l, list_sort(list_filter(range(1, len(l) + 1), lambda x: NOT list_contains(gone, x)))) END AS kept
      FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM r""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(read(spark, sf_dir, "documents"))


@query("op2_embedding_near_dedup", sql=r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS m FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.x AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON n.x = c.x""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, by hash of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    marked = docs.select(
        "doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n = F.size("w")
    sized = marked.withColumns({"n": n, "a": F.when(n > 0, F.col("g") % F.greatest(n, F.lit(1))).cast("int")})
    left = F.col("n") - F.col("a")
    sized = sized.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil(left / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), left)
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ranked = found.withColumn("most", most)
    return ranked.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("most.start")).alias("start"), F.col("most.length").alias("length"),
        (-F.col("most.period")).alias("period"), F.floor(1000 * F.col("most.length") / -F.col("most.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(read(spark, sf_dir, "embeddings"))


@query("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_forest.judged_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
