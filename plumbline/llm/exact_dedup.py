"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut into chunks at positions that its content alone decides (the first
punctuation mark after ``MIN_CHUNK`` characters, or ``MAX_CHUNK`` characters where there is none). A document
becomes a recipe: the ordered list of its chunks' identifiers. Equal texts have equal recipes, and once the
identifiers are verified, equal recipes mean equal texts, so documents are compared by short lists.

Identifiers are digests, and verification makes them exact: one pass groups the distinct chunks by digest *and*
content. A digest with a second content gets a running number per content, which becomes part of the recipe of
every document with that digest. A distinct chunk leaves a map task once; a long document never moves as a whole.

Edge cases: null text counts as empty, and all empty texts are one group. A null doc_id sorts last. Rows that agree
in doc_id and text are one document written several times: they are reported alike and ``keep_one`` leaves one of
them. Rows that share a doc_id but not the text are different documents. An empty table gives an empty result.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import shared

MIN_CHUNK, MAX_CHUNK = 256, 1024
CHUNKS = r"(?s).{%d,%d}?\p{P}|.{1,%d}" % (MIN_CHUNK - 1, MAX_CHUNK - 1, MAX_CHUNK)


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), shared.BLANKS, "")


def chunks(text):
    return F.regexp_extract_all(normalised(text), F.lit(CHUNKS), F.lit(0))


def digest(chunk, bits: int = 64):
    """Digest of a chunk; fewer ``bits`` only in tests, to make digests collide."""
    value = F.xxhash64(chunk)
    return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, tag, n_points, text_sha, recipe) per row of ``docs``, written to the shared folder."""
    text = F.col("text")
    return shared.written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), shared.text_tag(text).alias("tag"),
        F.length(F.coalesce(text, F.lit(""))).alias("n_points"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("text_sha"),
        F.transform(chunks(text), lambda c: digest(c, bits)).alias("recipe"),
    ))


def contested_digests(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Digests that stand for more than one content; normally none."""
    distinct = docs.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(
        digest(F.col("chunk"), bits).alias("digest"), "chunk").distinct()
    return shared.written(distinct.groupBy("digest").count().where("count > 1").select("digest"))


def with_content_numbers(docs: DataFrame, table: DataFrame, contested: DataFrame, bits: int) -> DataFrame:
    """``table`` with recipes that also name the content of every chunk whose digest is contested."""
    places = docs.select(
        F.col("doc_id").cast("long").alias("d"), shared.text_tag(F.col("text")).alias("t"),
        F.posexplode(chunks(F.col("text"))).alias("place", "chunk"),
    ).withColumn("digest", digest(F.col("chunk"), bits)).join(contested, "digest", "left_semi")
    contents = places.select("digest", "chunk").distinct()
    numbered = contents.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")))
    lists = (
        places.join(numbered, ["digest", "chunk"])
        .select("d", "t", (F.col("place").cast("long") * F.lit(1 << 32) + F.col("number")).alias("at")).distinct()
        .groupBy("d", "t").agg(F.sort_array(F.collect_list("at")).alias("numbers"))
    )
    return shared.written(
        table.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
        .withColumn("recipe", F.concat("recipe", F.coalesce("numbers", F.array().cast("array<bigint>"))))
        .select(table.columns)
    )


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and tag per row of ``docs``."""
    table = recipes(docs, bits)
    contested = contested_digests(docs, bits)
    if not contested.isEmpty():
        table = with_content_numbers(docs, table, contested, bits)
    rank = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id"), F.col("tag"))
    # written first: the join then has plain exchanges on both sides, and a group with a third of all rows can be split
    groups = shared.written(
        table.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("first"))
        .where("group_size > 1").withColumnRenamed("recipe", "group_recipe")
    )
    joined = table.join(groups, F.col("recipe") == F.col("group_recipe"), "left")
    alone = F.col("first").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tag") == F.col("tag")))).alias("kept"),
        F.lower(F.hex("text_sha")).alias("text_sha256"),
        "tag",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    return shared.kept_rows(docs, exact_groups(docs))
