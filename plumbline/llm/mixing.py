"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key; a source's documents are ordered by it, their word counts are summed up
along that order, and the source is cut where the sum reaches its budget. A budget above the source's size takes
whole epochs first and cuts the last one. The order is dealt out as equal key ranges per source, so the sums are
distributed: sums inside a range, then offsets over the ranges of a source. The cut is one row per source, so
applying it to the documents is a map-side lookup and no text is shuffled.

Targets: the sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``SHARE`` of all words.
A target stops at ``MOST_EPOCHS`` times its source's size and the excess goes to the others by weight; the fixed
point is found directly, by sorting the sources by the level at which they stop.

Edge cases: null text has no words and takes none. A null source is a source of its own. Documents with equal keys
(same doc_id and text) share what is left at the cut evenly, so that rows that agree get equal numbers; up to their
number of words stay below the target then. Sources without words have target 0. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import shared

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
ROWS_PER_RANGE = 2_000
KEY_DIGITS = 13  # hexadecimal digits of a key: 52 bits


def mix_key(seed: str = SEED):
    """Hash-random key of a document: a 52-bit number from its doc_id and text."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, KEY_DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target, most_rows) from ``sizes`` (source, size, ...): one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    cycle = F.array(*[F.lit(w) for w in weights])
    everything = Window.partitionBy(F.lit(1))
    ranked = totals.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source"))))
    weighed = ranked.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    stops = weighed.withColumn("stop", F.lit(most) * F.col("source_size")).withColumn("level", F.col("stop") / F.col("weight"))
    # sources ordered by the level at which they stop; a source stops if the level that its followers and it would share is not below its own
    before = everything.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = everything.orderBy("level", "place").rowsBetween(0, Window.unboundedFollowing)
    filled = (
        stops.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("shared", F.col("left") / F.col("weights_left"))
        .withColumn("stopped", F.col("shared") >= F.col("level"))
        # the first source that does not stop names the level of all that follow
        .withColumn("common", F.min(F.when(~F.col("stopped"), F.struct("level", "place", "shared"))).over(everything))
        .withColumn("free", F.coalesce(F.struct("level", "place") >= F.struct(F.col("common.level"), F.col("common.place")), F.lit(False)))
    )
    target = F.when(F.col("free"), F.least(F.col("common.shared") * F.col("weight"), F.col("stop").cast("double"))).otherwise(F.col("stop").cast("double"))
    return filled.select("source", "source_size", F.round(target, 6).alias("target"), F.max("n_rows").over(everything).alias("most_rows"))


def source_cuts(docs: DataFrame, seed: str = SEED, **targets) -> tuple[DataFrame, DataFrame]:
    """Sizes per document, and per source: target, whole epochs, the key of the cut and the words before and at it."""
    sizes = shared.written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", mix_key(seed).alias("key"), shared.word_count(F.col("text")).alias("size")))
    sources = shared.written(source_targets(sizes, **targets))
    row = sources.select("most_rows").first()  # one number
    ranges = 1 + (row[0] if row else 0) // ROWS_PER_RANGE
    width = -(-(1 << 4 * KEY_DIGITS) // ranges)
    ties = sizes.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).where("words > 0")
    dealt = ties.withColumn("part", F.floor(F.col("key") / F.lit(width)))
    part_sums = dealt.groupBy("source", "part").agg(F.sum("words").alias("part_words"))
    offsets = part_sums.withColumn(
        "offset", F.sum("part_words").over(Window.partitionBy("source").orderBy("part")) - F.col("part_words"))
    goal = sources.select(
        F.col("source").alias("s"), "source_size", "target",
        F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).alias("epochs"),
    ).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    here = F.col("source").eqNullSafe(F.col("s"))
    # the range in which the cut falls is known from the range sums; only its rows are summed one by one
    cut_parts = offsets.join(goal, here).where((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("part_words")))
    inside = dealt.join(
        cut_parts.select("s", F.col("part").alias("p"), "offset", "rest"), here & (F.col("part") == F.col("p")))
    running = inside.withColumn(
        "before", F.col("offset") + F.sum("words").over(Window.partitionBy("source", "part").orderBy("key")) - F.col("words"))
    at = running.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select(
        F.col("s").alias("cut_source"), F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("before")) / F.col("n")).alias("cut_words"))
    cuts = goal.join(at, F.col("s").eqNullSafe(F.col("cut_source")), "left").select(
        F.col("s").alias("cut_source"), "source_size", "target", F.coalesce("epochs", F.lit(0)).alias("epochs"), "cut_key", "cut_words")
    return sizes, shared.written(cuts)


def taken_words():
    """Words that the mix takes of a document, repeats counted; needs ``key``, ``size`` and the cut of its source."""
    last = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.least("cut_words", "size")).otherwise(0)
    return (F.col("epochs") * F.col("size") + F.coalesce(last, F.lit(0))).cast("long")


def mix_plan(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """doc_id, size, source_size, target, taken per document."""
    sizes, cuts = source_cuts(docs, seed, **targets)
    return sizes.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        "doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """The mix as rows of ``docs``: a document once per epoch that takes it whole.

    The document at a source's cut appears once more with only the words before the cut, so the budget is met
    exactly. Documents without words belong to no budget and stay as they are.
    """
    _, cuts = source_cuts(docs, seed, **targets)
    # the row travels as one value, so its column names cannot clash with those used here
    rows = docs.select(
        F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns]).alias("row"), mix_key(seed).alias("key"), shared.word_count(F.col("text")).alias("size"), "source")
    taken = rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").withColumn("taken", taken_words())
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size")))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
        F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut_text = F.array_join(F.slice(words, F.lit(1), F.greatest("copy", F.lit(0)).cast("int")), "")
    text = F.when(F.col("copy") < 0, F.col("row.text")).otherwise(cut_text)
    changed = {"text": text, "n_chars": F.when(F.col("copy") < 0, F.col("row").getField("n_chars")).otherwise(F.length(cut_text))} if (
        "n_chars" in docs.columns) else {"text": text}
    return taken.withColumn("copy", F.explode(copies)).select(
        *[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
