"""Near-duplicate rows by edit distance: every pair within the threshold, without comparing all pairs.

Two texts are similar if ``1 - edits / longer length`` reaches the threshold. Equal texts are one class first. Of a text
that allows k edits to its partner, one of k + 1 even segments occurs unchanged in the partner, near its own place.
Segments are the index, pieces of the other text the probe:

* Up to ``SHORT`` characters the key is (length, edits, segment number, text), and a partner offers, for each length that
  it may meet, only the pieces that can line up with the segment if the edits before and after it are counted. Where more
  than ``HEAVY`` texts share a segment, texts meet by half as many, longer parts instead, one of which has one edit at
  most: the key is a part, or a part without one of its characters.
* Beyond, that list grows with the third power of the length. There the segments have one of few lengths, so a partner
  offers each of its pieces of these lengths once, keyed by text hash and length band; the same line-up rule is applied
  to what meets.

Candidates are distinct pairs of numbers; only then do the texts travel, and the banded edit distance stops at the bound.
Where only the rows that have a partner are asked for, neighbours in the order of the texts, read forwards and backwards,
settle most of them; the rest meet all texts by the keys above.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_text, col, infos
from plumbline.operators.checks import finish_issues
from plumbline.operators.similar import WORD, token_sorted
from plumbline.session import checkpoint

SHORT = 64
HEAVY = 256
LEAST_SEGMENT = 6  # longer parts with one edit tell more than two segments only from here on
EPS = 1e-9


def _floor(x: Column) -> Column:
    return F.floor(x + EPS).cast("int")


def most_edits(n: Column, threshold: float) -> Column:
    """Edits between a text of length n and a similar one that is at least as long."""
    return _floor(n * ((1.0 - threshold) / threshold))


def _segment_starts(n: Column, parts: Column, i: Column) -> Column:
    return F.floor(i * n / parts).cast("int")


def segments(parts: Column) -> Column:
    """Array of (i, p, l): number, start and length of that many even segments of a text of length ``n``."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(
        i.cast("int").alias("i"), _segment_starts(F.col("n"), parts, i).alias("p"),
        (_segment_starts(F.col("n"), parts, i + 1) - _segment_starts(F.col("n"), parts, i)).alias("l")))


def _lines_up(start: Column, i: Column, p: Column, extra: Column, parts: Column) -> Column:
    """Whether a piece at ``start`` can be segment i if at most i edits come before and the rest after it."""
    return (F.abs(start - p) <= i) & (F.abs(start - p - extra) <= parts - 1 - i)


def text_classes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(k, s, id) of every row with a word in its text columns: key, sorted words, smallest key with the same words."""
    some = F.concat_ws(" ", *[as_text(i) for i in infos(df, columns)]).rlike(WORD)
    texts = checkpoint(df.filter(some).select(col(key).alias("k"), token_sorted(df, columns).alias("s")))
    named = texts.groupBy("s").agg(F.min("k").alias("id"))
    return texts.join(named, "s")


def _allowed(n: Column, threshold: float) -> Column:
    """Edits between two similar texts, the longer of length n."""
    return _floor(n * (1.0 - threshold))


def _edits_within(a: str, b: str, bound: str) -> Column:
    """Edit distance of two columns, or null or -1 beyond the bound."""
    # the third argument must be a number, so the bound is the power of two above it: the band stays within twice its need
    return F.coalesce(*[F.when(F.col(bound) <= step, F.levenshtein(a, b, step)) for step in (2**k for k in range(31))])


def _less_one(text: str, length: str, kind: int) -> str:
    """Keys of a text without one of its characters."""
    return f"array_distinct(transform(sequence(1, {length}), z -> xxhash64(m, k, i, {kind}, concat(substring({text}, 1, z - 1), substring({text}, z + 1)))))"


def _short_candidates(texts: DataFrame, asking: DataFrame, threshold: float, both_ways: bool) -> DataFrame:
    """(a, b): texts of ``asking`` and those of ``texts`` that may be similar, the shorter one of ``SHORT`` characters at most.

    ``m`` is the length of the text that holds the segments and ``k`` the edits that the longer of the two allows.
    """
    longest = int(SHORT / threshold + EPS)
    held = (
        texts.filter(F.col("n") <= longest).withColumn("m", F.col("n"))
        .withColumn("k", F.explode(F.sequence(_allowed(F.col("n"), threshold), most_edits(F.col("n"), threshold)))).filter("k > 0")
    )
    most = F.least(_floor(F.col("n") / threshold), F.when(F.col("n") <= SHORT, longest).otherwise(SHORT))
    least = F.greatest(F.col("n") - _allowed(F.col("n"), threshold), F.lit(1))
    top = most if both_ways else F.least(F.col("n"), most)
    asked = (
        asking.filter(least <= top).withColumn("m", F.explode(F.sequence(least, top)))
        .withColumns({"k": _allowed(F.greatest("n", "m"), threshold), "extra": F.col("n") - F.col("m")})
        .filter("k > 0 AND abs(extra) <= k")
    )

    def cut(asked: DataFrame, parts: Column) -> DataFrame:
        """A row for each segment (i, p, l) of the texts of length m."""
        starts = {"p": _segment_starts(F.col("m"), F.col("parts"), F.col("i")),
                  "l": _segment_starts(F.col("m"), F.col("parts"), F.col("i") + 1) - _segment_starts(F.col("m"), F.col("parts"), F.col("i"))}
        return asked.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(starts)

    # k + 1 segments, one of them unchanged, i edits at most before it
    whole = F.col("k") + 1
    entries = checkpoint(
        held.select("id", "m", "k", "s", F.inline(segments(whole)))
        .select(F.col("id").alias("a"), "m", "k", F.expr("xxhash64(m, k, i, 0, substring(s, p + 1, l))").alias("h")))
    counts = entries.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"), F.first("k").alias("k"))
    heavy = checkpoint(counts.filter((F.col("c") > HEAVY) & (F.col("m") >= LEAST_SEGMENT * whole)).select("h"))
    low = F.greatest(F.lit(0), F.col("p") - F.col("i"), F.col("p") + F.col("extra") - (F.col("k") - F.col("i")))
    high = F.least(F.col("n") - F.col("l"), F.col("p") + F.col("i"), F.col("p") + F.col("extra") + (F.col("k") - F.col("i")))
    probes = checkpoint(
        cut(asked, whole).withColumns({"low": low, "high": high}).filter("low <= high")
        .select(F.col("id").alias("b"), "m", "k", F.explode(F.expr(
            "array_distinct(transform(sequence(low, high), x -> xxhash64(m, k, i, 0, substring(s, x + 1, l))))")).alias("h")))
    met = entries.join(heavy, "h", "left_anti").join(probes, "h").select("a", "b")

    # half as many parts, one of them with one edit at most, 2 i + 1 edits at most before it and k - 2 i after it
    half = F.floor(F.col("k") / 2).cast("int") + 1
    of_heavy = lambda rows, x: rows.join(heavy, "h", "left_semi").select(F.col(x).alias("id"), "m", "k").distinct()
    part_entries = (
        of_heavy(entries, "a").join(texts, "id").select("id", "m", "k", "s", F.inline(segments(half)))
        .withColumn("seg", F.expr("substring(s, p + 1, l)"))
        .select(F.col("id").alias("a"), F.explode(F.concat(
            F.array(F.expr("xxhash64(m, k, i, 0, seg)")), F.expr(_less_one("seg", "l", 1)))).alias("h")))
    before = F.when(F.col("i") == 0, 0).otherwise(2 * F.col("i") + 1)
    after = F.when(F.col("i") == F.col("parts") - 1, 0).otherwise(F.col("k") - 2 * F.col("i"))
    shift = F.col("extra") - F.col("g")  # of the end of the part, where the piece is g longer
    pieces = (
        cut(of_heavy(probes, "b").join(asking, "id").withColumn("extra", F.col("n") - F.col("m")), half)
        .withColumn("g", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumns({"low": F.greatest(F.lit(0), F.col("p") - before, F.col("p") + shift - after),
                      "high": F.least(F.col("n") - F.col("l") - F.col("g"), F.col("p") + before, F.col("p") + shift + after)})
        .filter("low <= high").withColumn("x", F.explode(F.sequence("low", "high")))
        .filter("abs(x - p) + abs(extra - g - x + p) + abs(g) <= k")
        .select(F.col("id").alias("b"), "m", "k", "i", "g", (F.col("l") + F.col("g")).alias("l"), F.expr("substring(s, x + 1, l + g)").alias("seg")))
    part_probes = pieces.select("b", F.explode(
        F.when(F.col("g") == -1, F.array(F.expr("xxhash64(m, k, i, 1, seg)"))).when(F.col("g") == 0, F.expr(_less_one("seg", "l", 1)))
        .otherwise(F.expr(_less_one("seg", "l", 0)))).alias("h"))
    return met.unionByName(part_entries.join(part_probes, "h").select("a", "b")).filter("a <> b")


def _long_candidates(texts: DataFrame, asking: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b): texts a of more than ``SHORT`` characters and longer ones that may be similar, one of them of ``asking``."""
    # few lengths of segments, any place
    width = math.log(1.0 / threshold)
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    long = texts.filter(F.col("n") > SHORT)
    far = (
        long.withColumn("parts", most_edits(F.col("n"), threshold) + 1).select("id", "n", "parts", "s", F.inline(segments(F.col("parts"))))
        .select(F.col("id").alias("a"), F.col("n").alias("na"), "parts", "i", "p", "l", band.alias("band"), F.expr("xxhash64(substring(s, p + 1, l))").alias("h")))
    per = lambda n: F.floor(n / (most_edits(n, threshold) + 1)).cast("int")
    shortest = F.col("n") - _allowed(F.col("n"), threshold)
    own = F.sequence(F.greatest(shortest, F.lit(SHORT + 1)), F.col("n"))
    offered = F.array_distinct(F.flatten(F.transform(own, lambda n: F.array(per(n), per(n) + 1))))
    pieces = (
        long.select("id", "s", "n", band.alias("top"), F.explode(offered).alias("l")).filter("l > 0 AND l <= n")
        .select("id", "n", "l", "top", F.posexplode(F.expr("transform(sequence(0, n - l), x -> xxhash64(substring(s, x + 1, l)))")).alias("at", "h"))
        .select(F.col("id").alias("b"), F.col("n").alias("nb"), "l", "at", "h", F.explode(F.array(F.col("top"), F.col("top") - 1)).alias("band"))
    )

    def meeting(far: DataFrame, pieces: DataFrame) -> DataFrame:
        meets = far.join(pieces, ["band", "l", "h"]).filter("a <> b AND na <= nb")
        return meets.filter(_lines_up(F.col("at"), F.col("i"), F.col("p"), F.col("nb") - F.col("na"), F.col("parts"))).select("a", "b")

    if asking is None:
        return meeting(far, pieces)
    among = lambda rows, x: rows.join(asking.select(F.col("id").alias(x)), x, "left_semi")
    return meeting(among(far, "a"), pieces).unionByName(meeting(far, among(pieces, "b")))


def similar_pairs(classes: DataFrame, threshold: float, asked: DataFrame | None = None) -> DataFrame:
    """(a, b, edits, similarity) of all pairs of different texts of (id, s) within the threshold; a is the shorter text.

    With ``asked``, a frame of ``id``, only the pairs with one of these texts.
    """
    if not 0.5 < threshold < 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    texts = checkpoint(classes.select("id", "s", F.length("s").alias("n")))
    asking = None if asked is None else checkpoint(texts.join(asked, "id", "left_semi"))
    short = _short_candidates(texts, texts if asking is None else asking, threshold, asking is not None)
    found = short.unionByName(_long_candidates(texts, asking, threshold))
    candidates = checkpoint(found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    first, second = (texts.select(F.col("id").alias(x), F.col("s").alias("s" + x), F.col("n").alias("n" + x)) for x in "xy")
    bound = _allowed(F.greatest("nx", "ny"), threshold)
    both = candidates.join(first, "x").join(second, "y").withColumn("bound", bound).filter("abs(nx - ny) <= bound")
    measured = both.withColumn("edits", _edits_within("sx", "sy", "bound"))
    return measured.filter("edits >= 0 AND edits <= bound").select(
        F.when(F.col("nx") <= F.col("ny"), F.col("x")).otherwise(F.col("y")).alias("a"),
        F.when(F.col("nx") <= F.col("ny"), F.col("y")).otherwise(F.col("x")).alias("b"),
        "edits", F.round(1.0 - F.col("edits") / F.greatest("nx", "ny"), 6).alias("similarity"))


def similar_neighbours(texts: DataFrame, threshold: float) -> DataFrame:
    """Ids of (id, s) that are similar to one of the next two texts in their order, read forwards or backwards.

    Neighbours are those of one task; a partner that lies in the next one is not seen here.
    """
    def one_order(by: Column) -> DataFrame:
        dealt = texts.select("id", "s", by.alias("o")).repartitionByRange("o").withColumn("task", F.spark_partition_id())
        w = Window.partitionBy("task").orderBy("o")
        near = dealt.select("id", "s", *[F.lead(F.struct("id", "s"), d).over(w).alias(f"next{d}") for d in (1, 2)])
        pairs = near.select("id", "s", F.explode(F.array_compact(F.array("next1", "next2"))).alias("other")).select(
            "id", "s", F.col("other.id").alias("other"), F.col("other.s").alias("t"))
        bound = _allowed(F.greatest(F.length("s"), F.length("t")), threshold)
        close = pairs.withColumn("bound", bound).filter("abs(length(s) - length(t)) <= bound").withColumn("edits", _edits_within("s", "t", "bound"))
        return close.filter("edits >= 0 AND edits <= bound").select(F.explode(F.array("id", "other")).alias("id"))

    return one_order(F.col("s")).unionByName(one_order(F.reverse("s"))).distinct()


def near_duplicate_pairs(df: DataFrame, key: str, columns: list[str], threshold: float = 0.92) -> DataFrame:
    """(key_a, key_b, edits, similarity) of similar, different texts; a key stands for all rows with its words (the smallest)."""
    classes = text_classes(df, key, columns)
    found = similar_pairs(classes.select("id", "s").distinct(), threshold)
    return found.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "edits", "similarity")


def near_duplicate_keys(df: DataFrame, key: str, columns: list[str], threshold: float = 0.92) -> DataFrame:
    """Keys of the rows that have a partner: an equal text in other order of words, or a similar one."""
    classes = checkpoint(text_classes(df, key, columns))
    groups = checkpoint(classes.groupBy("id", "s").agg(F.count(F.lit(1)).alias("copies")))
    copied = groups.filter("copies > 1").select("id")
    settled = checkpoint(similar_neighbours(groups.select("id", "s"), threshold).unionByName(copied).distinct())
    found = similar_pairs(groups.select("id", "s"), threshold, groups.join(settled, "id", "left_anti").select("id"))
    marked = found.select(F.explode(F.array("a", "b")).alias("id")).unionByName(settled).distinct()
    return classes.join(marked, "id", "left_semi").select(F.col("k").alias(key))


def near_duplicate_issue(df: DataFrame, dataset: str, key: str, columns: list[str], threshold: float = 0.92) -> DataFrame:
    """The finding ``near_duplicate_rows``: rows that have a partner under edit similarity."""
    found = near_duplicate_keys(df, key, columns, threshold).agg(F.count(F.lit(1)).alias("n_bad"))
    total = df.agg(F.count(F.lit(1)).alias("n_checked"))
    return finish_issues(found.crossJoin(F.broadcast(total)).filter("n_bad > 0").select(
        F.lit(dataset).alias("dataset"), F.lit("[row]").alias("column_name"), F.lit("near_duplicate_rows").alias("issue_type"),
        F.lit("medium").alias("severity"), "n_bad", "n_checked"))
