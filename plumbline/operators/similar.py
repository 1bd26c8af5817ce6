"""Near-duplicate rows and multivariate outliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_text, col, infos
from plumbline.operators.checks import finish_issues
from plumbline.operators.ordering import exact_percentiles
from plumbline.session import checkpoint


WORD = r"[\p{L}\p{N}]"


def token_sorted(df: DataFrame, columns: list[str]) -> Column:
    """Lower-case words of all columns, sorted and joined: word order does not matter."""
    text = F.lower(F.concat_ws(" ", *[as_text(i) for i in infos(df, columns)]))
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def grams(text: Column, q: int = 3) -> Column:
    """Hashes of the distinct q-character pieces; a shorter text is its own piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (q - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substr(text, i, F.lit(q)))))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_shingles(words_column: str, k: int = 3) -> Column:
    """Hashes of the distinct runs of k words. Takes a column, not an expression: an expression
    inside the lambda would be evaluated again for every run."""
    w = F.col(words_column)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - k))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


BITS = 1 << 26


def bit_table(members: Column, df: DataFrame) -> DataFrame:
    """Bits of fixed size in all, 8 MB at most, with one set for the hash of each member: what is not set is no member."""
    place = F.pmod(F.xxhash64(members), F.lit(BITS)) + 1
    return df.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))


def by_bits(df: DataFrame, member: Column, bits: DataFrame, how: str) -> DataFrame:
    """Rows whose bit is set (``left_semi``: all members, and a few more) or is not (``left_anti``), without a shuffle of the rows."""
    place = F.pmod(F.xxhash64(member), F.lit(BITS)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    here = (F.bitmap_bucket_number(place) == F.col("_part")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return df.join(F.broadcast(bits), here, how)


def similar_set_flags(sets: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """Keys of rows whose token set has another row's set within the Jaccard threshold; exact.

    * Equal sets collapse to one representative first, so a group of copies of any size costs one
      row afterwards.
    * Prefix filter: with tokens in a global order (rare first), two sets within the threshold share
      a token among the first ``size - ceil(t * size) + 1``. Only those tokens are posted, and a
      posting only counts where sizes and positions still allow the threshold.
    * Members of a token's group meet one hub of the group, not each other. Rows that a hub settles,
      and copies, look for no further partner; only the rest are matched with the group.
    """
    # checkpointed before anything filters on it: a filter pushed into the projection would evaluate
    # the set expression once more inside its own lambda
    ordered = sets.select(F.col(key).alias("k"), F.sort_array(tokens).alias("toks"))
    source = checkpoint(ordered.select("k", "toks", F.md5(F.array_join("toks", ",")).alias("digest")))
    # only sets that may have copies travel to be merged
    counts = source.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    may_repeat = checkpoint(bit_table(F.col("digest"), counts))
    merged = checkpoint(by_bits(source, F.col("digest"), may_repeat, "left_semi").groupBy("digest").agg(
        F.min("k").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("toks").alias("toks")))
    alone = by_bits(source, F.col("digest"), may_repeat, "left_anti").select(
        "digest", F.col("k").alias("id"), F.lit(1).cast("long").alias("copies"), "toks")
    groups = merged.unionByName(alone).withColumn("size", F.size("toks"))

    exploded = groups.select("id", "size", F.explode("toks").alias("tok"))
    shared = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    posted = exploded.join(shared, "tok")
    rare_first = Window.partitionBy("id").orderBy("freq", "tok")
    # tokens of one row only are rarer than all others and fill the head of the prefix
    position = F.row_number().over(rare_first) + F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    prefix = F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1
    postings = checkpoint(posted.withColumn("pos", position).filter(F.col("pos") <= prefix).select("tok", "id", "size", "pos"))

    def possible(other: str) -> Column:
        n, m = F.col("size"), F.col(f"{other}.size")
        best = 1 + F.least(n - F.col("pos"), m - F.col(f"{other}.pos"))
        return (m >= threshold * n) & (n >= threshold * m) & (best >= threshold / (1 + threshold) * (n + m) - 1e-9)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs)
        # the sets of rows in no pair stay where they are
        paired = checkpoint(bit_table(F.col("id"), pairs.select(F.explode(F.array("id", "pid")).alias("id"))))
        sets = by_bits(groups.select("id", "toks"), F.col("id"), paired, "left_semi")
        left = sets.select("id", F.col("toks").alias("a"))
        right = sets.select(F.col("id").alias("pid"), F.col("toks").alias("b"))
        return pairs.join(left, "id").join(right, "pid").filter(jaccard(F.col("a"), F.col("b")) >= threshold)

    entry = F.struct("id", "size", "pos")
    hubs = postings.groupBy("tok").agg(F.min(entry).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    links = postings.join(hubs, "tok").filter(F.col("id") != F.col("hub.id")).filter(possible("hub"))
    by_hub = checkpoint(
        verified(links.select("id", F.col("hub.id").alias("pid")).distinct())
        .select(F.explode(F.array("id", "pid")).alias("id")).distinct()
    )
    copied = groups.filter("copies > 1").select("id")
    open_rows = postings.join(by_hub.unionByName(copied).distinct(), "id", "left_anti").join(hubs.select("tok"), "tok", "left_semi")
    partners = postings.select("tok", entry.alias("other"))
    rest = open_rows.join(partners, "tok").filter(F.col("id") != F.col("other.id")).filter(possible("other"))
    settled = verified(rest.select("id", F.col("other.id").alias("pid")).distinct()).select("id").distinct()

    flagged = by_hub.unionByName(settled).unionByName(copied).distinct()
    digests = groups.join(flagged, "id", "left_semi").select("digest")
    return source.select("k", "digest").join(digests, "digest", "left_semi").select(F.col("k").alias(key))


def near_duplicate_rows(df: DataFrame, key: str, columns: list[str], threshold: float = 0.92, q: int = 3) -> DataFrame:
    """Keys of rows with a near duplicate over the joined text columns."""
    some = F.concat_ws(" ", *[as_text(i) for i in infos(df, columns)]).rlike(WORD)
    texts = df.filter(some).select(col(key), token_sorted(df, columns).alias("_t"))
    return similar_set_flags(texts.select(key, grams(F.col("_t"), q).alias("_g")), key, "_g", threshold)


def near_duplicate_documents(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 3) -> DataFrame:
    """Keys of long texts with a near duplicate, on word shingles of the whole text."""
    split = df.filter(col(text).rlike(WORD)).select(col(key), words(col(text)).alias("_w"))
    return similar_set_flags(split.select(key, word_shingles("_w", k).alias("_g")), key, "_g", threshold)


def near_duplicate_issue(df: DataFrame, dataset: str, key: str, columns: list[str], threshold: float = 0.92) -> DataFrame:
    found = near_duplicate_rows(df, key, columns, threshold).agg(F.count(F.lit(1)).alias("n_bad"))
    total = df.agg(F.count(F.lit(1)).alias("n_checked"))
    return finish_issues(found.crossJoin(F.broadcast(total)).filter("n_bad > 0").select(
        F.lit(dataset).alias("dataset"), F.lit("[row]").alias("column_name"), F.lit("near_duplicate_rows").alias("issue_type"),
        F.lit("medium").alias("severity"), "n_bad", "n_checked"))


def outlier_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Squared Mahalanobis distance of complete rows as ``_score``.

    Means and the k-by-k covariance come from one aggregate; only that one row visits the driver.
    """
    complete = df.dropna(subset=columns)
    k = len(columns)
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    row = complete.agg(
        *[F.avg(col(c).cast("double")).alias(f"m{x}") for x, c in enumerate(columns)],
        *[F.covar_samp(col(columns[a]).cast("double"), col(columns[b]).cast("double")).alias(f"c{a}_{b}") for a, b in cells],
    ).first()
    if row["m0"] is None:
        return complete.withColumn("_score", F.lit(None).cast("double"))
    cov = np.array([[row[f"c{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)], dtype=float)
    inverse = np.linalg.pinv(cov)
    centred = [col(c).cast("double") - F.lit(float(row[f"m{x}"])) for x, c in enumerate(columns)]
    score = sum(
        (centred[a] * centred[b] * F.lit(float(inverse[a, b] * (1 if a == b else 2))) for a, b in cells), F.lit(0.0))
    return complete.withColumn("_score", score)


def multivariate_outliers(df: DataFrame, dataset: str, columns: list[str] | None = None, contamination: float = 0.02) -> DataFrame:
    """The most distant share of rows over all numeric non-id columns; at least 2 columns, 10 rows."""
    chosen = columns or [i.name for i in infos(df) if i.is_numeric and not i.is_id_like]
    if len(chosen) < 2:
        raise ValueError("multivariate outliers need two numeric columns")
    scored = outlier_scores(df, chosen)
    cut = exact_percentiles(scored, {"s": F.col("_score")}, (1.0 - contamination,))
    counts = scored.crossJoin(F.broadcast(cut)).agg(
        F.count_if(F.col("_score") > F.col("s__0")).alias("n_bad"), F.count(F.lit(1)).alias("n_checked"))
    return finish_issues(counts.filter("n_checked >= 10 AND n_bad > 0").select(
        F.lit(dataset).alias("dataset"), F.lit(",".join(chosen)).alias("column_name"), F.lit("multivariate_outliers").alias("issue_type"),
        F.lit("medium").alias("severity"), "n_bad", "n_checked"))


def flag_multivariate_outliers(df: DataFrame, columns: list[str], contamination: float = 0.02) -> DataFrame:
    scored = outlier_scores(df, columns)
    cut = exact_percentiles(scored, {"s": F.col("_score")}, (1.0 - contamination,))
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_outlier", F.col("_score") > F.col("s__0")).drop("s__0")
