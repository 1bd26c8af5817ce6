"""Jaccard self-join of documents on word n-grams with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct shingles. All sets are ordered alike: by how often a shingle
occurs (as far as it stands out in a table of counts of fixed size, which covers all documents), then by hash. If two
sets are similar enough, the first ``n - ceil(t*n) + l`` shingles of each share at least ``l``. A document may choose
any ``l`` up to ``MOST_MATCHES``: a longer prefix costs more postings, but more shared shingles are asked for before a
pair is verified. Each document estimates that cost from the counts in its prefix and takes the cheapest ``l``; in a
pair the larger document's choice holds.

1. Equal sets become one class. 2. Prefix postings meet by shingle; shingles of one class only go. 3. Rounds of stars:
per shingle, one class meets the others, promising pairs are verified, and linked classes are joined to components.
A big group of near copies collapses here without its pairs being listed. 4. Pairs of *different* components
meet at shingles from which on enough of both prefixes is left; all that share enough prefix shingles are verified. So every link lies inside a
component. Verification compares whole sets, which are made anew from the texts of the documents concerned.

Hashing: shingles are compared by 64-bit hashes, sets by 128 bits. Edge cases: null or blank texts have the empty set
and are linked with nothing; texts with fewer words than a shingle are one shingle. The component of rows without
links is their own doc_id. Rows may repeat and doc_ids may be null or shared: sets are compared, not ids; a component
is named by its smallest doc_id that is not null. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm.components import components

WIDTH, PERCENT = 5, 80
MOST_MATCHES = 4
COUNT_BITS, COUNT_PARTS = 21, 1024
STAR_ROUNDS = 2
VERIFY_COST = 8  # cost of verifying a candidate, in postings
FILTER_BITS = 23


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of the texts with words, and their sorted distinct shingle hashes."""
    words = shared.words_of(texts, lower=True)
    first, value = words.windows(WIDTH)
    bounds = np.searchsorted(first, words.first)
    n_words = np.diff(words.first)
    rows = np.flatnonzero(n_words)
    sets = []
    for r in rows:
        if n_words[r] >= WIDTH:
            sets.append(np.unique(value[bounds[r]:bounds[r + 1]]))
        else:
            with np.errstate(over="ignore"):
                h = np.uint64(n_words[r])
                for x in words.hash[words.first[r]:words.first[r + 1]]:
                    h = shared.mixed(np.array([h * np.uint64(31) + x]))[0]
            sets.append(np.array([h], dtype=np.uint64))
    return rows, sets


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures per set."""
    if not sets:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    n = np.array([len(s) for s in sets], dtype=np.uint64)
    with np.errstate(over="ignore"):
        return tuple(shared.mixed(np.add.reduceat(shared.mixed(flat ^ np.uint64(c)), at) + n) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def needed_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of size ``n`` that any similar set must share."""
    return (PERCENT * n + 99) // 100


def document_sets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tag, a, b, n) per document and (part, counts) of shingle counts per task, in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, dtype=np.int32)
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                rows, sets = shingle_sets(part.column("text"))
                a, b, n = (np.zeros(len(part), dtype=t) for t in (np.uint64, np.uint64, np.int64))
                a[rows], b[rows] = signatures(sets)
                n[rows] = [len(s) for s in sets]
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
                none = pa.nulls(len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), shared.signed(a), shared.signed(b), pa.array(n), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        found = [(i, c.tobytes()) for i, c in enumerate(counts.reshape(COUNT_PARTS, -1)) if c.any()]
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, none, pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names=names)

    names = ["doc_id", "tag", "a", "b", "n", "part", "counts"]
    tagged = _texts(docs).select("doc_id", shared.text_tag(F.col("text")).alias("tag"), "text")
    return shared.written(tagged.mapInArrow(run, "doc_id long, tag long, a long, b long, n long, part int, counts binary"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def frequency_levels(table: DataFrame) -> np.ndarray:
    """Per slot of the count table: the logarithm of how far its count stands out; 2 ** COUNT_BITS bytes, whatever the input."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                value = np.frombuffer(counts, dtype=np.int32)
                sums[part] = sums[part] + value if part in sums else value.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    rows = table.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(total, "part int, counts binary")
    counts = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS))
    for row in rows.collect():  # COUNT_PARTS rows of fixed size
        counts[row["part"]] = np.frombuffer(row["counts"], dtype=np.int64)
    mean = counts.mean()
    return np.log2(np.maximum(1, counts - mean - 3 * np.sqrt(mean))).astype(np.uint8).ravel()


def prefix_of(values: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The longest prefix of a set, the length of the shortest, and the number of matches that is cheapest to ask for."""
    n = len(values)
    level = levels[(values >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    order = np.lexsort((values, level)) if level.any() else np.arange(n)
    need = int(needed_overlap(n))
    shortest = n - need + 1
    most = min(MOST_MATCHES, need)
    longest = shortest + most - 1
    postings = np.cumsum(np.exp2(level[order[:longest]]))[shortest - 1:]
    cost = postings * (1 + VERIFY_COST / np.arange(1, most + 1))
    return values[order[:longest]], shortest, int(cost.argmin()) + 1


def postings(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(token, a, n, level, matches, at) of every prefix shingle; ``level`` is the smallest prefix that holds it, ``at`` its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                _, sets = shingle_sets(part.column("text"))
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                for values, a in zip(sets, signatures(sets)[0].tolist()):
                    if a in seen:
                        continue
                    seen.add(a)
                    prefix, shortest, matches = prefix_of(values, levels)
                    size = len(prefix)
                    level = np.maximum(1, np.arange(2 - shortest, size + 2 - shortest))
                    for c, x in zip(columns, (prefix, np.full(size, a, np.uint64), np.full(size, len(values)), level, np.full(size, matches), np.arange(size))):
                        c.append(x)
                if columns[0]:
                    token, a, *rest = map(np.concatenate, columns)
                    yield pa.RecordBatch.from_arrays(
                        [shared.signed(token), shared.signed(a), *(pa.array(x.astype(np.int32)) for x in rest)],
                        names=["token", "a", "n", "level", "matches", "at"])

    return _texts(docs).mapInArrow(run, "token long, a long, n int, level int, matches int, at int")


def shared_postings(posted: DataFrame) -> DataFrame:
    """The postings whose shingle lies in the prefix of another class too, each once."""
    by_token = Window.partitionBy("token").orderBy("a")
    marked = posted.withColumns({"next": F.lead("a").over(by_token), "least": F.first("a").over(by_token)})
    once = marked.where(F.col("next").isNull() | (F.col("next") != F.col("a")))
    return shared.written(once.where(F.col("next").isNotNull() | (F.col("least") != F.col("a"))).drop("next", "least"))


def sets_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, shingles) of the classes in ``keys``, made anew from the texts; may hold others."""
    # a bit table of fixed size keeps most other sets out of the shuffle; the joins drop the rest
    table = shared.bit_table(keys.select(F.pmod("a", F.lit(1 << FILTER_BITS)).alias("bit")), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                _, sets = shingle_sets(part.column("text"))
                a, b = signatures(sets)
                bit = (a & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                chosen = [i for i in np.flatnonzero(shared.bits_on(table, bit)) if int(a[i]) not in seen]
                chosen = list({int(a[i]): i for i in chosen}.values())
                seen.update(int(a[i]) for i in chosen)
                yield pa.RecordBatch.from_arrays(
                    [shared.signed(a[chosen]), shared.signed(b[chosen]), pa.array([sets[i].tobytes() for i in chosen], pa.binary())], names=["a", "b", "shingles"])

    return _texts(docs).mapInArrow(run, "a long, b long, shingles binary").dropDuplicates(["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) of classes whose whole sets are similar enough, as (xa, xb, ya, yb)."""
    pairs = shared.written(pairs.select("x", "y"))
    keys = pairs.select(F.col("x").alias("a")).unionByName(pairs.select(F.col("y").alias("a"))).distinct()
    sets = shared.written(sets_of(docs, keys))
    side = lambda s: sets.select(*[F.col(c).alias(s + c) for c in sets.columns])
    both = pairs.join(side("x"), F.col("x") == F.col("xa")).join(side("y"), F.col("y") == F.col("ya"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("xshingles"), batch.column("yshingles")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                similar.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["xa", "xb", "ya", "yb"]).filter(pa.array(similar, pa.bool_()))

    return shared.written(both.select("xa", "xb", "ya", "yb", "xshingles", "yshingles").mapInArrow(run, "xa long, xb long, ya long, yb long"))


def labelled(shared_rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of their class, of the shingles that several components share."""
    if labels is None:
        return shared_rows.withColumn("comp", F.col("a"))
    rows = shared_rows.join(labels, "a", "left").withColumn("comp", F.coalesce("root", "a")).drop("root")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return rows.join(mixed, "token", "left_semi")


def relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(a, root) after the links found: classes with one root are linked, though linked classes may still have two.

    A class moves with all that share its root to the smallest root within two links.
    """
    links = found.select(F.col("xa").alias("x"), F.col("ya").alias("y"))
    if labels is not None:
        for s in "xy":
            named = labels.select(F.col("a").alias("k"), F.col("root").alias("r"))
            links = links.join(named, F.col(s) == F.col("k"), "left").withColumn(s, F.coalesce("r", s)).drop("k", "r")
    both = shared.written(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    # two steps of the smallest name: a star's centre learns it from one leaf and passes it to all
    near = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("low"))
    far = both.join(near.select(F.col("x").alias("y"), "low"), "y").groupBy("x").agg(F.min("low").alias("to"))
    moves = shared.written(far.where("to < x"))
    if labels is None:
        return moves.select(F.col("x").alias("a"), F.col("to").alias("root"))
    kept = labels.join(moves, F.col("root") == F.col("x"), "left").select("a", F.coalesce("to", "root").alias("root"))
    fresh = moves.join(labels, F.col("x") == F.col("a"), "left_anti").select(F.col("x").alias("a"), F.col("to").alias("root"))
    return shared.written(kept.unionByName(fresh))


def star_pairs(rows: DataFrame, number: int) -> DataFrame:
    """Promising pairs of one class per shingle with the other components' classes of that shingle.

    The first round takes the class that shares the largest part of its prefix with others, as an original does with
    its copies; later rounds take any.
    """
    shares = F.count(F.lit(1)) / F.first(prefix_length(F.col("n"))) if number == 0 else F.first(F.lit(0.0))
    weight = rows.groupBy("a").agg(F.struct(shares.alias("part"), F.first(F.xxhash64("a", F.lit(number))).alias("any")).alias("h"))
    hub = rows.join(weight, "a").groupBy("token").agg(
        F.max(F.struct("h", F.col("a").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))).alias("s"))
    met = rows.join(hub.select("token", "s.hub", "s.hub_n", "s.hub_comp"), "token").where("comp <> hub_comp")
    similar_size = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * PERCENT
    return (
        met.where(similar_size).groupBy(F.col("a").alias("x"), F.col("hub").alias("y")).agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        .where(F.col("c") * 20 >= F.col("n"))
    )


def prefix_length(n, most=MOST_MATCHES):
    need = F.floor((n * PERCENT + 99) / 100)
    return n - need + F.least(F.lit(most), need)


def remaining_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components whose prefixes can hold the matches that the larger class asks for, and the overlap.

    Shared shingles come in the same order in both prefixes. From the first one on, both classes must have as many
    postings left as the pair needs matches, or the pair is out; so a shingle makes a pair only while that many are left,
    and the first shared shingle of a similar pair always does.
    """
    after = Window.partitionBy("a").orderBy(F.desc("at"))
    rows = shared.written(rows.withColumn("left", F.row_number().over(after)))
    x, y = (rows.select("token", *[F.col(c).alias(s + c) for c in ("a", "n", "level", "matches", "comp", "left")]) for s in "xy")
    # what the prefixes do not show can add at most the longer of both rests
    rest = F.greatest(F.col("xn") - prefix_length(F.col("xn")), F.col("yn") - prefix_length(F.col("yn")))
    overlap = F.ceil((F.col("xn") + F.col("yn")) * PERCENT / (100 + PERCENT))
    possible = F.least("xleft", "yleft") >= overlap - rest
    # matches are counted in the prefixes of the chosen length; the last shingles of a longer prefix do not count
    chosen = (F.col("xlevel") <= F.col("xmatches")) & (F.col("ylevel") <= F.col("xmatches"))
    enough = F.least(F.col("xleft"), F.col("yleft")) >= F.col("xmatches")
    larger = (F.col("xn") > F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xa") > F.col("ya")))
    met = x.join(y, "token").where(
        possible & enough & chosen & larger & (F.col("xcomp") != F.col("ycomp")) & (F.col("yn") * 100 >= F.col("xn") * PERCENT))
    pairs = shared.written(met.select("xa", "ya", "xmatches", (overlap - rest).alias("need")).distinct())
    # the matches of each pair are counted in the prefixes, which are short lists
    lists = rows.groupBy("a").agg(F.collect_list("token").alias("tokens"))
    for s in "xy":
        pairs = pairs.join(lists.select(F.col("a").alias(s + "a"), F.col("tokens").alias(s + "tokens")), s + "a")
    matches = F.size(F.array_intersect("xtokens", "ytokens"))
    return pairs.where(matches >= F.greatest("xmatches", "need")).select(F.col("xa").alias("x"), F.col("ya").alias("y"))


def grouped_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, a, b, n) of the documents, and (ca, cb, component, first) of each class of equal sets.

    ``component`` is the smallest doc_id of all linked classes, ``first`` its row: (null or not, doc_id, tag).
    """
    table = document_sets(docs)
    levels = frequency_levels(table)
    rows = table.where("part IS NULL").select("doc_id", "tag", "a", "b", "n")
    classes = shared.written(
        rows.where("n > 0").groupBy("a", "b").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")).alias("least")).withColumn("class", F.monotonically_increasing_id()))
    posted = shared_postings(postings(docs, levels))
    found, labels = [], None
    for number in range(STAR_ROUNDS):
        found.append(verified(docs, star_pairs(labelled(posted, labels), number)))
        if found[-1].isEmpty():
            break
        labels = relabelled(labels, found[-1])
    found.append(verified(docs, remaining_pairs(labelled(posted, labels))))
    links = reduce(DataFrame.unionByName, found)
    for s in "xy":
        links = links.join(classes.select(F.col("a").alias(s + "a"), F.col("b").alias(s + "b"), F.col("class").alias(s)), [s + "a", s + "b"])
    roots = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    grouped = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("root", "class"))
    ids = grouped.groupBy("group").agg(F.min("least").alias("first"))
    # written first: the join of the rows has plain exchanges, and a class with a third of all rows can be split
    named = shared.written(grouped.join(ids, "group").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("first.doc_id").alias("component"), "first"))
    return rows, named


def _with_component(rows: DataFrame, named: DataFrame) -> DataFrame:
    return rows.join(named, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0), "left")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``."""
    return _with_component(*grouped_rows(docs)).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (null last), then of the smallest text hash.

    Rows are told apart by doc_id and text, so a row goes only for its own text. Rows without words stay, rows that
    agree in doc_id and text are one document.
    """
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    marks = _with_component(*grouped_rows(docs)).select("doc_id", "tag", F.coalesce(own.eqNullSafe(F.col("first")) | F.col("first").isNull(), F.lit(True)).alias("kept"))
    return shared.kept_rows(docs, marks)
