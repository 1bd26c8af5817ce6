"""Quality rules with isolation forests on their statistics.

Each text gets the statistics that quality rules look at: words, characters per word, symbols, repeated lines, repeated
three-word windows. Two plain rules reject at once (``base_failed``). Isolation forests judge the rest: one on all
statistics together and one on each alone, since a text that is odd in one way only is lost in the mean over all. A
forest holds trees of random cuts, each grown on ``SAMPLE`` documents; a document that few cuts isolate has a short path
and a high score. How high is too high is read from the labelled documents, for each forest: the score, on a grid of
``GRID`` steps, that tells label 0 from label 1 best. The forests together reject at most ``MOST_GOOD_LOST`` of label 1;
one that tells nothing rejects nothing. All labelled documents count for it. The trees are grown on at most ``FIT_ROWS``
documents that pass the plain rules, the first by hash; this bounds what the driver holds. Statistics, scores and
verdicts cover every document and every whole text.

Edge cases: null and empty texts have no words and fail the plain rules. Rows with a null doc_id are judged like any
other and match no label. Repeated rows get equal verdicts. A doc_id with several labels counts once for each. Without
labels of both kinds each threshold is ``DEFAULT_THRESHOLD``; without documents to grow trees on every score is 0.5.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import shared

LEAST_WORDS, MOST_REPEATED = 50, 50  # plain rules: number of words, percent of words in repeated windows
WINDOW = 3
TREES, SAMPLE, FIT_ROWS, SEED = 100, 256, 20_000, 13
GRID, MOST_GOOD_LOST, DEFAULT_THRESHOLD = 10_000, 0.01, 0.7
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_FIRST_BYTE = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)  # of a code point in UTF-8


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: pa.Array) -> np.ndarray:
    """Counts (see ``COUNTS``) of a text column without nulls, one row per text."""
    words = shared.words_of(texts)
    n = len(texts)
    counts = np.zeros((n, len(COUNTS)), dtype=np.int64)
    counts[:, 0] = np.diff(words.first)
    if len(words.row):
        for column, table in ((1, _FIRST_BYTE), (2, _SYMBOL)):
            total = np.append(0, np.cumsum(table[words.data]))
            counts[:, column] = np.bincount(words.row, weights=total[words.end] - total[words.start], minlength=n)
        first, value = words.windows(WINDOW, seed=5)
        with np.errstate(over="ignore"):
            value = value ^ shared.mixed(words.row[first].astype(np.uint64) + np.uint64(1))  # windows of one text only
        _, which, times = np.unique(value, return_inverse=True, return_counts=True)
        again = first[times[which] > 1]
        change = np.zeros(len(words.row) + 1, dtype=np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + WINDOW, -1)
        counts[:, 4] = np.bincount(words.row, weights=np.cumsum(change)[:-1] > 0, minlength=n)
    counts[:, [5, 3]] = np.array([line_counts(t.as_buffer().to_pybytes()) for t in texts], dtype=np.int64).reshape(n, 2)
    return counts


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the ``COUNTS`` and ``base_failed`` per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c) for c in np.ascontiguousarray(statistics(part.column("text")).T))], names=["doc_id", *COUNTS])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumn("base_failed", failed)


def features(counts: np.ndarray) -> np.ndarray:
    """What the trees cut: size, word length, symbols a word, shares of repeated lines and of repeated words."""
    n_words, chars, symbols, dup_lines, repeated, lines = counts.T.astype(float)
    some = np.maximum(1, n_words)
    return np.column_stack([np.log1p(n_words), chars / some, symbols / some, dup_lines / np.maximum(1, lines), repeated / some])


#: Columns of ``features`` that each forest sees.
VIEWS = ((0, 1, 2, 3, 4), (0,), (1,), (2,), (3,), (4,))


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    large = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, large, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random cuts. A tree is a full binary tree of fixed depth; below a leaf all rows go left."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((trees, inner), dtype=np.int64)
        self.cut = np.full((trees, inner), np.inf)
        self.path = np.zeros((trees, 1 << self.depth))
        if self.size < 2:
            return
        for t in range(trees):
            self._grow(t, 0, 0, x[rng.choice(len(x), self.size, replace=False)], rng)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        low, high = rows.min(axis=0), rows.max(axis=0)
        able = np.flatnonzero(high > low)
        if depth == self.depth or not len(able):
            bottom = node
            for _ in range(self.depth - depth):
                bottom = 2 * bottom + 1
            self.path[t, bottom - ((1 << self.depth) - 1)] = depth + _mean_path(len(rows))
            return
        j = int(rng.choice(able))
        cut = rng.uniform(low[j], high[j])
        right = rows[:, j] > cut
        self.feature[t, node], self.cut[t, node] = j, cut
        self._grow(t, 2 * node + 1, depth + 1, rows[~right], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[right], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that fewer cuts isolate."""
        if self.size < 2:
            return np.full(len(x), 0.5)
        total, row = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += path[node - len(feature)]
        return 2.0 ** -(total / len(self.path) / _mean_path(self.size))


def fit_forests(stats: DataFrame, rows: int = FIT_ROWS) -> list[IsolationForest]:
    """One forest for each of the ``VIEWS``, grown on at most ``rows`` documents in ``stats`` that pass the plain rules."""
    fine = stats.where("NOT base_failed").select("doc_id", *COUNTS)
    share = min(1.0, 2 * rows / max(1, fine.count()))
    # equal rows count once; about twice the bound pass the first cut, so that no task sorts a whole table
    drawn = fine.withColumn("key", F.xxhash64("doc_id", *COUNTS)).where(F.pmod("key", F.lit(1 << 30)) <= int(share * (1 << 30))).distinct()
    table = drawn.orderBy("key", "doc_id", *COUNTS).limit(rows).select(*COUNTS).toPandas()
    x = features(table.to_numpy(dtype=np.int64).reshape(-1, len(COUNTS)))
    return [IsolationForest(x[:, view], seed=SEED + k) for k, view in enumerate(VIEWS)]


def with_scores(stats: DataFrame, forests: list[IsolationForest]) -> DataFrame:
    """``stats`` and each forest's score, as a whole number of grid steps, in the array ``steps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.column_stack([batch.column(c).to_numpy() for c in COUNTS]))
            steps = np.column_stack([np.floor(f.score(x[:, view]) * GRID) for f, view in zip(forests, VIEWS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(steps), pa.list_(pa.int32()))], names=[*batch.schema.names, "steps"])

    return stats.mapInArrow(run, T.StructType([*stats.schema, T.StructField("steps", T.ArrayType(T.IntegerType()))]))


def calibrated_thresholds(scored: DataFrame, labels: DataFrame) -> list[int]:
    """For each forest, the grid step up to which documents stay."""
    marks = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & F.col("labelled").isNotNull()).distinct()
    judged = scored.where("NOT base_failed").join(marks, F.col("doc_id") == F.col("labelled")).select("quality", F.posexplode("steps").alias("view", "step"))
    counts = np.zeros((len(VIEWS), 2, GRID + 1))
    for row in judged.groupBy("view", "quality", "step").agg(F.count(F.lit(1)).alias("n")).collect():  # as many rows as ``counts`` has cells
        counts[row["view"], row["quality"], row["step"]] = row["n"]
    return [threshold(*of_view) for of_view in counts]


def threshold(bad: np.ndarray, good: np.ndarray, most_lost: float = MOST_GOOD_LOST / len(VIEWS)) -> int:
    """The best step to cut two histograms at: most of ``bad`` above it, and at most a share of ``good``."""
    if not bad.sum() or not good.sum():
        return int(DEFAULT_THRESHOLD * GRID)
    caught, lost = (1 - np.cumsum(side) / side.sum() for side in (bad, good))
    gain = np.where(lost <= most_lost, caught - lost, 0.0)
    if gain.max() <= 1e-9:
        return GRID
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return int(best[len(best) // 2])  # the middle of the gap between the kinds


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of the rules, base_failed, kept and the excess over the thresholds per row of ``docs``."""
    stats = shared.written(rule_statistics(docs))
    scored = shared.written(with_scores(stats, fit_forests(stats)))
    limits = calibrated_thresholds(scored, labels)
    excess = F.greatest(*[F.col("steps")[k] - limit for k, limit in enumerate(limits)])
    return scored.select(
        "doc_id", *[c for c in COUNTS if c != "n_lines"], "base_failed", (~F.col("base_failed") & (excess <= 0)).alias("kept"),
        (excess / GRID).alias("excess"))
