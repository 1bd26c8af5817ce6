"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the text alone: character classes, word and line statistics, repetition. Each feature is cut
into bins at the quantiles of the training rows. Training cycles over the features; each step fits a shallow tree
(at most four leaves) to the gradient histogram of one feature and adds a small share of it to that feature's
lookup table. Pairs of features follow: the pairs with the largest gain from one cut in each get tables of their
own, boosted the same way. The score of a text is the logistic function of the sum of its bins' table values,
looked up for all rows of a batch at once.

Training uses labelled rows of known quality whose ``crc32(doc_id) mod 5`` is not 0, at most ``MAX_LABELLED`` of them
(the first by hash of the doc_id, one document each; a bound on what the driver holds). Everything else covers all rows.

Edge cases: null and empty texts have all features 0 and get a score like any other. Rows with a null doc_id are
scored and never trained on. Repeated rows get equal scores. Without labels, or with one class only, the score is
the smoothed share of label 1. Other columns are passed through by ``keep_good`` and not read otherwise.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared

MAX_LABELLED = 20_000
FOLDS, THRESHOLD = 5, 0.3
BINS, ROUNDS, RATE, L2 = 32, 60, 0.2, 1.0
PAIRS, PAIR_BINS, PAIR_ROUNDS = 8, 8, 20

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "blank", "newline", "plain_mark", "quote", "symbol", "exclamation", "pipe",
    "beyond_ascii", "control", "distinct_words", "top_word", "repeats", "words_per_line", "sentence_ends", "marked_words",
)
# byte classes, as index into counts per text
_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, 9, 11, 12, 13), "newline": (10,),
    "plain_mark": b".,;:?-", "quote": b"\"'()`", "symbol": b"#$%&*+/<=>@[\\]^_{}~", "exclamation": b"!", "pipe": b"|",
}
_NAMES = [*_CLASSES, "beyond_ascii", "control"]
_CLASS_OF = np.full(256, len(_NAMES) - 1, dtype=np.int64)
_CLASS_OF[128:] = len(_NAMES) - 2
for _k, _codes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_codes)] = _k


def features(texts: pa.Array) -> np.ndarray:
    """Feature rows (float32) of a text column without nulls; at most 60,000 rows at once."""
    words = shared.words_of(texts)
    n = len(texts)
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    row_of_byte = np.repeat(np.arange(n), sizes)
    counts = np.bincount(row_of_byte * len(_NAMES) + _CLASS_OF[words.data], minlength=n * len(_NAMES)).reshape(n, -1).astype(float)
    share = dict(zip(_NAMES, (counts / np.maximum(1, sizes)[:, None]).T))
    n_words = np.diff(words.first).astype(float)
    some = np.maximum(1, n_words)
    length = words.end - words.start
    last = words.data[words.end - 1] if len(length) else np.empty(0, np.uint8)
    per_row = lambda x: np.bincount(words.row, weights=x, minlength=n)[:n] if len(words.row) else np.zeros(n)
    key = np.sort((words.row.astype(np.uint64) << np.uint64(48)) | (words.hash >> np.uint64(16)))
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    run, run_row = np.diff(np.append(start, len(key))), (key[start] >> np.uint64(48)).astype(np.int64)
    distinct = np.bincount(run_row, minlength=n)[:n]
    top = np.zeros(n)
    np.maximum.at(top, run_row, run)
    again = np.zeros(len(words.row))
    if len(again) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    lines = counts[:, _NAMES.index("newline")] + 1
    columns = [
        np.log1p(sizes), np.log1p(n_words), per_row(length) / some, share["upper"], share["digit"], share["blank"], share["newline"],
        share["plain_mark"], share["quote"], share["symbol"], share["exclamation"], share["pipe"], share["beyond_ascii"], share["control"],
        distinct / some, top / some, per_row(again) / some, np.log1p(n_words / lines),
        per_row(np.isin(last, list(b".?"))) / some, per_row(np.isin(last, list(b"#$%&*!|"))) / some,
    ]
    return np.column_stack(columns).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram into a left and a right side."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Table of a tree with at most four leaves over the bins of one feature."""
    _, middle = _best_cut(g, h)
    cuts = {0, len(g)}
    if middle:
        cuts |= {middle, _best_cut(g[:middle], h[:middle])[1], middle + _best_cut(g[middle:], h[middle:])[1]}
    edges = sorted(cuts)
    table = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        table[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return table


def quadrant_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree that cuts each of two features once."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def corners(s):
        a = s[:-1, :-1]
        top, left, total = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return a, top - a, left - a, total - top - left + a

    gain = sum(x**2 / (y + L2) for x, y in zip(corners(G), corners(H)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    table = np.zeros_like(g)
    for rows, cols in itertools.product((slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None))):
        table[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + L2)
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + L2)), table


class AdditiveModel:
    """Intercept, one table per feature and one per chosen pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, p = x.shape
        self.intercept = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(p)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if n == 0 or y.min() == y.max():
            return
        bins = self._bins(x)
        total = np.full(n, self.intercept)
        for _, j in itertools.product(range(ROUNDS), range(p)):
            b, size = bins[j], len(self.tables[j])
            q = _sigmoid(total)
            step = RATE * shallow_tree(np.bincount(b, y - q, size), np.bincount(b, q * (1 - q), size))
            self.tables[j] += step
            total += step[b]
        coarse = self._coarse(bins)
        q = _sigmoid(total)
        grid = lambda i, j, w: np.bincount(coarse[i] * PAIR_BINS + coarse[j], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        gains = sorted(((quadrant_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)))[0], i, j) for i, j in itertools.combinations(range(p), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains[:PAIRS]]
        for _, (i, j, table) in itertools.product(range(PAIR_ROUNDS), self.pairs):
            q = _sigmoid(total)
            step = RATE * quadrant_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)))[1]
            table += step
            total += step[coarse[i], coarse[j]]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def _coarse(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        return [b * PAIR_BINS // len(t) for b, t in zip(bins, self.tables)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        total = np.full(len(x), self.intercept)
        for b, table in zip(bins, self.tables):
            total += table[b]
        coarse = self._coarse(bins)
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return _sigmoid(total)


def fold_of(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled rows outside the held-out fold."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & (fold_of(F.col("labelled")) != 0))
        .orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(limit)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "tag", "quality")), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "tag", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most ``limit`` rows of two numbers: small enough to send to every task
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select(
        "id", shared.text_tag(F.col("text")).alias("tag"), "text", "quality").mapInArrow(run, "id long, tag long, quality int, x array<float>")
    # documents may share a labelled doc_id: the one with the smallest text hash counts, so the bound holds and reruns agree
    table = rows.groupBy("id", "quality").agg(F.min_by("x", "tag").alias("x")).select("quality", "x").toPandas()
    x = np.array(table["x"].tolist(), dtype=np.float32).reshape(-1, len(FEATURES))
    order = np.lexsort(np.column_stack([x, table["quality"]]).T) if len(x) else np.empty(0, int)  # independent of task order
    return x[order], table["quality"].to_numpy(dtype=float)[order]


def train(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    return AdditiveModel(*training_rows(docs, labels))


def with_scores(model: AdditiveModel, rows: DataFrame, keep: bool) -> DataFrame:
    """``rows`` (with a ``text`` column) and their ``score``; or with ``keep`` the rows whose score passes, unchanged."""
    names = rows.columns
    # plain names inside: a Python stage cannot take names with dots
    rows = rows.toDF(*[c if c == "text" else f"c{k}" for k, c in enumerate(names)])
    schema = rows.schema if keep else rows.drop("text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.pieces(batch, "text"):
                scores = model.score(features(pc.fill_null(part.column("text"), "")))
                if keep:
                    yield part.filter(pa.array(scores >= THRESHOLD))
                else:
                    rest = [c for c in part.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(scores)], names=[*rest, "score"])

    return rows.mapInArrow(run, schema).toDF(*(names if keep else [*(c for c in names if c != "text"), "score"]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    model = train(docs, labels)
    scored = with_scores(model, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep=False)
    return scored.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score passes the threshold, with all their columns."""
    return with_scores(train(docs, labels), docs, keep=True)
