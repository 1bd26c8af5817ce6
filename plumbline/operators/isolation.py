"""Multivariate outliers by an isolation forest.

Every tree is grown on ``SAMPLE`` rows of its own, dealt from the first by a hash of their key, and cuts a column at a random place
between the smallest and largest value that its node holds; column and place come from a hash of tree and node, so the
same table gives the same forest on any cluster. A row's score is ``2 ** (-mean path / c)``, where c is the path length
expected in a tree of that many rows. The trees hold a fixed number of nodes; the rows are scored by one pass of
vectorised lookups, and the threshold is an exact percentile of all scores.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, infos, missing
from plumbline.operators.checks import finish_issues
from plumbline.operators.ordering import exact_percentiles
from plumbline.session import checkpoint

TREES, SAMPLE, DEPTH = 32, 256, 8
DIGITS = 9  # of a score


def node_hash(tree: int, node: int) -> int:
    """32 bits that decide how a node is cut."""
    return int(hashlib.md5(f"{tree}:{node}".encode()).hexdigest()[:8], 16)


def expected_path(n: int) -> float:
    """Mean path length in a random tree of n rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class Tree:
    """A full binary tree of ``DEPTH`` cuts in heap order from 1; below a leaf every row goes left."""

    def __init__(self, number: int, rows: np.ndarray):
        self.column = np.zeros(1 << DEPTH, dtype=np.int64)
        self.cut = np.full(1 << DEPTH, np.inf)
        self.path = np.zeros(1 << DEPTH)
        self._grow(number, 1, 0, rows)

    def _grow(self, number: int, node: int, depth: int, rows: np.ndarray) -> None:
        able = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth == DEPTH or not len(able):
            self.path[(node << (DEPTH - depth)) - (1 << DEPTH)] = depth + expected_path(len(rows))
            return
        bits = node_hash(number, node)
        j = int(able[bits % len(able)])
        low, high = rows[:, j].min(), rows[:, j].max()
        self.column[node] = j
        self.cut[node] = low + (bits >> 8) / float(1 << 24) * (high - low)
        right = rows[:, j] > self.cut[node]
        self._grow(number, 2 * node, depth + 1, rows[~right])
        self._grow(number, 2 * node + 1, depth + 1, rows[right])

    def paths(self, x: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            node = 2 * node + (x[row, self.column[node]] > self.cut[node])
        return self.path[node - (1 << DEPTH)]


def grow(df: DataFrame, key: str, columns: list[str], trees: int = TREES, sample: int = SAMPLE) -> list[Tree]:
    """The trees of a table of complete rows; at most ``trees * sample`` rows, the first by hash of the key, reach the driver.

    A cut-off by hash comes before the order, so that no task orders the table; it is widened if it lets too few through.
    A table with fewer rows than that deals them to several trees.
    """
    n = df.count()
    wanted = min(n, trees * sample)
    hashed = df.select(F.md5(col(key).cast("string")).alias("_h"), *[col(c).cast("double").alias(c) for c in columns])
    order = [F.col("_h"), *[col(c) for c in columns]]
    share, rows = 2.0 * wanted / max(1, n), []
    while wanted:
        limit = f"{int(share * 2**32):08x}" if share < 1 else "g"  # "g" is above every hash
        rows = hashed.filter(F.col("_h") < limit).orderBy(*order).limit(wanted).collect()
        if len(rows) == wanted or share >= 1:
            break
        share *= 2
    pool = np.array([tuple(r)[1:] for r in rows], dtype=float).reshape(-1, len(columns))
    size = min(sample, len(pool))
    return [Tree(t, pool[(t * size + np.arange(size)) % len(pool)]) for t in range(trees)] if size else []


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The complete rows of ``df`` with ``_score``: 0 to 1, higher for rows that few cuts isolate."""
    complete = df.filter(reduce(lambda a, b: a & b, [~missing(i) for i in infos(df, columns)]))
    forest = grow(complete, key, columns, trees, sample)
    usual = expected_path(min(sample, complete.count())) or 1.0

    wide = len(complete.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(wide + j)) for j in range(len(columns))]).astype(float)
            path = reduce(np.add, (t.paths(x) for t in forest), np.zeros(len(x)))
            score = np.round(2.0 ** -(path / max(1, len(forest)) / usual), DIGITS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:wide], pa.array(score)], names=out.fieldNames())

    # plain names inside: a Python stage cannot take names with dots
    values = complete.select(*[col(c).alias(f"c{k}") for k, c in enumerate(complete.columns)], *[col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])
    out = T.StructType([*values.schema[:wide], T.StructField("score", T.DoubleType())])
    return values.mapInArrow(run, out).toDF(*complete.columns, "_score")


def isolated_rows(df: DataFrame, key: str, columns: list[str], contamination: float = 0.02) -> DataFrame:
    """Complete rows with ``_score`` and ``is_outlier``: the share ``contamination`` with the highest scores."""
    scored = checkpoint(isolation_scores(df, key, columns))
    cut = exact_percentiles(scored, {"s": F.col("_score")}, (1.0 - contamination,))
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_outlier", F.col("_score") > F.col("s__0")).drop("s__0")


def isolation_issue(df: DataFrame, dataset: str, key: str, columns: list[str] | None = None, contamination: float = 0.02) -> DataFrame:
    """The finding ``multivariate_outliers``; at least 2 numeric columns that are no ids, and 10 complete rows."""
    chosen = columns or [i.name for i in infos(df) if i.is_numeric and not i.is_id_like]
    if len(chosen) < 2:
        raise ValueError("multivariate outliers need two numeric columns")
    counts = isolated_rows(df, key, chosen, contamination).agg(F.count_if("is_outlier").alias("n_bad"), F.count(F.lit(1)).alias("n_checked"))
    return finish_issues(counts.filter("n_checked >= 10 AND n_bad > 0").select(
        F.lit(dataset).alias("dataset"), F.lit(",".join(chosen)).alias("column_name"), F.lit("multivariate_outliers").alias("issue_type"),
        F.lit("medium").alias("severity"), "n_bad", "n_checked"))
