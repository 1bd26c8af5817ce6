"""Rank association of column pairs (Kendall) and distances between the distributions of two tables.

Kendall's tau-b asks of every pair of rows whether both columns order it alike. The rows are grouped by value pair and
each column is cut into quantile chunks; a value that is itself a cut stands alone. Pairs of rows in different chunks of
both columns are counted from the matrix of chunk counts, which has a fixed number of cells. Pairs that share a chunk of
one column are counted inside that chunk by one ordered pass in a task. Chunks of one value hold ties only and are
skipped, so a hot value costs nothing. Tie corrections come from value counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.ordering import exact_percentiles, held, quantile_chunks
from plumbline.session import checkpoint

SIDE = 16  # chunks of a column: SIDE ** 2, twice that with the values that stand alone


def order_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    """Sum over all pairs of weighted points of +1 if both coordinates order them alike, -1 if not, 0 for ties.

    Points go through in order of x; the ranks of y are compared bit by bit, from the highest down. Exact: sums are
    kept as Python integers where a long might overflow.
    """
    if len(x) < 2:
        return 0
    order = np.lexsort((y, x))
    x, weight = x[order], weight[order]
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    kind = np.int64 if float(weight.sum()) ** 2 < 2.0**62 else object
    weight = weight.astype(kind)
    total = 0
    at = np.arange(len(x))
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        group, up = rank[at] >> (bit + 1), (rank[at] >> bit) & 1
        w = weight[at]
        low, high = np.cumsum(w * (1 - up)), np.cumsum(w * up)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        of = np.repeat(first, np.diff(np.append(first, len(at))))
        before_low, before_high = low - (w * (1 - up)), high - (w * up)
        # pairs that differ first in this bit: the earlier point below counts up, the earlier point above counts down
        total += int((w * up * (before_low - before_low[of])).sum()) - int((w * (1 - up) * (before_high - before_high[of])).sum())
        at = at[np.lexsort((up, group))]  # stable: points of one group stay in order of x
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    sums, squares = np.add.reduceat(weight, first), np.add.reduceat(weight * weight, first)
    if len(np.unique(rank)) == len(rank):
        ties = int(((sums * sums - squares) // 2).sum())
    else:  # points that agree in both were never counted
        same = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (rank[1:] != rank[:-1])))
        equal = np.add.reduceat(weight, same)
        ties = int((sums * sums).sum() - (equal * equal).sum()) // 2
    return total - ties  # pairs with one x came in order of y


def known(c: str) -> Column:
    """A column as double, without NaN."""
    return F.nanvl(col(c).cast("double"), F.lit(None))


def _coded(counts: DataFrame, value: str, code: str) -> DataFrame:
    """Chunk number of a value per pair of columns; a value that ends its chunk has an odd number of its own."""
    tagged = quantile_chunks(counts, F.col(value), ["pair"], SIDE)
    ends = tagged.groupBy("pair", "_chunk").agg(F.max(value).alias("_end"))  # SIDE ** 2 rows a pair
    own = (F.col(value) == F.col("_end")).cast("int")
    return tagged.join(F.broadcast(ends), ["pair", "_chunk"]).withColumn(code, 2 * F.col("_chunk") + own).drop("_chunk", "_end")


def kendall(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_a, column_b, n, correlation (tau-b) of all pairs of columns, over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    entries = F.array(*[F.struct(F.lit(k).alias("pair"), known(a).alias("x"), known(b).alias("y")) for k, (a, b) in enumerate(pairs)])
    counts = (
        df.select(F.inline(entries)).filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    )
    cells = checkpoint(_coded(_coded(checkpoint(counts), "x", "cx"), "y", "cy"))

    def in_chunks(code: str, other: str):
        def score(group: pd.DataFrame) -> pd.DataFrame:
            x, y, c = (group[name].to_numpy() for name in ("x", "y", "c"))
            total = order_score(x, y, c)
            if code == "cy":  # pairs that share both chunks were counted by the chunk of x
                for _, part in group.groupby(other):
                    total -= order_score(part["x"].to_numpy(), part["y"].to_numpy(), part["c"].to_numpy())
            return pd.DataFrame({"pair": [int(group["pair"].iloc[0])], "score": [str(total)]})

        open_chunks = cells.filter(F.col(code) % 2 == 0)
        return open_chunks.groupBy("pair", code).applyInPandas(score, "pair int, score string")

    inner = in_chunks("cx", "cy").unionByName(in_chunks("cy", "cx")).groupBy("pair").agg(F.sum(F.col("score").cast("decimal(38,0)")).alias("s")).collect()
    matrix = cells.groupBy("pair", "cx", "cy").agg(F.sum("c").alias("c")).toPandas()  # at most 4 * SIDE ** 4 cells a pair
    half = lambda c: F.sum((F.col(c) * (F.col(c) - 1)).cast("decimal(38,0)"))
    ties = {}
    for side in "xy":
        by_value = cells.groupBy("pair", side).agg(F.sum("c").cast("decimal(20,0)").alias("c")).groupBy("pair").agg(half("c").alias("t"), F.sum("c").alias("n"))
        for row in by_value.collect():
            ties.setdefault(row["pair"], {})[side] = int(row["t"]) // 2
            ties[row["pair"]]["n"] = int(row["n"])
    scores = {row["pair"]: int(row["s"]) for row in inner}
    rows = []
    for k, (a, b) in enumerate(pairs):
        if k not in ties:
            rows.append((a, b, 0, None))
            continue
        part = matrix[matrix["pair"] == k]
        total = scores.get(k, 0) + order_score(part["cx"].to_numpy(), part["cy"].to_numpy(), part["c"].to_numpy())
        n = ties[k]["n"]
        every = n * (n - 1) // 2
        below = math.sqrt((every - ties[k]["x"]) * (every - ties[k]["y"]))
        rows.append((a, b, n, round(total / below, 6) if below else None))
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, n long, correlation double")


# --- distances between distributions ----------------------------------------------------------

def _long(df: DataFrame, columns: list[str], a: int, b: int) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), known(c).alias("v")) for c in columns])
    return df.select(F.inline(entries)).filter("v IS NOT NULL").select("column_name", "v", F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))


def smirnov_distances(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_a, n_b, ks, at_value: the largest gap between both tables' cumulative shares, and the first value where it is.

    Both tables become counts per value, which are cut into quantile chunks; the running sums inside a chunk and the
    chunks' offsets give the cumulative shares, so no task orders a whole column.
    """
    counts = _long(a, columns, 1, 0).unionByName(_long(b, columns, 0, 1)).groupBy("column_name", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tagged = quantile_chunks(counts, F.col("v"), ["column_name"])
    by_chunk = tagged.groupBy("column_name", "_chunk").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    so_far = Window.partitionBy("column_name").orderBy("_chunk")
    every = Window.partitionBy("column_name")
    offsets = by_chunk.select(
        "column_name", "_chunk", (F.sum("ta").over(so_far) - F.col("ta")).alias("oa"), (F.sum("tb").over(so_far) - F.col("tb")).alias("ob"),
        F.sum("ta").over(every).alias("n_a"), F.sum("tb").over(every).alias("n_b"))
    within = Window.partitionBy("column_name", "_chunk").orderBy("v")
    gaps = (
        tagged.withColumns({"ra": F.sum("a").over(within), "rb": F.sum("b").over(within)})
        .join(F.broadcast(offsets), ["column_name", "_chunk"])  # one row per column and chunk
        .withColumn("gap", F.round(F.abs(F.try_divide(F.col("ra") + F.col("oa"), F.col("n_a")) - F.try_divide(F.col("rb") + F.col("ob"), F.col("n_b"))), 9))
    )
    best = F.max(F.struct(F.col("gap"), (-F.col("v")).alias("m")))
    return gaps.groupBy("column_name", "n_a", "n_b").agg(best.alias("best")).select(
        "column_name", "n_a", "n_b", F.round("best.gap", 6).alias("ks"), (-F.col("best.m")).alias("at_value"))


def stability_index(a: DataFrame, b: DataFrame, columns: list[str], bins: int = 10, least: float = 1e-4) -> DataFrame:
    """column_name, psi: population stability of ``b`` against ``a`` over the quantile bins of ``a``; a share counts as ``least`` at least."""
    probs = tuple((k + 1) / bins for k in range(bins - 1))
    edges = held(exact_percentiles(a, {f"e{j}": col(c) for j, c in enumerate(columns)}, probs))

    def shares(df: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[
            F.struct(F.lit(c).alias("column_name"), sum(((known(c) > F.col(f"e{j}__{k}")).cast("int") for k in range(bins - 1)), F.lit(0)).alias("bin"))
            for j, c in enumerate(columns)])
        some = df.select(*[col(c) for c in columns]).crossJoin(F.broadcast(edges)).select(F.inline(entries)).filter("bin IS NOT NULL")
        return some.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias(name))

    def share(name: str) -> Column:
        total = F.sum(F.coalesce(name, F.lit(0))).over(Window.partitionBy("column_name"))
        return F.greatest(F.lit(least), F.coalesce(name, F.lit(0)) / total)

    both = shares(a, "na").join(shares(b, "nb"), ["column_name", "bin"], "full_outer").select("column_name", share("na").alias("pa"), share("nb").alias("pb"))
    return both.groupBy("column_name").agg(F.round(F.sum((F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa"))), 6).alias("psi"))


def distribution_distances(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Both distances side by side, per column."""
    return smirnov_distances(a, b, columns).join(stability_index(a, b, columns), "column_name")
