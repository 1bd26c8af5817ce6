"""Connected components of a link table, by alternating large and small stars.

Every round joins each node's links to the smallest node among them: first towards larger neighbours, then towards
smaller ones, until all that remains are stars around the smallest node of each component. The number of rounds grows
with the logarithm of the longest path. Links stay distributed; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v) that is not its component's smallest node, which is ``root``."""
    stars = shared.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(lowest, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(smallest, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = shared.written(small.unionByName(smallest.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
        before, state = state, _state(stars)
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
