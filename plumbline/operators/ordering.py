"""Ordered computations that never sort a whole table, or a hot group, in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import checkpoint

SUB_BUCKETS = 512


def exact_percentiles(
    df: DataFrame, values: dict[str, Column], probs: tuple[float, ...], accuracy: int = 2_000
) -> DataFrame:
    """Exact interpolated percentiles of several columns as one row.

    ``percentile`` keeps every distinct value of a column in one task. Here a mergeable sketch
    brackets each wanted rank, a counting pass places the rank inside or outside the bracket,
    and only the values of the bracket (about ``4 / accuracy`` of the rows) are shuffled. A bad
    bracket costs time, never exactness: the region is then opened to that side.

    Result columns: ``<name>__<i>`` for the i-th probability.
    """
    names = list(values)
    k = len(probs)
    targets = [(n, i) for n in names for i in range(k)]
    pad = 2.0 / accuracy
    marks = [max(0.0, p - pad) for p in probs] + [min(1.0, p + pad) for p in probs]
    base = df.select(*[F.nanvl(v.cast("double"), F.lit(None)).alias(n) for n, v in values.items()])

    sketch = base.agg(
        *[F.percentile_approx(n, marks, accuracy).alias(f"{n}__s") for n in names],
    ).select(
        *[F.col(f"{n}__s")[i].alias(f"{n}__lo{i}") for n, i in targets],
        *[F.col(f"{n}__s")[k + i].alias(f"{n}__hi{i}") for n, i in targets],
    )
    sketch = held(sketch)  # first scan
    counted = base.crossJoin(F.broadcast(sketch)).agg(
        *[F.count_if(F.col(n) < F.col(f"{n}__lo{i}")).alias(f"{n}__b{i}") for n, i in targets],
        *[F.count_if(F.col(n) <= F.col(f"{n}__hi{i}")).alias(f"{n}__u{i}") for n, i in targets],
        *[F.count(n).alias(f"{n}__n") for n in names],
    )

    def target(n, i):
        position = F.lit(float(probs[i])) * (F.col(f"{n}__n") - 1)
        first, last = F.floor(position), F.ceil(position)
        low_open, high_open = first < F.col(f"{n}__b{i}"), last >= F.col(f"{n}__u{i}")
        single = (F.col(f"{n}__lo{i}") == F.col(f"{n}__hi{i}")) & (first >= F.col(f"{n}__b{i}")) & (last < F.col(f"{n}__u{i}"))
        return F.struct(
            F.lit(n).alias("name"), F.lit(i).alias("ix"), first.alias("first"), last.alias("last"),
            (position - first).alias("frac"),
            F.col(f"{n}__lo{i}").alias("lo"), F.col(f"{n}__hi{i}").alias("hi"),
            F.when(low_open, float("-inf")).when(single, float("inf")).otherwise(F.col(f"{n}__lo{i}")).alias("from"),
            F.when(high_open, float("inf")).when(single, float("-inf")).otherwise(F.col(f"{n}__hi{i}")).alias("to"),
            F.when(single, F.col(f"{n}__u{i}") - F.col(f"{n}__b{i}")).alias("weight"),
            F.when(low_open, F.lit(0)).otherwise(F.col(f"{n}__b{i}")).alias("before"),
        )

    # The state is one array column: with a column per field the optimizer's constraint sets grow beyond use.
    state = counted.crossJoin(F.broadcast(sketch)).select(F.array(*[target(n, i) for n, i in targets]).alias("t"))
    state = held(state)  # second scan
    place = {target: j for j, target in enumerate(targets)}

    def at_target(n, i, field):
        return F.col("t")[place[n, i]][field]

    def inside(n, i):
        return (F.col(n) >= at_target(n, i, "from")) & (F.col(n) <= at_target(n, i, "to"))

    key = ["name", "ix", "first", "last", "frac", "before"]

    def entry(n, i):
        lo, hi, v = at_target(n, i, "lo"), at_target(n, i, "hi"), F.col(n)
        spread = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * SUB_BUCKETS)
        sub = F.when(v < lo, -1).when(v > hi, SUB_BUCKETS + 1).otherwise(F.coalesce(spread, F.lit(0)))
        return F.when(inside(n, i), F.struct(
            sub.cast("int").alias("sub"), v.alias("v"),
            *[at_target(n, i, f).alias(f) for f in key],
        ))

    grouped = (
        base.crossJoin(F.broadcast(state))
        # a sum, not a disjunction: the optimizer would try to normalise a long OR of ANDs
        .filter(reduce(lambda a, b: a + b, [F.when(inside(n, i), 1).otherwise(0) for n, i in targets]) > 0)
        .select(F.inline(F.array_compact(F.array(*[entry(n, i) for n, i in targets]))))
        .groupBy(*key, "sub", "v")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # a bracket that is one value needs no rows: its counts are known already
    known = state.select(F.inline("t")).filter("weight IS NOT NULL").select(
        *key, F.lit(0).alias("sub"), F.col("lo").alias("v"), F.col("weight").alias("cnt"))
    grouped = grouped.unionByName(known)
    by_target = Window.partitionBy("name", "ix").orderBy("sub")
    wanted = (
        grouped.groupBy(*key, "sub")
        .agg(F.sum("cnt").alias("total"))
        .withColumn("start", F.col("before") + F.sum("total").over(by_target) - F.col("total"))
        .filter((F.col("last") >= F.col("start")) & (F.col("first") < F.col("start") + F.col("total")))
        .select("name", "ix", "sub", "start")
    )
    in_sub = Window.partitionBy("name", "ix", "sub").orderBy("v")
    placed = (
        grouped.join(F.broadcast(wanted), ["name", "ix", "sub"])
        .withColumn("end", F.col("start") + F.sum("cnt").over(in_sub))
        .withColumn("begin", F.col("end") - F.col("cnt"))
    )

    def at(rank):
        return F.max(F.when((F.col(rank) >= F.col("begin")) & (F.col(rank) < F.col("end")), F.col("v")))

    result = placed.groupBy("name", "ix").agg(
        at("first").alias("a"), at("last").alias("b"), F.first("frac").alias("frac")
    ).withColumn("value", F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    return result.agg(*[
        F.max(F.when((F.col("name") == n) & (F.col("ix") == i), F.col("value"))).alias(f"{n}__{i}")
        for n, i in targets
    ])


def held(one_row: DataFrame) -> DataFrame:
    """A result of one row, computed now: what is built on it does not scan the input again."""
    return one_row.sparkSession.createDataFrame(one_row.limit(2).collect(), one_row.schema)


def quantile_chunks(df: DataFrame, value: Column, part: list[str] | None = None, side: int = 32) -> DataFrame:
    """Add ``_chunk``: the number of the value's quantile range, ``side ** 2`` ranges per ``part``.

    Cuts come from one mergeable sketch. They are searched in two steps (a coarse list, then one
    fine list), so a row costs ``2 * side`` comparisons. ``part`` must have few values.
    """
    part = part or []
    n = side * side
    sketch = df.groupBy(*part).agg(F.percentile_approx(value, [(i + 1) / n for i in range(n - 1)], 10_000).alias("_cuts"))
    splits = sketch.select(
        *part,
        F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.element_at("_cuts", i * side)).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice("_cuts", i * side + 1, F.lit(side - 1))).alias("_fine"),
    )
    joined = (df.join(F.broadcast(splits), part) if part else df.crossJoin(F.broadcast(splits))).withColumn("_at", value)
    placed = joined.withColumn("_c", F.coalesce(F.size(F.filter("_coarse", lambda c: c < F.col("_at"))), F.lit(0)))
    fine = F.size(F.filter(F.element_at("_fine", F.greatest(F.col("_c"), F.lit(0)) + 1), lambda c: c < F.col("_at")))
    return placed.withColumn("_chunk", F.greatest(F.col("_c"), F.lit(0)) * side + F.greatest(F.coalesce(fine, F.lit(0)), F.lit(0))).drop(
        "_coarse", "_fine", "_at", "_c")


def ordered_ranks(grouped: DataFrame, part: list[str], value: str, weight: str, side: int = 32) -> DataFrame:
    """Add ``before``: the weight of all smaller values of the same ``part``.

    Values are cut into quantile chunks, so that a window never holds more than one chunk; chunk
    offsets come from a small table.
    """
    tagged = quantile_chunks(grouped, F.col(value), part, side)
    offsets = (
        tagged.groupBy(*part, "_chunk")
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_offset", F.sum("_w").over(Window.partitionBy(*part).orderBy("_chunk")) - F.col("_w"))
        .drop("_w")
    )
    within = Window.partitionBy(*part, "_chunk").orderBy(value)
    return (
        tagged.withColumn("_within", F.sum(weight).over(within) - F.col(weight))
        .join(F.broadcast(offsets), [*part, "_chunk"])
        .withColumn("before", F.col("_within") + F.col("_offset"))
        .drop("_within", "_offset", "_chunk")
    )


def global_row_number(df: DataFrame, order_by: list[Column], name: str = "row_no") -> DataFrame:
    """Zero-based position in a total order.

    The last ordering column must be unique, so that a range partition can split a hot key.
    The range partitions are checkpointed once: their numbers must not change between the
    counting and the numbering pass.
    """
    ranged = df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n"))
        .select("_part", "_offset")
    )
    within = Window.partitionBy("_part").orderBy(*order_by)
    return (
        ranged.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
        .drop("_part", "_rn", "_offset")
    )


def overlapping_blocks(df: DataFrame, row_no: str, block: int, overlap: int) -> DataFrame:
    """Cut a numbered table into blocks; the last ``overlap`` rows of a block also lead the next.

    ``_native`` marks the copy that belongs to the block.
    """
    home = F.floor(F.col(row_no) / block)
    copies = F.array(
        F.struct(home.alias("_block"), F.lit(True).alias("_native")),
        F.struct((home + 1).alias("_block"), F.lit(False).alias("_native")),
    )
    kept = F.filter(copies, lambda x: x._native | (F.col(row_no) % block >= block - overlap))
    return df.select("*", F.inline(kept))
