"""Value census: one shuffle that serves every check on distinct values of many columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import as_text, col, infos


# cells whose distinct values one task counts before the shuffle: the memory of a task follows it, not the size of the table
CELLS_PER_TASK = 1_000_000


def spread(df: DataFrame, columns: int) -> DataFrame:
    """The rows dealt evenly to tasks of ``CELLS_PER_TASK`` cells; a table of one such task stays as it is."""
    tasks = -(-df.count() * columns // CELLS_PER_TASK)
    return df.repartition(tasks) if tasks > 1 else df


def value_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, n)`` for every distinct value of every column.

    Rows are dealt evenly and combined before the shuffle, so a hot value travels once per map task. Numbers are
    grouped as numbers and become text afterwards, decimals keep all their digits, and text is grouped
    whole at every length. Missing values have a null ``value``.
    """
    chosen = infos(df, columns)
    df = spread(df.select(*[col(i.name) for i in chosen]), len(chosen))

    def entry(k, info):
        whole = col(info.name).cast("long") if info.kind == "integer" else F.lit(None).cast("long")
        exact = isinstance(info.dtype, T.DecimalType)
        # adding zero makes minus zero and zero one value
        real = col(info.name).cast("double") + F.lit(0.0) if info.kind == "float" and not exact else F.lit(None).cast("double")
        text = F.lit(None).cast("string")
        if info.kind not in ("integer", "float"):
            text = as_text(info)
        elif exact:
            text = col(info.name).cast("string")
        return F.struct(F.lit(k).alias("c"), whole.alias("l"), F.nanvl(real, F.lit(None)).alias("d"), text.alias("s"))

    entries = F.array(*[entry(k, i) for k, i in enumerate(chosen)])
    grouped = df.select(F.inline(entries)).groupBy("c", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(i.name) for i in chosen])
    value = F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("s"))
    return grouped.select(names[F.col("c")].alias("column_name"), value.alias("value"), "n")


def census_summary(census: DataFrame) -> DataFrame:
    """Distinct counts, duplicates, the most frequent value and entropy per column."""
    known = F.col("value").isNotNull()
    # entropy = log2(N) - sum(n*log2(n))/N needs no second pass over the counts
    return census.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_values"),
        F.count_if(known).alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_value_count"),
        F.max(F.when(known, F.col("n"))).alias("top_count"),
        F.max_by(
            "value", F.when(known, F.struct(F.col("n"), F.col("value")))
        ).alias("top_value"),
        F.sum(F.when(known, F.col("n") * F.log2("n"))).alias("_nlogn"),
    ).withColumn(
        "entropy", F.when(F.col("n_values") > 0, F.log2("n_values") - F.col("_nlogn") / F.col("n_values"))
    ).drop("_nlogn")


def top_values(census: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values per column; ties by value."""
    from pyspark.sql import Window

    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return (
        census.filter("value IS NOT NULL")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("column_name", "value", "n", "rank")
    )
