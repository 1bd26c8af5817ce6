"""Sinks: files and mirrored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.readers import read_xml


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet, CSV with header, or JSON lines. Tasks write in parallel; nothing is coalesced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("parquet", "json", "orc"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def xml_to_parquet(spark: SparkSession, source: str, row_tag: str, target: str) -> None:
    write(read_xml(spark, source, row_tag), target)


def mirror(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> bool:
    """Copy a table to the lakehouse; the schema may change on overwrite, an empty input is skipped.

    ``fmt='delta'`` works where the Delta jar is on the classpath.
    """
    if df.isEmpty():
        return False
    writer = df.write.mode(mode).format(fmt)
    if fmt == "delta" and mode == "overwrite":
        writer = writer.option("overwriteSchema", "true")
    if fmt == "delta" and mode == "append":
        writer = writer.option("mergeSchema", "true")
    writer.save(path)
    return True


def mirror_table(df: DataFrame, name: str, mode: str = "overwrite") -> bool:
    """The same into a catalog table."""
    if df.isEmpty():
        return False
    df.write.mode(mode).saveAsTable(name)
    return True
