"""Readers: lazy DataFrames from files and databases."""

from __future__ import annotations

import os
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import as_text, infos
from plumbline.sources.html_tables import html_table_rows

CORRUPT_LINE = "_corrupt_line"
LITERAL = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", re.S)
HASH_BITS = 53  # of a row's hash that are compared with a sampling rate


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None, quoted_newlines: bool | None = None) -> DataFrame:
    """CSV or TSV with a header; quotes are doubled inside quotes.

    Files are split over tasks by line. Where a value holds a line end inside quotes, a file is one task instead; unless
    ``quoted_newlines`` says which it is, a scan of the lines looks for one with an odd number of quotes. Give a
    schema for large inputs: inference reads them once more.
    """
    if quoted_newlines is None:
        quotes = F.length("value") - F.length(F.translate("value", '"', ""))
        quoted_newlines = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", quoted_newlines).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Raw header names, duplicates included (Spark renames those when it reads)."""
    first = spark.read.option("header", False).option("sep", sep).option("escape", '"').csv(path).limit(1).collect()
    return [name or "" for name in first[0]] if first else []


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; a line that does not parse keeps its text in ``value``, or in ``CORRUPT_LINE`` if the data has a ``value``."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_LINE)
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(CORRUPT_LINE, T.StringType())]))
    rows = reader.json(path)
    return rows if "value" in rows.columns else rows.withColumnRenamed(CORRUPT_LINE, "value")


def read_json_document(spark: SparkSession, path: str, list_path: list[str] | None = None) -> DataFrame:
    """JSON documents: rows are the list of objects at ``list_path``, or else the one that is least deep."""
    return explode_document(spark.read.option("multiLine", True).json(path), list_path)


def find_list_path(schema: T.StructType) -> list[str] | None:
    """Breadth-first path to the first array of structs, at any depth."""
    level = [([], schema)]
    while level:
        following = []
        for path, struct in level:
            for f in struct.fields:
                if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                    return [*path, f.name]
                if isinstance(f.dataType, T.StructType):
                    following.append(([*path, f.name], f.dataType))
        level = following
    return None


def explode_document(df: DataFrame, list_path: list[str] | None = None) -> DataFrame:
    """Explode a list of objects (see ``find_list_path``); scalar ancestors become columns, structs open one level."""
    path = list_path or find_list_path(df.schema)
    if path is None:
        return open_structs(df)
    carried: list[Column] = []
    struct, prefix = df.schema, []
    for step in path:
        for f in struct.fields:
            if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                name = "_".join([*prefix, f.name])
                carried.append(F.col(".".join(f"`{p}`" for p in [*prefix, f.name])).alias(name))
        prefix.append(step)
        field = struct[step].dataType
        struct = field if isinstance(field, T.StructType) else field.elementType
    item = F.explode_outer(F.col(".".join(f"`{p}`" for p in path))).alias("_item")
    rows = df.select(*carried, item)
    taken = {c for c in rows.columns}
    fields = [F.col(f"_item.`{f.name}`").alias(f"item_{f.name}" if f.name in taken else f.name) for f in struct.fields]
    return open_structs(rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_item"], *fields))


def open_structs(df: DataFrame) -> DataFrame:
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            parts += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        else:
            parts.append(F.col(f"`{f.name}`"))
    return df.select(*parts)


def read_xml(spark: SparkSession, path: str, row_tag: str, explode: str | None = None) -> DataFrame:
    """XML with one row per ``row_tag``; a repeated child becomes rows with ``child_field`` columns."""
    df = spark.read.format("xml").option("rowTag", row_tag).load(path)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    target = explode or (arrays[0] if arrays else None)
    if target:
        df = df.withColumn(target, F.explode_outer(F.col(f"`{target}`")))
    return open_structs(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- samples --------------------------------------------------------------------------------------

def sample_share(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def sample_rows(df: DataFrame, max_rows: int, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """About ``max_rows`` rows, the same ones every time: a hash of the row against the rate.

    ``reservoir`` gives an exact number.
    """
    chosen = infos(df, keys) if keys else infos(df)
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[as_text(i) for i in chosen]), 64 - HASH_BITS) / F.lit(float(1 << HASH_BITS))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return df.crossJoin(F.broadcast(total)).filter(slot * F.col("_total") < F.lit(max_rows)).drop("_total")


def reservoir(df: DataFrame, k: int, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly k rows (or all), uniformly by a seeded hash; each task keeps only its own best k."""
    chosen = infos(df, keys) if keys else infos(df)
    h = F.xxhash64(F.lit(seed), *[as_text(i) for i in chosen])
    return df.withColumn("_h", h).orderBy("_h", *[F.col(f"`{i.name}`") for i in chosen if i.kind != "nested"]).limit(k).drop("_h")


# --- databases ------------------------------------------------------------------------------------

def guard_select(statement: str) -> str:
    """One SELECT or WITH statement, nothing else; what stands in literals, quoted names and comments does not count."""
    text = statement.strip().rstrip(";").strip()
    bare = LITERAL.sub(" ", text).strip()
    if ";" in bare or not re.match(r"(?is)^(select|with)\b", bare):
        raise ValueError("only a single SELECT statement is allowed")
    if re.search(r"(?is)\b(insert|update|delete|merge|drop|alter|create|truncate|exec|grant)\b", bare):
        raise ValueError("the statement changes data")
    return text


def jdbc_options(url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None,
                 bounds: tuple | None = None, partitions: int = 16, top: int | None = None, **extra) -> dict:
    """Options of a JDBC scan. A partition column with bounds splits it over executors."""
    options = {"url": url, "pushDownAggregate": "true", "pushDownLimit": "true", **extra}
    if query is not None:
        options["query" if partition_column is None else "dbtable"] = (
            guard_select(query) if partition_column is None else f"({guard_select(query)}) q")
    elif table is not None:
        options["dbtable"] = table
    else:
        raise ValueError("give a table or a query")
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        options.update(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return options


def read_jdbc(spark: SparkSession, url: str, top: int | None = None, **kwargs) -> DataFrame:
    df = spark.read.format("jdbc").options(**jdbc_options(url, **kwargs)).load()
    return df if top is None else df.limit(top)


def jdbc_schema(spark: SparkSession, url: str, table: str, **extra) -> DataFrame:
    """Columns and types of a database table; reads no rows."""
    df = read_jdbc(spark, url, table=table, **extra)
    return spark.createDataFrame([(table, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields],
                                 "table_name string, column_name string, dtype string, nullable boolean")


# --- many sources ---------------------------------------------------------------------------------

READERS = {
    "csv": lambda s, p: read_csv(s, p), "tsv": lambda s, p: read_csv(s, p, "\t"), "json": read_json_document,
    "jsonl": read_jsonl, "parquet": read_parquet,
}


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the files below a path, as Spark lists them; nothing is read."""
    return [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path").collect()]


def unreadable_files(read, files: list[str]) -> list[tuple[str, str]]:
    """(file, error) of the files that ``read`` cannot read to their end, tried all together first.

    An error that names its file costs one more try without it; otherwise the files are halved until it is found.
    """
    def problem(some: list[str]) -> Exception | None:
        try:
            read(some).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - any failure of a file is a finding
            return e
        return None

    found, todo = [], [list(files)]
    while todo:
        some = todo.pop()
        error = problem(some) if some else None
        if error is None:
            continue
        named = [f for f in some if f in str(error) or quote(f, safe=":/") in str(error)]
        if len(some) == 1 or len(named) == 1:
            bad = named[0] if named else some[0]
            found.append((bad, first_line(error)))
            todo.append([f for f in some if f != bad])
        else:
            half = len(some) // 2
            todo += [some[:half], some[half:]]
    return sorted(found)


def first_line(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0][:300]}"


class Catalog:
    """Named lazy tables from many sources. A source that fails is recorded, the others load."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.failures: list[tuple[str, str]] = []

    def add(self, name: str, df: DataFrame, source: str = "source") -> str:
        """Names that collide get the source as prefix, then a number."""
        unique, n = name, 2
        if unique in self.tables:
            unique = f"{source}_{name}"
        while unique in self.tables:
            unique, n = f"{source}_{name}_{n}", n + 1
        self.tables[unique] = df
        return unique

    def load(self, specs: list[dict], verify: bool = False) -> "Catalog":
        """``{"path": …, "format": …, "name": …, "source": …}``; format and name default from the path.

        A source that cannot be opened is recorded and left out. Data that break only while they are read (a torn Parquet
        file, a cut-off gzip file) are found with ``verify``, which reads each source once: the files that fail are recorded
        one by one, and the table holds the rest. A source of which every file fails is left out.
        """
        for spec in specs:
            path = spec["path"]
            base = os.path.basename(path.rstrip("/"))
            kind = spec.get("format") or base.rsplit(".", 1)[-1].lower()
            name = spec.get("name") or base.rsplit(".", 1)[0]
            try:
                if kind == "xml":
                    df = read_xml(self.spark, path, spec["row_tag"], spec.get("explode"))
                elif kind == "jdbc":
                    df = read_jdbc(self.spark, path, **spec.get("options", {}))
                elif verify:
                    df = self._verified(name, path, kind)
                else:
                    df = READERS[kind](self.spark, path)
                if df is not None:
                    self.add(name, df, spec.get("source", "source"))
            except Exception as e:  # noqa: BLE001 - one bad source must not stop the load
                self.failures.append((name, first_line(e)))
        return self

    def _verified(self, name: str, path: str, kind: str) -> DataFrame | None:
        """The table of the files that can be read to their end; the others are recorded."""
        base = path.rstrip("/")

        def read(files: list[str]) -> DataFrame:
            if kind != "parquet":
                return READERS[kind](self.spark, files)
            whole_folder = not files[0].endswith(base)  # keeps the columns that folder names give
            return (self.spark.read.option("basePath", base) if whole_folder else self.spark.read).parquet(*files)

        files = files_of(self.spark, path)
        bad = unreadable_files(read, files)
        for file, error in bad:
            self.failures.append((name, f"{os.path.basename(file)}: {error}"))
        gone = {file for file, _ in bad}
        good = [f for f in files if f not in gone]
        return read(good) if good else None

    def errors(self) -> DataFrame:
        return self.spark.createDataFrame(self.failures, "name string, error string")

    def subset(self, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.tables[n] for n in names}
