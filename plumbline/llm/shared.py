"""Helpers of the training-data operators: tables between stages and vectorised word hashing.

Word hashing works on whole Arrow columns with numpy: words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``, and a word's 64-bit hash depends on its bytes alone, so it is the same in every task.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 50_000
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one only in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        folder = tempfile.mkdtemp(prefix="plumbline-llm-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    return f"{base.rstrip('/')}/plumbline-llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and is computed once, whatever executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it is not installed for them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores added where ``df`` has them already."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def text_tag(text):
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def kept_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``marks`` (doc_id, tag, kept; see ``text_tag``) keeps, with their columns.

    A row that ``marks`` does not name stays. Rows that agree in doc_id and text are one document: one of them stays.
    """
    i, t, own = free_names(docs, "id", "tag", "own")
    named = written(marks.select(F.col("doc_id").alias(i), F.col("tag").alias(t), "kept"))
    gone = named.where(~F.col("kept")).select(i, t).distinct()
    repeats = named.where("kept").groupBy(i, t).count().where("count > 1").select(i, t)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (text_tag(F.col("text")) == F.col(t))
    rest = docs.join(gone, same, "left_anti")
    if repeats.isEmpty():
        return rest
    once = rest.join(repeats, same, "left_semi").withColumn(own, text_tag(F.col("text")))
    return rest.join(repeats, same, "left_anti").unionByName(once.dropDuplicates(["doc_id", own]).drop(own))


def word_count(text):
    """Number of words as a SQL expression; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _byte_values(lower: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        table = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
    if lower:
        table[65:91] = table[97:123]
    return table


@functools.cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD1342543DE82EF95, dtype=np.uint64))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """Words of a run of texts: byte spans in ``data``, row of each word, first word of each row, hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def windows(self, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``width`` words inside one text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            value = np.full(n, np.uint64(seed) * _GOLDEN + np.uint64(width), dtype=np.uint64)
            for j in range(width):
                value = value * np.uint64(0xD6E8FEB86659FD93 + 2 * seed) + self.hash[j:j + n]
            value = mixed(value)
        inside = np.flatnonzero(self.row[:n] == self.row[width - 1:])
        return inside, value[inside]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a text column without nulls; ``lower`` folds A-Z only."""
    buffers = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_BLANK[data]
    opens, closes = solid.copy(), solid.copy()
    if len(data):
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        opens[inner] |= solid[inner]
        closes[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    if not len(start):
        return Words(data, start, end, row, first, np.empty(0, np.uint64))
    length = end - start
    at = (np.cumsum(length) - length).astype(np.int64)
    with np.errstate(over="ignore"):
        value = _byte_values(lower)[data[solid]]
        longest = int(length.max())
        short = np.int32 if len(value) < 1 << 31 else np.int64
        value *= _powers(1 << max(6, longest.bit_length()))[np.arange(len(value), dtype=short) - np.repeat(at.astype(short), length)]
        value = mixed(np.add.reduceat(value, at) + length.astype(np.uint64))
    return Words(data, start, end, row, first, value)


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes each, so that numpy's temporaries stay small."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        stop = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + limit, side="right"))
        stop = min(max(stop, begin + 1), begin + CHUNK_ROWS, len(sizes))
        yield batch.slice(begin, stop - begin)
        begin = stop


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """Table of ``2 ** bits`` bits, whatever the input, with those set that the column ``bit`` of ``keys`` names."""
    at = F.col("bit") + 1  # Spark's bitmap functions count from 1
    parts = keys.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(
        F.bitmap_construct_agg("p").alias("b"))
    table = np.zeros(max(4096, (1 << bits) // 8), dtype=np.uint8)
    for row in parts.collect():  # ``2 ** bits`` bits in all
        table[(row["k"] - 1) * 4096:row["k"] * 4096] = np.frombuffer(row["b"], dtype=np.uint8)
    return table


def bits_on(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return ((table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
