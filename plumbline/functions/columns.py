"""Column kinds, null tests, lenient parsing and hashing, all as built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import fixed_values as fv

DATE_FORMATS = ("dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    dtype: T.DataType

    @property
    def kind(self) -> str:
        d = self.dtype
        if isinstance(d, (T.StringType, T.VarcharType, T.CharType)):
            return "text"
        if isinstance(d, T.BooleanType):
            return "boolean"
        if isinstance(d, T.IntegralType):
            return "integer"
        if isinstance(d, (T.FractionalType, T.DecimalType)):
            return "float"
        if isinstance(d, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        return "nested"

    @property
    def lower(self) -> str:
        return self.name.lower()

    @property
    def is_numeric(self) -> bool:
        return self.kind in ("integer", "float")

    @property
    def is_id_like(self) -> bool:
        return self.lower.endswith(("id", "key", "code"))


def infos(df: DataFrame, columns: list[str] | None = None) -> list[ColumnInfo]:
    wanted = set(columns) if columns is not None else None
    return [ColumnInfo(f.name, f.dataType) for f in df.schema.fields if wanted is None or f.name in wanted]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def missing(info: ColumnInfo) -> Column:
    """Null, or NaN in a floating column."""
    c = col(info.name)
    if isinstance(info.dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(info: ColumnInfo) -> Column:
    return ~missing(info)


def as_double(c: Column) -> Column:
    return c.try_cast("double")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, fv.OUTER_SPACE, "")


def as_text(info: ColumnInfo) -> Column:
    """The value as text; minus zero and zero become one value."""
    c = col(info.name)
    if info.kind == "nested":
        return F.to_json(c)
    if isinstance(info.dtype, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")
    return c.cast("string")


def parse_date(c: Column) -> Column:
    """First format that fits: ISO, then day/month, month/day, year/month/day; else null."""
    iso = F.when(c.rlike(fv.ISO_DATE_START), c.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def as_timestamp(info: ColumnInfo) -> Column:
    c = col(info.name)
    return parse_date(c) if info.kind == "text" else c.cast("timestamp")


def row_fingerprint(columns: list[ColumnInfo]) -> list[Column]:
    """128 bits per row in two 64-bit hashes.

    Spark's hash skips nulls, so the null positions are hashed as well.
    """
    values = [as_text(i) if i.kind == "nested" else col(i.name) for i in columns]
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return [
        F.xxhash64(nulls, *values).alias("_h1"),
        F.xxhash64(F.lit("plumb"), *reversed(values), nulls).alias("_h2"),
    ]


def g1_skew(n: Column, population_skew: Column) -> Column:
    """Sample-adjusted skewness from the population value."""
    return F.when(n >= 3, population_skew * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def sample_kurtosis(n: Column, population_kurtosis: Column) -> Column:
    return F.when(
        n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * population_kurtosis + 6.0)
    )


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def any_word(name: str, words) -> bool:
    lowered = name.lower()
    return any(w in lowered for w in words)
