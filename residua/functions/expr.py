"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def name(col: str) -> str:
    """Quote a column name so dots and blanks in it are taken literally."""
    return "`" + col.replace("`", "``") + "`"


def col(column: str) -> Column:
    return F.col(name(column))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f) and f.name not in skip]


def as_double(c: Column) -> Column:
    """Cast to double with NaN turned into null (aggregates then skip both)."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column) -> Column:
    """Double with NaN and infinities turned into null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """``a / b``, or ``default`` where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present; null when either is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def normalise(c: Column, lo: float, hi: float) -> Column:
    """Min-max scaling to [0, 1]; a constant column becomes 0."""
    if hi - lo == 0:
        return F.lit(0.0)
    return (c - F.lit(lo)) / F.lit(hi - lo)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def messages(*pairs: tuple[Column, Column]) -> Column:
    """Array of the texts whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def first_match(*pairs: tuple[Column, str], default: str | None = None) -> Column:
    """Label of the first condition that holds."""
    chain = F.lit(default).cast("string")
    for cond, label in reversed(pairs):
        chain = F.when(cond, F.lit(label)).otherwise(chain)
    return chain
