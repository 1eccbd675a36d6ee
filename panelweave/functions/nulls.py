"""Missing-value rules: NaN and infinities are missing, divisions never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clean_numeric(df: DataFrame) -> DataFrame:
    """All float columns with NaN and infinities turned to null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[finite(F.col(f"`{n}`")).alias(n) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(f"`{n}`") for n, t in kinds.items()])


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or missing."""
    return F.try_divide(a, F.when(b != 0, b))


def positive(c: Column) -> Column:
    """The value where it is above zero, else null."""
    return F.when(c > 0, c)
