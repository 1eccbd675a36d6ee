"""Key assertions and ordered deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """df itself; raises ValueError naming a key that occurs more than once."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: key {keys} is not unique, e.g. {twice[0].asDict()}")
    return df


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest in `order` (nulls lowest), ties broken by the other columns, so the result is determined.

    Planned as a max over structs: it combines on the map side, so a key with very many copies does not meet one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    plain = [c for c in rest if not dict(df.dtypes)[c].startswith("map")]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *plain)).alias("_x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in df.columns if c in keys or c in order or c in plain])


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def drop_ambiguous(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose key leads to one value only."""
    many = df.groupBy(*keys).agg((F.min(value) != F.max(value)).alias("_many")).where("_many").select(*keys)
    return df.join(many, keys, "left_anti")


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Many-to-one join; raises ValueError if right has a key twice."""
    return left.join(assert_unique(right, keys, "right side"), keys, how)


def null_safe(left: str, right: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
