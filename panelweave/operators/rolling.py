"""Totals and averages over trailing periods, also for periods without activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_totals(rows: DataFrame, key: str, index: str, value: str, windows: list[int], block: int = 512) -> DataFrame:
    """(key, index, total_<w>, average_<w>) for every index from the key's first to its last row, without holes.

    rows holds one row per (key, index); index numbers the periods (days, months, quarters). Method: prefix sums per key,
    carried forward over the periods without a row; a trailing total is the difference of two prefix values.

    A key's history is cut into blocks of `block` periods, each with the last max(windows) periods before it as margin, so
    prefixes start anew in each block: no task holds more than one block of a key and rounding does not build up along a
    long history.

    Defined cases: null and NaN values count 0 but their period exists; rows with a null key or index are ignored; what
    lies before the first row counts 0; an empty table gives an empty table.
    """
    reach = max(windows)
    v = F.coalesce(F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    base = rows.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{index}`").cast("long").alias("_i"), v.alias("_v")).where("_k is not null and _i is not null")
    blk = lambda c: F.floor(c / F.lit(block))
    spans = base.groupBy("_k").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
    marks = spans.select("_k", "_lo", "_hi", F.explode(F.sequence(blk(F.col("_lo")), blk(F.col("_hi")))).alias("_b")).select(
        "_k", "_b", F.greatest("_lo", F.col("_b") * block - reach).alias("_i"), F.lit(0.0).alias("_v"), F.least(F.col("_hi"), F.col("_b") * block + block - 1).alias("_end")
    )
    placed = base.select("_k", F.explode(F.sequence(blk(F.col("_i")), blk(F.col("_i") + reach))).alias("_b"), "_i", "_v", F.lit(None).cast("long").alias("_end"))
    part = W.partitionBy("_k", "_b")
    w = part.orderBy("_i")
    walked = placed.unionByName(marks).select(
        "_k", "_b", "_i", F.sum("_v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_p"), F.lead("_i").over(w).alias("_next"), F.max("_end").over(part).alias("_end")
    )
    run = F.coalesce("_next", F.col("_end") + 1) - F.col("_i")
    dense = walked.where(F.col("_end").isNotNull() & (run > 0)).select("_k", "_b", "_p", F.explode(F.sequence(F.col("_i"), F.col("_i") + run - 1)).alias("_i"))
    w = part.orderBy("_i")
    out = dense.select("_k", "_b", "_i", *[(F.col("_p") - F.coalesce(F.lag("_p", n).over(w), F.lit(0.0))).alias(f"total_{n}") for n in windows])
    out = out.where(F.col("_i") >= F.col("_b") * block)
    cols = []
    for n in windows:
        cols += [F.col(f"total_{n}"), (F.col(f"total_{n}") / F.lit(float(n))).alias(f"average_{n}")]
    return out.select(F.col("_k").alias(key), F.col("_i").alias(index), *cols)
