"""Joins along time: as-of, interval and calendar joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.session import broadcast_if_small


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, order: list[str], span: str | None = None) -> DataFrame:
    """Every left row with the latest right row of the same `by` at or before its time; right columns are null where there is none.

    Both sides are stacked and the last right row, taken whole, is carried forward: linear in the rows, where a range join
    would pair each left row with all before it. Right rows at one time are ordered by `order`; clashing right names
    get the suffix _right. With `span` (a trunc unit, e.g. 'year') keys are cut into spans, each starting with the last right row
    of the spans before, so that one key, or none, does not bring its whole history to one task.
    """
    rcols = {c: (f"{c}_right" if c in left.columns else c) for c in right.columns if c not in by}
    r = right.where(" and ".join(f"`{c}` is not null" for c in [*by, right_time]))
    payload = F.struct(*[F.col(c).alias(n) for c, n in rcols.items()])
    rank = [F.col(c) for c in order]
    lt, rt = left.select(*by, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l")), r.select(*by, F.col(right_time).alias("_t"), payload.alias("_r"), F.struct(*rank, F.lit(0)).alias("_o"))
    kinds = {f.name: f.dataType for f in rt.schema.fields}
    lt = lt.select(*by, "_t", F.lit(1).alias("_side"), "_l", F.lit(None).cast(kinds["_r"]).alias("_r"), F.lit(None).cast(kinds["_o"]).alias("_o"))
    rt = rt.select(*by, "_t", F.lit(0).alias("_side"), F.lit(None).cast(dict((f.name, f.dataType) for f in lt.schema.fields)["_l"]).alias("_l"), "_r", "_o")
    keys = list(by)
    both = lt.unionByName(rt)
    if span:
        both = both.withColumn("_span", F.trunc(F.col("_t").cast("date"), span))
        last = both.where("_side = 0").groupBy(*by, "_span").agg(F.max_by("_r", F.struct("_t", "_o")).alias("_r"))
        spans = both.select(*by, "_span").distinct().join(last, [*by, "_span"], "left")
        w = W.partitionBy(*by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
        carried = spans.select(*by, "_span", F.last("_r", ignorenulls=True).over(w).alias("_r")).where("_r is not null")
        none = {f.name: f.dataType for f in both.schema.fields}
        carried = carried.select(*by, F.lit(None).cast(none["_t"]).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(none["_l"]).alias("_l"), "_r", F.lit(None).cast(none["_o"]).alias("_o"), "_span")
        both = both.unionByName(carried)
        keys.append("_span")
    w = W.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side", "_o").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    hit = F.when(F.col("_t").isNotNull(), F.col("_hit"))
    return out.select("_l.*", *[hit.getField(n).alias(n) for n in rcols.values()])


def in_interval(df: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """df with every span of its key that contains its time, both ends included; null ends are open."""
    d = df.join(spans, key)
    return d.where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end))))


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by `order`."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def calendar(dates: DataFrame, column: str) -> DataFrame:
    """(column, position): distinct dates numbered from 0 without gaps; one row per calendar day at most."""
    d = dates.select(column).where(F.col(column).isNotNull()).distinct()
    return d.select(column, (F.row_number().over(W.orderBy(column)) - 1).cast("long").alias("position"))


def next_in_calendar(events: DataFrame, cal: DataFrame, time: str, column: str, strict: bool = False) -> DataFrame:
    """events with the position of the first calendar day at or after (strict: after) their time; those after the last day are dropped."""
    w = W.orderBy(column)  # one row per calendar day
    prev = cal.select("position", F.col(column).alias("_hi"), F.lag(column).over(w).alias("_lo"), F.lit(0).alias("_one"))
    # days between two calendar days are spelled out, so that an equality join finds the position
    lo = F.coalesce(F.date_add("_lo", 0 if strict else 1), F.date_sub("_hi", 1))
    hi = F.date_sub("_hi", 1) if strict else F.col("_hi")
    days = prev.select("position", F.explode(F.sequence(lo, hi)).alias("_day"))
    # a day before the calendar begins is as good as the day before it
    first = prev.groupBy("_one").agg(F.date_sub(F.min("_hi"), 1).alias("_first"))
    e = events.withColumn("_one", F.lit(0)).join(F.broadcast(first), "_one").withColumn("_day", F.greatest(F.col(time).cast("date"), F.when(F.col(time).isNotNull(), F.col("_first"))))
    return e.join(F.broadcast(days), "_day").drop("_day", "_one", "_first")


def code_of_range(df: DataFrame, ranges: DataFrame, code: str, low: str, high: str, label: str, order: str) -> DataFrame:
    """df with the label of the range its code lies in; later ranges (by `order`) win; others are dropped.

    Ranges, a table of a user's making, are spelled out by code, so the join is one of equality; it is broadcast if that makes at most a million codes.
    """
    each = ranges.where(F.col(low) <= F.col(high)).select(F.explode(F.sequence(F.col(low).cast("long"), F.col(high).cast("long"))).alias("_code"), F.col(order).alias("_o"), F.col(label).alias(label))
    one = each.groupBy("_code").agg(F.max_by(label, "_o").alias(label))
    return df.join(broadcast_if_small(one), df[code].cast("long") == F.col("_code")).drop("_code")
