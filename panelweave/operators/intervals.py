"""Merging overlapping intervals per entity into continuous periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Open ends are stored as null or as this day.
FAR_END = "2262-04-11"
_DAY = 86400


def open_end(c: Column | str) -> Column:
    """An end date with null replaced by the far end."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(FAR_END).cast("date"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Continuous periods (keys, start_date, end_date) of closed day intervals.

    The intervals become session windows whose duration is their own length, so Spark's session merging joins all that
    overlap or nest; periods that only touch (one begins the day after another ends) are joined afterwards.
    Before that, rows with the same keys and start shrink to the longest one on the map side: a key, however hot, brings
    at most one row per calendar day to its task.

    Defined cases: a null end is open (FAR_END); rows with a null key, a null start or an end before the start cover
    nothing; repeated rows change nothing; other columns, whatever their names, are ignored.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{start}`").cast("date").alias("_s"), open_end(F.col(f"`{end}`").cast("date")).alias("_e"))
    usable = F.col("_s").isNotNull() & (F.col("_s") <= F.col("_e"))
    for n in names:
        usable &= F.col(n).isNotNull()
    longest = base.where(usable).groupBy(*names, "_s").agg(F.max("_e").alias("_e"))
    days = F.datediff("_e", "_s") + 1
    sessions = (
        longest.select(*names, F.timestamp_seconds(F.unix_date("_s").cast("long") * _DAY).alias("_ts"), F.make_interval(secs=(days.cast("long") * _DAY).cast("decimal(18,6)")).alias("_len"))
        .groupBy(*names, F.session_window("_ts", F.col("_len")).alias("_w"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*names, F.date_from_unix_date((F.unix_seconds("_w.start") / _DAY).cast("int")).alias("_s"), F.date_from_unix_date((F.unix_seconds("_w.end") / _DAY).cast("int") - 1).alias("_e"))
    )
    w = W.partitionBy(*names).orderBy("_s")
    marked = sessions.withColumn("_new", F.coalesce((F.datediff("_s", F.lag("_e").over(w)) > 1).cast("int"), F.lit(1)))
    marked = marked.withColumn("_p", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = marked.groupBy(*names, "_p").agg(F.min("_s").alias("start_date"), F.max("_e").alias("end_date"))
    return merged.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "start_date", "end_date")


def interval_gaps(periods: DataFrame, keys: list[str]) -> DataFrame:
    """The uncovered stretches between successive periods of merge_intervals, with the same columns."""
    w = W.partitionBy(*keys).orderBy("start_date")
    nxt = periods.withColumn("_next", F.lead("start_date").over(w)).where(F.col("_next").isNotNull())
    return nxt.select(*keys, F.date_add("end_date", 1).alias("start_date"), F.date_sub("_next", 1).alias("end_date"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Periods and gaps in one table with span_kind 'period' or 'gap', planned over a single merge."""
    p = merge_intervals(df, keys, start, end)
    w = W.partitionBy(*keys).orderBy("start_date")
    spans = p.withColumn("_next", F.lead("start_date").over(w)).select(
        *keys,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("span_kind"), "start_date", "end_date"),
                    F.when(F.col("_next").isNotNull(), F.struct(F.lit("gap").alias("span_kind"), F.date_add("end_date", 1).alias("start_date"), F.date_sub("_next", 1).alias("end_date"))),
                )
            )
        ).alias("_x"),
    )
    return spans.select("_x.span_kind", *keys, "_x.start_date", "_x.end_date")
