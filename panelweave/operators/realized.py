"""Realized moments of intraday prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tick_filter(bars: DataFrame, source: list[str], time: str, price: str, reference: str, band: tuple[float, float] = (0.5, 2.0), jump: float = 1.5, window: int = 2, least: int = 3) -> DataFrame:
    """Bars within a band around the day's reference price and within `jump` times the median of the bars around them.

    The median is over window bars on each side and the bar itself; with under `least` of them the bar passes.
    """
    p = F.col(price)
    inside = bars.where((p >= band[0] * F.col(reference)) & (p <= band[1] * F.col(reference)))
    w = W.partitionBy(*source).orderBy(time).rowsBetween(-window, window)
    med = F.when(F.count(p).over(w) >= least, F.percentile(p, 0.5).over(w))
    d = inside.withColumn("_med", med)
    return d.where(F.col("_med").isNull() | ((p <= jump * F.col("_med")) & (p >= F.col("_med") / jump))).drop("_med")


def moments_of_returns(returns: DataFrame, source: list[str], r: str, least: int) -> DataFrame:
    """(source..., rv_plus, rv_minus, rv, sj, rsj, rsk, rkt, n) of the returns of each source; sources with under `least` are left out."""
    x = F.col(r)
    s = returns.where(x.isNotNull()).groupBy(*source).agg(
        F.sum(F.when(x > 0, x * x).otherwise(0.0)).alias("rv_plus"), F.sum(F.when(x < 0, x * x).otherwise(0.0)).alias("rv_minus"), F.sum(x * x).alias("rv"), F.sum(x * x * x).alias("_3"), F.sum(x * x * x * x).alias("_4"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= least)
    rv = F.when(F.col("rv") > 0, F.col("rv"))
    sj = F.col("rv_plus") - F.col("rv_minus")
    return s.select(*source, "rv_plus", "rv_minus", "rv", sj.alias("sj"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sj / rv)).alias("rsj"), (F.sqrt(F.col("n").cast("double")) * F.col("_3") / F.pow(rv, 1.5)).alias("rsk"), (F.col("n") * F.col("_4") / (rv * rv)).alias("rkt"), "n")


def realized_from_grid(grid: DataFrame, source: list[str], first_price: DataFrame, least: int) -> DataFrame:
    """Realized moments of a regular grid of prices (slot_no, price, state); the first return starts at first_price."""
    g = grid.join(first_price, source)
    w = W.partitionBy(*source).orderBy("slot_no")
    before = F.coalesce(F.lag("price").over(w), F.col("first_price"))
    ok = (F.col("price") > 0) & (before > 0)
    return moments_of_returns(g.select(*source, F.when(ok, F.log(F.when(ok, F.col("price") / before))).alias("_r")), source, "_r", least)


def realized_from_bars(bars: DataFrame, source: list[str], time: str, price: str, least: int) -> DataFrame:
    """Realized moments of irregular bars: log returns within a source only, so nothing crosses the night."""
    w = W.partitionBy(*source).orderBy(time)
    p = F.when(F.col(price) > 0, F.col(price))
    d = bars.where(p.isNotNull()).select(*source, time, p.alias("_p"))
    return moments_of_returns(d.select(*source, F.log(F.col("_p") / F.lag("_p").over(w)).alias("_r")), source, "_r", least)


def trailing_mean(df: DataFrame, key: str, date: str, x: str, calendar: DataFrame, rows: int = 5) -> DataFrame:
    """df with the mean of the last `rows` values where they lie on successive calendar positions; others are dropped."""
    d = df.join(F.broadcast(calendar), date)
    w = W.partitionBy(key).orderBy(date)
    f = w.rowsBetween(-(rows - 1), 0)
    d = d.withColumns({"_m": F.when(F.count(x).over(f) == rows, F.avg(x).over(f)), "_gap": F.col("position") - F.lag("position", rows - 1).over(w)})
    return d.where((F.col("_gap") == rows - 1) & F.col("_m").isNotNull()).withColumn(f"{x}_mean", F.col("_m")).drop("_m", "_gap", "position")
