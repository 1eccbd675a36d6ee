"""Window functions along the history of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def along(by: str | list[str], order: str | list[str]) -> WindowSpec:
    by, order = [by] if isinstance(by, str) else by, [order] if isinstance(order, str) else order
    return W.partitionBy(*by).orderBy(*order)


def rolling_compound(ret: str, w: WindowSpec, window: int, skip: int, min_periods: int) -> Column:
    """Product of gross returns less 1 over `window` rows ending `skip` rows back; missing ones are passed over."""
    f = w.rowsBetween(-(skip + window - 1), -skip)
    gross = F.col(ret) + 1
    logs = F.log(F.when(gross > 0, gross))
    return F.when(F.count(logs).over(f) >= min_periods, F.exp(F.sum(logs).over(f)) - 1)


def strict_compound(ret: str, w: WindowSpec, window: int, skip: int) -> Column:
    """As rolling_compound, but null if any return is missing or the frame is not full, and -1 after a wipe-out."""
    f = w.rowsBetween(-(skip + window - 1), -skip)
    gross = F.col(ret) + 1
    logs = F.log(F.when(gross > 0, gross))
    full = F.count(F.col(ret)).over(f) == window
    return F.when(full, F.when(F.min(gross).over(f) <= 0, F.lit(-1.0)).otherwise(F.exp(F.sum(logs).over(f)) - 1))


def rolling_std(x: str | Column, w: WindowSpec, first: int, last: int, min_periods: int) -> Column:
    f = w.rowsBetween(first, last)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(f) >= min_periods, F.stddev_samp(x).over(f))


def rolling_corr(x: str, y: str, w: WindowSpec, window: int, min_periods: int) -> Column:
    """Correlation over the pairwise complete rows of the frame, from sums; null without variance."""
    f = w.rowsBetween(-(window - 1), 0)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    n, sa, sb = F.count(a).over(f), F.sum(a).over(f), F.sum(b).over(f)
    va, vb = F.sum(a * a).over(f) - sa * sa / n, F.sum(b * b).over(f) - sb * sb / n
    c = F.sum(a * b).over(f) - sa * sb / n
    return F.when(n >= min_periods, F.try_divide(c, F.sqrt(F.when((va > 1e-18) & (vb > 1e-18), va * vb))))


def with_drawdown(df: DataFrame, by: list[str], order: str, ret: str) -> DataFrame:
    """df with wealth and drawdown per series."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("wealth", F.product(F.coalesce(F.col(ret), F.lit(0.0)) + 1).over(w))
    return d.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)


def year_to_quarter(df: DataFrame, key: str, date: str, year: str, quarter: str, x: str, out: str) -> DataFrame:
    """Quarterly flow of a year-to-date item: itself in quarter 1, else less the row before if that is the quarter before."""
    w = along(key, date)
    before = (F.lag(year).over(w) == F.col(year)) & (F.lag(quarter).over(w) == F.col(quarter) - 1)
    return df.withColumn(out, F.when(F.col(quarter) == 1, F.col(x)).when(before, F.col(x) - F.lag(x).over(w)))


def trailing_year(df: DataFrame, key: str, date: str, x: str, out: str, days: int = 300) -> DataFrame:
    """Sum of four quarters, all present and within a year of each other."""
    w = along(key, date)
    f = w.rowsBetween(-3, 0)
    ok = (F.count(x).over(f) == 4) & (F.datediff(F.col(date), F.lag(date, 3).over(w)) <= days)
    return df.withColumn(out, F.when(ok, F.sum(x).over(f)))


def year_ago(df: DataFrame, key: str, date: str, xs: list[str], low: int = 330, high: int = 400) -> DataFrame:
    """yoy_<x>: the value four rows back if its date lies 330-400 days before."""
    w = along(key, date)
    ok = F.datediff(F.col(date), F.lag(date, 4).over(w)).between(low, high)
    return df.withColumns({f"yoy_{x}": F.when(ok, F.lag(x, 4).over(w)) for x in xs})


def never_backwards(df: DataFrame, key: str, known: str, period: str) -> DataFrame:
    """Rows whose period is later than every period of the key known before."""
    w = W.partitionBy(key).orderBy(known, period).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_p", F.max(period).over(w)).where(F.col("_p").isNull() | (F.col(period) > F.col("_p"))).drop("_p")


def long_rolling_sums(df: DataFrame, by: str, order: str, xs: dict[str, Column], window: int) -> DataFrame:
    """df with sums over the last `window` rows as differences of running sums: linear in the rows however long the window."""
    w = along(by, order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumns({f"_c_{n}": F.sum(F.coalesce(x, F.lit(0.0))).over(run) for n, x in xs.items()})
    return d.withColumns({n: F.col(f"_c_{n}") - F.coalesce(F.lag(f"_c_{n}", window).over(w), F.lit(0.0)) for n in xs}).drop(*[f"_c_{n}" for n in xs])


def long_rolling_std(df: DataFrame, by: str, order: str, x: str, window: int, min_periods: int, out: str) -> DataFrame:
    """Deviation over a long window, from sums."""
    v = F.col(x)
    d = long_rolling_sums(df, by, order, {"_n": v.isNotNull().cast("double"), "_s": v, "_q": v * v}, window)
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.when(F.col("_n") > 0, F.col("_n"))) / F.when(F.col("_n") > 1, F.col("_n") - 1)
    return d.withColumn(out, F.when(F.col("_n") >= min_periods, F.sqrt(F.greatest(var, F.lit(0.0))))).drop("_n", "_s", "_q")


def long_rolling_corr(df: DataFrame, by: str, order: str, x: str, y: str, window: int, min_periods: int, out: str) -> DataFrame:
    """Correlation of the pairwise complete rows over a long window, from sums; null without variance."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    d = long_rolling_sums(df, by, order, {"_n": ok.cast("double"), "_a": a, "_b": b, "_aa": a * a, "_bb": b * b, "_ab": a * b}, window)
    n = F.when(F.col("_n") >= min_periods, F.col("_n"))
    va, vb = F.col("_aa") - F.col("_a") * F.col("_a") / n, F.col("_bb") - F.col("_b") * F.col("_b") / n
    c = F.col("_ab") - F.col("_a") * F.col("_b") / n
    return d.withColumn(out, F.try_divide(c, F.sqrt(F.when((va > 1e-14) & (vb > 1e-14), va * vb)))).drop("_n", "_a", "_b", "_aa", "_bb", "_ab")
