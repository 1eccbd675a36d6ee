"""Evaluation of signals and return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.operators.cross_section import average_ranks
from panelweave.operators.regression import group_ols


def _corr(df: DataFrame, by: list[str], a: str, b: str, centred: bool) -> DataFrame:
    if centred:
        m = df.groupBy(*by).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"))
        d = df.join(m, by).select(*by, (F.col(a) - F.col("_ma")).alias("_a"), (F.col(b) - F.col("_mb")).alias("_b"))
    else:
        d = df.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_a") * F.col("_b")).alias("_ab"), F.sum(F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("_b") * F.col("_b")).alias("_bb"))
    # below: sums of squares of constants are rounding dust, not variance
    ok = (F.col("n") >= 2) & (F.col("_aa") > 1e-20) & (F.col("_bb") > 1e-20)
    return s.select(*by, "n", F.when(ok, F.col("_ab") / F.sqrt(F.when(ok, F.col("_aa") * F.col("_bb")))).alias("ic"))


def information_coefficient(df: DataFrame, by: list[str], signal: str, forward: str, kind: str = "pearson") -> DataFrame:
    """(by..., n, ic) over complete pairs, n >= 2: 'pearson', 'spearman' (average ranks) or 'cosine'; null without variance."""
    d = df.where(F.col(signal).isNotNull() & F.col(forward).isNotNull()).select(*by, F.col(signal).alias("_s"), F.col(forward).alias("_f"))
    if kind == "spearman":
        d = average_ranks(average_ranks(d, by, "_s", "_rs"), by, "_f", "_rf").select(*by, F.col("_rs").alias("_s"), F.col("_rf").alias("_f"))
    return _corr(d, by, "_s", "_f", kind != "cosine")


def univariate_fit(df: DataFrame, by: list[str], signal: str, forward: str) -> DataFrame:
    """(by..., n, alpha, beta, r2) of forward on signal, n >= 3."""
    f = group_ols(df, by, forward, [signal], min_obs=3)
    return f.select(*by, "n", "alpha", F.col(f"beta_{signal}").alias("beta"), "r2")


def lag_rule(n: Column) -> Column:
    """Newey-West lags: floor(4 (n / 100) ^ (2/9))."""
    return F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")


def newey_west(df: DataFrame, by: list[str], order: str, x: str, lags: int | None = None) -> DataFrame:
    """(by..., n, mean, se, t): mean of a series with its HAC standard error (autocovariances over n).

    The series is x without its nulls, in the order of its dates, of which a series has one each; `lags`, or the rule's number
    for its length, may be anything. A series is one array, its lagged products are sums over slices of it.
    """
    d = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(x).alias("_x")))).alias("_a"), F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n"))
    length = F.lit(lags).cast("int") if lags is not None else lag_rule(F.col("n"))
    e = d.select(*by, "n", "mean", F.transform("_a", lambda y: y["_x"] - F.col("mean")).alias("_e"), length.alias("_l"))
    e = e.select(*by, "n", "mean", "_e", "_l", F.explode(F.sequence(F.lit(0), F.least(F.col("_l"), (F.col("n") - 1).cast("int")))).alias("_k"))
    part = lambda start: F.slice("_e", start, (F.col("n") - F.col("_k")).cast("int"))
    g = F.aggregate(F.zip_with(part(F.col("_k") + 1), part(F.lit(1)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2 * (1 - F.col("_k") / (F.col("_l") + 1.0)))
    s = e.select(*by, "n", "mean", (weight * g).alias("_g")).groupBy(*by, "n", "mean").agg(F.sum("_g").alias("_v"))
    lrv = F.col("_v") / F.col("n") / F.col("n")
    se = F.when(lrv > 0, F.sqrt(F.when(lrv > 0, lrv)))
    return s.select(*by, "n", "mean", se.alias("se"), (F.col("mean") / se).alias("t"))


def ic_summary(ic: DataFrame, by: list[str], order: str = "date") -> DataFrame:
    """(by..., n, mean, std, ir, hit_rate, t_nw) of an IC series."""
    d = ic.where("ic is not null")
    a = d.groupBy(*by).agg(F.avg("ic").alias("_mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    nw = newey_west(d, by, order, "ic")
    j = nw.join(a, by)
    return j.select(*by, "n", "mean", "std", (F.col("mean") / F.when(F.col("std") > 0, F.col("std"))).alias("ir"), "hit_rate", F.col("t").alias("t_nw"))


def fama_macbeth(df: DataFrame, date: str, y: str, xs: list[str], min_obs: int = 30) -> DataFrame:
    """(name, n, mean, se, t): per-date regressions, then the mean coefficient with Newey-West errors."""
    f = group_ols(df, [date], y, xs, min_obs=min_obs)
    names = [*xs, "const"]
    longs = f.select(date, F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"beta_{x}" if x != "const" else "alpha").alias("coef")) for x in names])).alias("_z")).select(date, "_z.name", "_z.coef")
    return newey_west(longs, ["name"], date, "coef")


def performance(df: DataFrame, by: list[str], order: str, ret: str, per_year: int = 12) -> DataFrame:
    """(by..., n, ann_return, ann_vol, sharpe, t_nw, max_drawdown, hit_rate) of return series; nulls are left out."""
    d = df.where(F.col(ret).isNotNull())
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_w", F.product(F.col(ret) + 1).over(w))
    d = d.withColumn("_dd", F.col("_w") / F.max("_w").over(w) - 1)
    a = d.groupBy(*by).agg((F.avg(ret) * per_year).alias("ann_return"), (F.stddev_samp(ret) * F.lit(float(per_year) ** 0.5)).alias("ann_vol"), F.min("_dd").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"))
    nw = newey_west(d, by, order, ret).select(*by, "n", F.col("t").alias("t_nw"))
    j = nw.join(a, by)
    return j.select(*by, "n", "ann_return", "ann_vol", (F.col("ann_return") / F.when(F.col("ann_vol") > 0, F.col("ann_vol"))).alias("sharpe"), "t_nw", "max_drawdown", "hit_rate")


def compare_series(df: DataFrame, by: list[str], ours: str, theirs: str, per_year: int = 12) -> DataFrame:
    """(by..., n, corr, ann_mean_diff, tracking_error, mae, max_abs_diff) of two series on common dates."""
    d = df.where(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    c = _corr(d, by, ours, theirs, True)
    x = F.col(ours) - F.col(theirs)
    a = d.groupBy(*by).agg((F.avg(x) * per_year).alias("ann_mean_diff"), (F.stddev_samp(x) * F.lit(float(per_year) ** 0.5)).alias("tracking_error"), F.avg(F.abs(x)).alias("mae"), F.max(F.abs(x)).alias("max_abs_diff"))
    return c.withColumnRenamed("ic", "corr").join(a, by)
