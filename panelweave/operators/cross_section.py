"""Operators on the cross-section of one date (or date and category).

A cross-section has one row per asset, so its size is bounded by the assets of a date and one task may sort it: `bounded` is true
by default. For groups without such a bound (an exchange over all dates, the whole table) pass bounded=False: the exact
result is the same, and no group, and no run of equal values, has to fit one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.nulls import finite
from panelweave.session import broadcast_if_small, stored

#: A standard deviation up to this counts as none.
FLAT = 1e-12
#: Widths of outlier limits (fixed values): standard deviations, scaled MADs, interquartile ranges.
WIDTHS = {"std": 3.0, "mad": 3.5, "iqr": 1.5}
#: Other names of the methods (fixed values).
METHODS = {"mean_std": "std", "zscore": "std", "median_mad": "mad", "absolute_median": "mad", "box": "iqr", "boxplot": "iqr", "box_plot": "iqr", "percentile": "quantile"}


def ranks(df: DataFrame, by: list[str], x: str, ties: list[str], bounded: bool = False) -> DataFrame:
    """df with _rank (1.. within the group by x, then by ties; null where x is) and _n (values in the group).

    Bounded groups are one window each. Others are sorted as a whole, by range partitions over group, value and ties, and
    stored: a row's rank is its place in its part of the group plus the values in the parts before, of which only the counts are
    put together. Parts are as many as shuffle partitions, so they grow in number with the session's, not in size with a group.
    """
    has = F.col(x).isNotNull()
    if bounded:
        w = W.partitionBy(*by)
        ordered = w.orderBy(F.col(x).asc_nulls_last(), *ties)
        return df.withColumns({"_rank": F.when(has, F.row_number().over(ordered)).cast("long"), "_n": F.count(x).over(w)})
    order = [*by, F.col(x).asc_nulls_last(), *ties]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_id", 33))
    some = s.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(x).alias("_c"))
    w = W.partitionBy(*by)
    some = some.select(*by, "_part", "_first", (F.sum("_c").over(w.orderBy("_part")) - F.col("_c")).alias("_below"), F.sum("_c").over(w).alias("_n"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    out = s.alias("l").join(broadcast_if_small(some).alias("r"), on)
    return out.select(*[f"l.{c}" for c in df.columns], F.when(has, F.col("_id") - F.col("_first") + F.col("_below") + 1).alias("_rank"), "_n")


def quantiles(df: DataFrame, by: list[str], x: str, probs: list[float], names: list[str], bounded: bool = False) -> DataFrame:
    """(by..., names...): exact quantiles with linear interpolation; groups without values have nulls."""
    if bounded:
        q = F.percentile(F.col(x), F.array(*[F.lit(float(p)) for p in probs]))
        return df.groupBy(*by).agg(q.alias("_q")).select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    r = ranks(df.select(*by, x), by, x, [])
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    picks = []
    for p, n in zip(probs, names):
        lo = F.max(F.when(F.col("_rank") == F.floor(at(p)) + 1, F.col(x)))
        hi = F.max(F.when(F.col("_rank") == F.ceil(at(p)) + 1, F.col(x)))
        t = F.max(at(p) - F.floor(at(p)))
        picks.append((lo + (hi - lo) * t).alias(n))
    return r.groupBy(*by).agg(*picks)


def moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by..., n, mean, std) of the finite values; std with n - 1."""
    v = finite(x)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def bounds(df: DataFrame, by: list[str], x: str, method: str, scale: float | None = None, lower: float | None = 0.01, upper: float | None = 0.99, bounded: bool = True) -> DataFrame:
    """(by..., lo, hi): limits by 'std', 'mad' (median +- scale * 1.4826 MAD), 'iqr' or 'quantile', or another name in METHODS.

    scale is the method's of WIDTHS unless given; lower or upper None is no limit but the least or greatest value. No spread, no limit (null).
    """
    method = METHODS.get(method.lower(), method.lower())
    if method == "quantile":
        return quantiles(df, by, x, [0.0 if lower is None else lower, 1.0 if upper is None else upper], ["lo", "hi"], bounded)
    scale = WIDTHS.get(method) if scale is None else scale
    if method == "std":
        m = moments(df, by, x)
        centre, width = F.col("mean"), F.col("std") * scale
    elif method == "iqr":
        m = quantiles(df, by, x, [0.25, 0.75], ["q1", "q3"], bounded)
        ok = F.col("q3") > F.col("q1")
        return m.select(*by, F.when(ok, F.col("q1") - scale * (F.col("q3") - F.col("q1"))).alias("lo"), F.when(ok, F.col("q3") + scale * (F.col("q3") - F.col("q1"))).alias("hi"))
    elif method == "mad":
        med = quantiles(df, by, x, [0.5], ["med"], bounded)
        dev = with_group(df.select(*by, x), med, by).select(*by, F.abs(F.col(x) - F.col("med")).alias("_d"))
        m = with_group(quantiles(dev, by, "_d", [0.5], ["mad"], bounded), med, by)
        centre, width = F.col("med"), F.col("mad") * 1.4826 * scale
    else:
        raise ValueError(f"unknown method {method!r}")
    return m.select(*by, F.when(width > 0, centre - width).alias("lo"), F.when(width > 0, centre + width).alias("hi"))


def outlier_limits(df: DataFrame, x: str, method: str, **kw: float | None) -> tuple[float, float]:
    """Limits of a whole column as two numbers; infinite where there is no spread or no value."""
    row = bounds(df.select(F.lit(0).alias("_all"), finite(x).alias(x)), ["_all"], x, method, bounded=False, **kw).first()
    return (float("-inf") if row is None or row.lo is None else row.lo, float("inf") if row is None or row.hi is None else row.hi)


def with_group(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """df with its group's statistics; rows with a null key belong to no group and get nulls."""
    return df.join(stats.dropna(subset=by), by, "left")


def clip_outliers(df: DataFrame, by: list[str], x: str, method: str = "quantile", action: str = "clip", **kw: float | bool | None) -> DataFrame:
    """Values beyond their group's limits: 'clip'/'winsorize' them, 'drop' the rows, or only 'flag'; always adds <x>_outlier."""
    d = with_group(df, bounds(df, by, x, method, **kw), by)
    out = F.coalesce((F.col(x) < F.col("lo")) | (F.col(x) > F.col("hi")), F.lit(False))
    d = d.withColumn(f"{x}_outlier", out)
    if action in ("clip", "winsorize"):
        low = F.when(F.col("lo").isNotNull() & (F.col(x) < F.col("lo")), F.col("lo")).otherwise(F.col(x))
        d = d.withColumn(x, F.when(F.col("hi").isNotNull() & (F.col(x) > F.col("hi")), F.col("hi")).otherwise(low))
    elif action == "drop":
        d = d.where(~F.col(f"{x}_outlier"))
    elif action not in ("flag", "none"):
        raise ValueError(f"unknown action {action!r}")
    return d.drop("lo", "hi")


def winsorize(df: DataFrame, by: list[str], x: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    return clip_outliers(df, by, x, "quantile", "clip", lower=lower, upper=upper).drop(f"{x}_outlier")


def zscore(df: DataFrame, by: list[str], x: str, out: str, min_count: int = 0) -> DataFrame:
    """(x - mean) / std within the group; null where the std is nil or there are under min_count values."""
    d = with_group(df, moments(df, by, x), by)
    z = (F.col(x) - F.col("mean")) / F.when((F.col("std") > FLAT) & (F.col("n") >= min_count), F.col("std"))
    return d.withColumn(out, z).drop("n", "mean", "std")


def share(j: int, k: int) -> float:
    """j / k as it comes out of evenly spaced points taken to per cent and back."""
    return j * (1.0 / k) * 100.0 / 100.0


def edge(n: Column, j: int, k: int) -> Column:
    """The j-th of k quantile edges of the ranks 1..n, interpolated as numpy does it, so that equal edges fall equally."""
    pos = F.lit(share(j, k)) * (n - 1)
    a = F.floor(pos)
    t = pos - a
    return F.when(t >= 0.5, (a + 2) - (1 - t)).otherwise((a + 1) + t)


def bucket_codes(df: DataFrame, by: list[str], x: str, k: int, ties: list[str], out: str = "code", min_count: int | None = None, bounded: bool = True) -> DataFrame:
    """Equal-count buckets 0..k-1 by first-come ranks; null where x is null or the group has under min_count (k) values."""
    r = ranks(df, by, x, ties, bounded)
    code = reduce(lambda s, j: s + (F.col("_rank") > edge(F.col("_n"), j, k)).cast("int"), range(1, k), F.lit(0))
    return r.withColumn(out, F.when(F.col("_rank").isNotNull() & (F.col("_n") >= (k if min_count is None else min_count)), code)).drop("_rank", "_n")


def average_ranks(df: DataFrame, by: list[str], x: str, out: str, pct: bool = False, bounded: bool = True) -> DataFrame:
    """Ranks with ties sharing their average; pct: as a share of the group's values."""
    if bounded:
        w = W.partitionBy(*by)
        mean = F.rank().over(w.orderBy(F.col(x).asc_nulls_last())) + (F.count(F.lit(1)).over(W.partitionBy(*by, x)) - 1) / 2.0
        rank = F.when(F.col(x).isNotNull(), mean / F.count(x).over(w) if pct else mean)
        return df.withColumn(out, rank)
    at = ranks(df.select(*by, x).where(F.col(x).isNotNull()), by, x, []).groupBy(*by, x).agg(F.avg("_rank").alias("_r"), F.max("_n").alias("_t"))
    return df.join(at, [*by, x], "left").withColumn(out, F.col("_r") / F.col("_t") if pct else F.col("_r")).drop("_r", "_t")


def fill_missing(df: DataFrame, x: str, method: str, by: list[str] | None = None, order: str | None = None, value: float | None = None, limit: int | None = None, universe: str | None = None, bounded: bool = True) -> DataFrame:
    """x with missing values filled, and <x>_was_missing.

    'mean' and 'median' take the group's (by); 'zero', 'value'; 'ffill' and 'bfill' carry along `order` within by, at most
    `limit` rows far, counting every row present; 'drop' removes the rows; 'flag' only marks.
    universe: a boolean column; rows outside (false or null) have no value, before or after, give none and are not counted.
    """
    inside = F.lit(True) if universe is None else F.coalesce(F.col(universe), F.lit(False))
    df = df if universe is None else df.withColumn(x, F.when(inside, F.col(x)))
    gone = F.col(x).isNull()
    d = df.withColumn(f"{x}_was_missing", gone)
    filled = lambda v: F.when(inside, F.coalesce(F.col(x), v))
    if method in ("mean", "median"):
        s = df.groupBy(*by).agg(F.avg(x).alias("_f")) if method == "mean" else quantiles(df, by, x, [0.5], ["_f"], bounded)
        return with_group(d, s, by).withColumn(x, filled(F.col("_f"))).drop("_f")
    if method in ("zero", "value"):
        return d.withColumn(x, filled(F.lit(0.0 if method == "zero" else value)))
    if method in ("ffill", "bfill"):
        if not by or not order:
            raise ValueError("ffill and bfill need an entity and an order")
        w = W.partitionBy(*by).orderBy(F.col(order) if method == "ffill" else F.col(order).desc())
        run = w.rowsBetween(W.unboundedPreceding, 0)
        d = d.withColumns({"_f": F.last(x, ignorenulls=True).over(run), "_at": F.sum(inside.cast("int")).over(run)})
        d = d.withColumn("_src", F.max(F.when(~gone, F.col("_at"))).over(run))
        ok = F.lit(True) if limit is None else (F.col("_at") - F.col("_src")) <= limit
        return d.withColumn(x, F.when(gone & ok & inside, F.col("_f")).otherwise(F.col(x))).drop("_f", "_at", "_src")
    if method == "drop":
        return d.where(~gone & inside)
    if method == "flag":
        return d
    raise ValueError(f"unknown method {method!r}")


def demean(df: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """xs less their group's average."""
    m = df.groupBy(*by).agg(*[F.avg(x).alias(f"_m_{x}") for x in xs])
    d = with_group(df, m, by)
    return d.withColumns({x: F.col(x) - F.col(f"_m_{x}") for x in xs}).drop(*[f"_m_{x}" for x in xs])


def breakpoints(df: DataFrame, by: list[str], spec: dict[str, tuple[str, list[float]]], reference: Column, min_reference: int = 1, bounded: bool = True) -> DataFrame:
    """Quantiles over the reference rows of each group: spec maps a prefix to (column, probs), giving <prefix>_0, <prefix>_1, ..."""
    ref = df.where(reference)
    if bounded:
        q = [F.percentile(F.col(c), F.array(*[F.lit(float(p)) for p in probs])).alias(f"_{n}") for n, (c, probs) in spec.items()]
        out = ref.groupBy(*by).agg(F.count(F.lit(1)).alias("_ref"), *q).where(F.col("_ref") >= min_reference)
        return out.select(*by, *[F.col(f"_{n}")[i].alias(f"{n}_{i}") for n, (_, probs) in spec.items() for i in range(len(probs))])
    out = ref.groupBy(*by).agg(F.count(F.lit(1)).alias("_ref")).where(F.col("_ref") >= min_reference).drop("_ref")
    for name, (c, probs) in spec.items():
        out = out.join(quantiles(ref, by, c, probs, [f"{name}_{i}" for i in range(len(probs))]), by)
    return out


def size_buckets(df: DataFrame, by: list[str], characteristic: str, lower: float = 0.3, upper: float = 0.7, size: str = "market_equity", exchange: str = "exchange_code", min_reference: int = 3) -> DataFrame:
    """Independent 2 x 3 sort on breakpoints of exchange 1: size_bucket S/B, characteristic_bucket L/M/H, group.

    Dates with under min_reference rows of exchange 1 are left out; a null size or characteristic has no group.
    """
    b = breakpoints(df, by, {"s": (size, [0.5]), "c": (characteristic, [lower, upper])}, F.col(exchange) == 1, min_reference)
    d = df.join(b, by)
    s = F.when(F.col(size) <= F.col("s_0"), "S").when(F.col(size) > F.col("s_0"), "B")
    c = F.when(F.col(characteristic) <= F.col("c_0"), "L").when(F.col(characteristic) > F.col("c_1"), "H").when(F.col(characteristic).isNotNull(), "M")
    return d.withColumns({"size_bucket": s, "characteristic_bucket": c, "group": F.concat(s, c)}).drop("s_0", "c_0", "c_1")


def cut(c: Column, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed interval in which c lies; null outside."""
    low = c >= edges[0] if include_lowest else c > edges[0]
    out = F.when(low & (c <= edges[1]), labels[0])
    for i in range(1, len(labels)):
        out = out.when((c > edges[i]) & (c <= edges[i + 1]), labels[i])
    return out
