"""Books of weights and their simulation.

A book is a long table (rebalance_date, portfolio, asset_id, weight): weights fixed at the close of rebalance_date and
held over the return dates after it, up to and including the next rebalance date. Books are never expanded to a matrix; a
return date knows its rebalance date, and positions meet returns in an equality join on rebalance date and asset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.keys import assert_unique


def leg_weights(df: DataFrame, by: list[str], base: str | None = None, out: str = "weight") -> DataFrame:
    """Equal weights, or weights in proportion to a positive base, summing to 1 in each group; other rows are left out."""
    d = df.where(F.col(base) > 0) if base else df
    x = F.col(base) if base else F.lit(1.0)
    total = d.groupBy(*by).agg(F.sum(x).alias("_total"))
    return d.join(total, by).withColumn(out, x / F.col("_total")).drop("_total")


def spread(weights: DataFrame, by: list[str], side: str, name: str) -> DataFrame:
    """Long side +1, short side -1 over all their rows, each side scaled to 1: side holds 1, -1 or null.

    A date on which one side is empty has no spread, rather than an unbalanced one.
    """
    d = weights.where(F.col(side).isNotNull() & (F.col("weight") > 0))
    total = d.groupBy(*by).agg(F.sum(F.when(F.col(side) > 0, F.col("weight"))).alias("_long"), F.sum(F.when(F.col(side) < 0, F.col("weight"))).alias("_short")).where("_long > 0 and _short > 0")
    own = F.when(F.col(side) > 0, F.col("_long")).otherwise(F.col("_short"))
    return d.join(total, by).withColumn("weight", F.col(side) * F.col("weight") / own).drop("_long", "_short").withColumn("portfolio", F.lit(name))


def sorted_legs(coded: DataFrame, by: list[str], code: str, long: list[int], short: list[int], base: str | None, name: str) -> DataFrame:
    """Rows of the groups of each leg with weights: a leg is weighted over all of its groups together, +1 and -1 in sum; other groups are left out.

    A leg without rows is empty; the other keeps its weights.
    """
    sign = F.when(F.col(code).isin(long), 1).when(F.col(code).isin(short), -1)
    d = coded.withColumn("_sign", sign).where("_sign is not null")
    return leg_weights(d, [*by, "_sign"], base).withColumns({"weight": F.col("_sign") * F.col("weight"), "leg": F.when(F.col("_sign") > 0, "long").otherwise("short"), "portfolio": F.lit(name)}).drop("_sign")


def assert_layers(members: DataFrame) -> DataFrame:
    """members (rebalance_date, portfolio, asset_id) themselves; raises ValueError if an asset is in two layers of one rebalance."""
    return assert_unique(members, ["rebalance_date", "asset_id"], "layers")


def layer_spread(layers: DataFrame, coefficients: dict[str, float], name: str) -> DataFrame:
    """(date, portfolio, ret) of a combination of layer returns (date, portfolio, ret); dates on which a layer of it has no members have return 0."""
    known = F.create_map(*[F.lit(x) for kv in coefficients.items() for x in kv])
    d = layers.groupBy("date").agg(F.sum(F.col("ret") * F.coalesce(F.element_at(known, F.col("portfolio")), F.lit(0.0))).alias("_r"), F.count_if(F.col("portfolio").isin(list(coefficients))).alias("_n"))
    return d.select("date", F.lit(name).alias("portfolio"), F.when(F.col("_n") == len(coefficients), F.col("_r")).otherwise(0.0).alias("ret"))


def book_from_holdings(holdings: DataFrame) -> DataFrame:
    """Duplicate (rebalance_date, portfolio, asset_id) added up; missing weights count 0."""
    w = F.coalesce(F.nanvl(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    return holdings.groupBy("rebalance_date", "portfolio", "asset_id").agg(F.sum(w).alias("weight"))


def holding_periods(book: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, rebalance_date, next_rebalance, is_first): the rebalance each return date belongs to. One row per date."""
    reb = book.select("rebalance_date").distinct()
    reb = reb.withColumn("next_rebalance", F.lead("rebalance_date").over(W.orderBy("rebalance_date")))
    days = dates.select("date").distinct()
    both = days.select("date", F.lit(None).cast("date").alias("_r"), F.lit(0).alias("_o")).unionByName(reb.select(F.col("rebalance_date").alias("date"), F.col("rebalance_date").alias("_r"), F.lit(1).alias("_o")))
    # strictly before: at equal dates the return row comes first
    at = both.withColumn("rebalance_date", F.last("_r", ignorenulls=True).over(W.orderBy("date", "_o").rowsBetween(W.unboundedPreceding, 0))).where("_o = 0 and rebalance_date is not null")
    at = at.select("date", "rebalance_date").join(reb, "rebalance_date")
    return at.withColumn("is_first", F.row_number().over(W.partitionBy("rebalance_date").orderBy("date")) == 1)


def simulate_fixed(book: DataFrame, returns: DataFrame) -> DataFrame:
    """(date, portfolio, ret, gross_exposure, net_exposure, n_assets), rebalanced to the weights every period.

    A missing return counts 0; n_assets counts members with a return; dates with none are left out.
    """
    periods = holding_periods(book, returns)
    sums = book.groupBy("rebalance_date", "portfolio").agg(F.sum(F.abs("weight")).alias("gross_exposure"), F.sum("weight").alias("net_exposure"))
    r = returns.where("ret is not null").join(F.broadcast(periods.select("date", "rebalance_date")), "date")
    hit = book.where("weight <> 0").join(r, ["rebalance_date", "asset_id"])
    out = hit.groupBy("date", "rebalance_date", "portfolio").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count(F.lit(1)).alias("n_assets"))
    return out.join(sums, ["rebalance_date", "portfolio"]).select("date", "portfolio", "ret", "gross_exposure", "net_exposure", "n_assets")


def turnover(book: DataFrame) -> DataFrame:
    """(rebalance_date, portfolio, turnover): half the sum of weight changes; the first is from nothing.

    Consecutive rebalances meet by number: each position is sent to its own date as the new weight and to the next as the old.
    """
    n = book.select("rebalance_date").distinct().withColumn("_n", F.row_number().over(W.orderBy("rebalance_date")))
    b = book.join(F.broadcast(n), "rebalance_date")
    new = b.select("_n", "portfolio", "asset_id", F.col("weight").alias("_w"))
    old = b.select((F.col("_n") + 1).alias("_n"), "portfolio", "asset_id", (-F.col("weight")).alias("_w"))
    change = new.unionByName(old).groupBy("_n", "portfolio", "asset_id").agg(F.sum("_w").alias("_w"))
    out = change.groupBy("_n", "portfolio").agg((F.sum(F.abs("_w")) / 2).alias("turnover"))
    return out.join(F.broadcast(n), "_n").select("rebalance_date", "portfolio", "turnover")


def simulate_drift(book: DataFrame, returns: DataFrame, cost_bps: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Buy and hold between rebalances: (returns table, turnover table).

    Growth of each position is the product of its gross returns since the rebalance, carried over dates without a row; NAV =
    1 + sum w (G - 1). Turnover compares new weights with the drifted old ones; cost = 2 x turnover x bps / 1e4, charged on
    the first date of the holding period.
    """
    periods = holding_periods(book, returns)
    dates = F.broadcast(periods.select("date", "rebalance_date"))
    # dense grid of positions x dates of their period
    grid = book.where("weight <> 0").join(dates, "rebalance_date")
    d = grid.join(returns.select("date", "asset_id", "ret"), ["date", "asset_id"], "left")
    w = W.partitionBy("rebalance_date", "portfolio", "asset_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    g = d.withColumn("_g", F.product(F.coalesce(F.col("ret"), F.lit(0.0)) + 1).over(w))
    nav = g.groupBy("rebalance_date", "portfolio", "date").agg((1 + F.sum(F.col("weight") * (F.col("_g") - 1))).alias("nav"), F.count("ret").alias("n_assets"))
    wn = W.partitionBy("rebalance_date", "portfolio").orderBy("date")
    raw = nav.withColumn("ret", F.col("nav") / F.coalesce(F.lag("nav").over(wn), F.lit(1.0)) - 1)
    # drifted end weights against the next target
    last = periods.groupBy("rebalance_date").agg(F.max("date").alias("date"))
    end = g.join(F.broadcast(last), ["rebalance_date", "date"]).join(nav.select("rebalance_date", "portfolio", "date", "nav"), ["rebalance_date", "portfolio", "date"])
    end = end.select("rebalance_date", "portfolio", "asset_id", (F.col("weight") * F.col("_g") / F.col("nav")).alias("_w"))
    n = book.select("rebalance_date").distinct().withColumn("_n", F.row_number().over(W.orderBy("rebalance_date")))
    kept = book.join(F.broadcast(last.select("rebalance_date")), "rebalance_date", "left_anti").select("rebalance_date", "portfolio", "asset_id", F.col("weight").alias("_w"))
    old = end.unionByName(kept).join(F.broadcast(n), "rebalance_date").select((F.col("_n") + 1).alias("_n"), "portfolio", "asset_id", (-F.col("_w")).alias("_w"))
    new = book.join(F.broadcast(n), "rebalance_date").select("_n", "portfolio", "asset_id", F.col("weight").alias("_w"))
    change = new.unionByName(old).groupBy("_n", "portfolio", "asset_id").agg(F.sum("_w").alias("_w"))
    turn = change.groupBy("_n", "portfolio").agg((F.sum(F.abs("_w")) / 2).alias("turnover")).join(F.broadcast(n), "_n").select("rebalance_date", "portfolio", "turnover")
    first = periods.where("is_first").select("rebalance_date", "date")
    turn = turn.join(F.broadcast(first.select("rebalance_date", F.lit(True).alias("_held"))), "rebalance_date", "left").select("rebalance_date", "portfolio", "turnover", F.when(F.col("_held"), 2 * F.col("turnover") * cost_bps / 1e4).otherwise(0.0).alias("cost"))
    fee = turn.join(F.broadcast(first), "rebalance_date").select("date", "portfolio", "cost")
    out = raw.select("date", "portfolio", "ret", "n_assets").join(fee, ["date", "portfolio"], "left").select("date", "portfolio", (F.col("ret") - F.coalesce("cost", F.lit(0.0))).alias("ret"), "n_assets")
    return out, turn


def simulate_layers(members: DataFrame, returns: DataFrame, base: str) -> DataFrame:
    """(date, portfolio, ret, n_assets): members fixed at each rebalance, re-weighted on every date by a positive base.

    A member without a return still counts in the denominator, at return 0. members: (rebalance_date, portfolio, asset_id).
    """
    periods = holding_periods(members, returns)
    r = returns.where(F.col(base) > 0).join(F.broadcast(periods.select("date", "rebalance_date")), "date")
    hit = members.join(r, ["rebalance_date", "asset_id"])
    return hit.groupBy("date", "portfolio").agg((F.sum(F.col(base) * F.coalesce(F.col("ret"), F.lit(0.0))) / F.sum(base)).alias("ret"), F.count(F.lit(1)).alias("n_assets"))


def forward_returns(signal_dates: DataFrame, returns: DataFrame) -> DataFrame:
    """(rebalance_date, asset_id, forward): return compounded over the period held after each signal date; missing ones are passed over."""
    periods = holding_periods(signal_dates, returns)
    r = returns.where("ret is not null").join(F.broadcast(periods.select("date", "rebalance_date")), "date")
    return r.groupBy("rebalance_date", "asset_id").agg((F.product(F.col("ret") + 1) - 1).alias("forward"))


def next_period_returns(signal_dates: DataFrame, returns: DataFrame) -> DataFrame:
    """(rebalance_date, asset_id, forward): return of the first return date after each signal date; none where there is none later."""
    first = holding_periods(signal_dates, returns).where("is_first").select("date", "rebalance_date")
    r = returns.where("ret is not null").join(F.broadcast(first), "date")  # one row per rebalance
    return r.select("rebalance_date", "asset_id", F.col("ret").alias("forward"))


def names(book: DataFrame) -> DataFrame:
    """(portfolio, first_rebalance, last_rebalance, n_rebalances) of a book."""
    d = book.select("portfolio", "rebalance_date").distinct()
    return d.groupBy("portfolio").agg(F.min("rebalance_date").alias("first_rebalance"), F.max("rebalance_date").alias("last_rebalance"), F.count(F.lit(1)).alias("n_rebalances"))


def weights_at(book: DataFrame, rebalance_date: str) -> DataFrame:
    """(portfolio, asset_id, weight) of one rebalance; the date reaches the scan."""
    return book.where(F.col("rebalance_date") == F.lit(rebalance_date).cast("date")).select("portfolio", "asset_id", "weight")


def value_weighted(df: DataFrame, by: list[str], ret: str, weight: str) -> DataFrame:
    """(by..., ret, n_assets): value-weighted mean over rows with a return and a positive weight."""
    ok = F.col(ret).isNotNull() & (F.col(weight) > 0)
    d = df.where(ok)
    return d.groupBy(*by).agg((F.sum(F.col(ret) * F.col(weight)) / F.sum(weight)).alias("ret"), F.count(F.lit(1)).alias("n_assets"))


def high_minus_low(groups: DataFrame, name: str) -> DataFrame:
    """(date, <name>): (SH + BH) / 2 - (SL + BL) / 2 of group returns; dates without all four are left out."""
    leg = lambda g: F.max(F.when(F.col("group") == g, F.col("ret")))
    out = groups.groupBy("date").agg(((leg("SH") + leg("BH")) / 2 - (leg("SL") + leg("BL")) / 2).alias(name))
    return out.where(F.col(name).isNotNull())


def holdings_diagnostics(book: DataFrame, by: list[str]) -> DataFrame:
    return book.groupBy(*by).agg(F.countDistinct("asset_id").alias("n_assets"), F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
