"""Option quotes: filters, monthly trades, delta-hedged returns and the low-leverage spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.dates import third_friday
from panelweave.operators.cross_section import cut, quantiles


def tradable(q: DataFrame, dte: tuple[int, int] = (14, 400), max_spread: float = 0.5, min_interest: float = 1, delta: tuple[float, float] = (0.02, 0.98)) -> DataFrame:
    """Quotes with mid, within bands of maturity, spread, open interest and absolute delta."""
    mid = (F.col("best_bid") + F.col("best_offer")) / 2
    d = q.withColumns({"mid": mid, "dte": F.datediff("exdate", "date")}).where("mid > 0 and best_bid > 0 and best_offer >= best_bid and cp_flag in ('C', 'P')")
    ok = F.col("dte").between(*dte) & ((F.col("best_offer") - F.col("best_bid")) / F.col("mid") <= max_spread) & (F.coalesce("open_interest", F.lit(0)) >= min_interest) & F.abs("delta").between(*delta)
    return d.where(ok)


def maturity_band(dte: Column) -> Column:
    return cut(dte, [13, 45, 75, 105, 210, 390, 1e9], ["1m", "2m", "3m", "6m", "12m", ">12m"])


def delta_band(d: Column) -> Column:
    return cut(F.abs(d), [0, 0.2, 0.4, 0.6, 0.8, 1.0], ["DOTM", "OTM", "ATM", "ITM", "DITM"], include_lowest=True)


def roll_pairs(prices: DataFrame) -> DataFrame:
    """(ticker, entry_date, exit_date): first trading day after one third Friday, last one up to the next.

    A trading day belongs to the month whose expiry it precedes, so both ends are grouped minima and maxima.
    """
    own = F.when(F.col("date") > third_friday("date"), F.add_months(F.trunc("date", "month"), 1)).otherwise(F.trunc("date", "month"))
    g = prices.select("ticker", "date", own.alias("_m")).groupBy("ticker", "_m").agg(F.min("date").alias("entry_date"), F.max("date").alias("exit_date"))
    return g.where("entry_date < exit_date").select("ticker", "entry_date", "exit_date")


def trades(q: DataFrame, prices: DataFrame, rolls: DataFrame, trim: float = 0.0) -> DataFrame:
    """Quotes bought at entry and sold at exit, with elasticity omega, holding-period hedged return and market value."""
    e = q.join(rolls, (q["ticker"] == rolls["ticker"]) & (q["date"] == rolls["entry_date"])).drop(rolls["ticker"])
    x = q.select("ticker", F.col("date").alias("exit_date"), "optionid", F.col("mid").alias("mid_exit"))
    spot = lambda a: prices.select("ticker", F.col("date").alias(f"{a}_date"), F.col("spot").alias(f"spot_{a}"))
    j = e.join(x, ["ticker", "exit_date", "optionid"]).join(spot("entry"), ["ticker", "entry_date"]).join(spot("exit"), ["ticker", "exit_date"]).where("exdate >= exit_date")
    j = j.dropna(subset=["spot_entry", "spot_exit", "delta", "mid", "mid_exit"]).withColumn("omega", F.abs("delta") * F.col("spot_entry") / F.col("mid"))
    if trim > 0:
        j = j.withColumn("_o", F.lit(1))
        b = quantiles(j, ["_o"], "omega", [trim, 1 - trim], ["_lo", "_hi"])
        j = j.join(F.broadcast(b), "_o").where("omega between _lo and _hi").drop("_o", "_lo", "_hi")  # one row of limits
    dh = (F.col("mid_exit") - F.col("mid") - F.col("delta") * (F.col("spot_exit") - F.col("spot_entry"))) / F.col("mid")
    return j.withColumns({"dh_ret": dh, "value": F.col("mid") * F.coalesce("open_interest", F.lit(0)) * F.coalesce("contract_size", F.lit(100.0)), "delta_band": delta_band(F.col("delta")), "maturity_band": maturity_band(F.col("dte"))})


def hedge_daily(t: DataFrame, quotes: DataFrame, prices: DataFrame) -> DataFrame:
    """Trades with dh_ret from daily re-hedging; only those quoted on the entry and the exit day."""
    k = ["ticker", "optionid", "entry_date", "exit_date"]
    d = t.select(*k, F.col("mid").alias("mid_entry")).join(quotes.select("ticker", "optionid", "date", "mid", "delta"), ["ticker", "optionid"]).where("date between entry_date and exit_date and mid > 0 and delta is not null")
    d = d.join(prices, ["ticker", "date"]).where("spot is not null")
    w = W.partitionBy(*k).orderBy("date")
    pnl = (F.col("mid") - F.lag("mid").over(w)) - F.lag("delta").over(w) * (F.col("spot") - F.lag("spot").over(w))
    d = d.withColumn("_p", F.coalesce(pnl, F.lit(0.0)))
    c = d.groupBy(*k).agg(F.min("date").alias("_a"), F.max("date").alias("_b"), F.sum("_p").alias("_p"), F.first("mid_entry").alias("_m"), F.count(F.lit(1)).alias("n_daily_obs")).where("_a = entry_date and _b = exit_date and _m > 0")
    return t.drop("dh_ret").join(c.select(*k, (F.col("_p") / F.col("_m")).alias("dh_ret"), "n_daily_obs"), k)


def _vw(x: str, w: str = "value", when: Column | None = None) -> Column:
    ok = F.col(x).isNotNull() & (F.col(w) > 0)
    ok = ok if when is None else ok & when
    return F.try_divide(F.sum(F.when(ok, F.col(x) * F.col(w))), F.sum(F.when(ok, F.col(w))))


def band_table(t: DataFrame) -> DataFrame:
    """Per delta and maturity band: trades, elasticity and hedged returns in per cent."""
    return t.where("delta_band is not null and maturity_band is not null").groupBy("delta_band", "maturity_band").agg(F.count(F.lit(1)).alias("n"), _vw("omega").alias("omega_vw"), (_vw("dh_ret") * 100).alias("dh_ret_vw_pct"), (F.avg("dh_ret") * 100).alias("dh_ret_ew_pct"))


def low_leverage_spread(t: DataFrame, least: int = 1, leg_least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(by underlying, in all): low minus high elasticity halves, each scaled by its own elasticity; underlyings weighted by value.

    Underlyings with under `least` options on a date, or under leg_least in a half, are left out.
    """
    k = ["entry_date", "ticker"]
    m = quantiles(t, k, "omega", [0.5], ["_med"], bounded=True)  # the options of one underlying on one day
    low = F.col("omega") <= F.col("_med")
    g = t.join(m, k).groupBy(*k).agg(_vw("dh_ret", when=low).alias("low_ret"), _vw("dh_ret", when=~low).alias("high_ret"), _vw("omega", when=low).alias("low_omega"), _vw("omega", when=~low).alias("high_omega"), F.count(F.lit(1)).alias("n_options"), F.sum("value").alias("value"), F.least(F.count_if(low), F.count_if(~low)).alias("_leg"))
    g = g.where((F.col("_leg") >= leg_least) & (F.col("n_options") >= least) & (F.col("low_omega") > 0) & (F.col("high_omega") > 0) & (F.col("value") > 0)).withColumn("ret", F.col("low_ret") / F.col("low_omega") - F.col("high_ret") / F.col("high_omega")).drop("_leg")
    total = g.groupBy("entry_date").agg(_vw("ret").alias("ret"), F.countDistinct("ticker").alias("n_underlyings"), F.sum("n_options").alias("n_options"))
    return g, total


def levered_pairs(returns: DataFrame, pairs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(date, pair, spread) of excess returns (date, ticker, excess): one-fold fund minus half the two-fold one; ALL is the average of the pairs there are.

    pairs: (pair, one_fold, two_fold). columns: several kinds of excess return (after and before fees), giving spread_<column> each.
    """
    cols = columns or ["excess"]
    to = lambda c: f"spread_{c}" if columns else "spread"
    leg = lambda c, x: pairs.select("pair", F.col(c).alias("ticker"), F.lit(x).alias("_c"))
    d = returns.dropna(subset=cols).join(leg("one_fold", 1.0).unionByName(leg("two_fold", -0.5)), "ticker")
    d = d.groupBy("date", "pair").agg(*[F.sum(F.col("_c") * F.col(c)).alias(to(c)) for c in cols], F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")
    return d.unionByName(d.groupBy("date").agg(*[F.avg(to(c)).alias(to(c)) for c in cols]).withColumn("pair", F.lit("ALL")))


def before_fees(after: Column, expense_bps: Column, per_year: int = 252) -> Column:
    """A fund's daily return with its expense ratio, in basis points a year, put back."""
    return after + expense_bps / 10_000.0 / per_year
