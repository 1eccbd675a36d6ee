"""Time-series operators, engine and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.dates import as_date, is_tuesday, session_minute
from panelweave.operators.asof import calendar
from panelweave.operators.factor import Backtest, BucketFactor, Factor
from panelweave.operators.portfolio import assert_layers, book_from_holdings, layer_spread, names, next_period_returns, weights_at, forward_returns, holdings_diagnostics, leg_weights, simulate_drift, simulate_fixed, simulate_layers, turnover
from panelweave.operators.realized import realized_from_bars, realized_from_grid, trailing_mean
from panelweave.operators.regular_grid import gauge_grid
from panelweave.operators.statistics import compare_series, fama_macbeth, ic_summary, information_coefficient, newey_west, performance, univariate_fit
from panelweave.operators.time_series import along, rolling_compound, rolling_corr, rolling_std, strict_compound, with_drawdown
from panelweave.plans.market_problems import CLOSE_MINUTE, SLOT_MINUTES, SLOTS
from panelweave.plans.market_problems import ORACLE as PROBLEMS
from panelweave.plans.panels import daily, monthly
from panelweave.operators.cross_section import share
from panelweave.plans.queries_cross import X, _W, decile_weights, log_size
from panelweave.plans.registry import D, M, ORACLE, query, r, rs
from panelweave.session import ensure_checkpoint_dir, materialize, table
from panelweave.sources.store import load_factor, save_factor

_BY = "PARTITION BY asset_id ORDER BY date"


@query("t01_lags", f"WITH {M} SELECT asset_id, date, lag(ret, 1) OVER w AS lag1, lag(ret, 4) OVER w AS lag4 FROM m WINDOW w AS ({_BY})")
def t01(spark: SparkSession, root: str) -> DataFrame:
    """Values of rows before."""
    w = along("asset_id", "date")
    return monthly(spark, root).select("asset_id", "date", F.lag("ret", 1).over(w).alias("lag1"), F.lag("ret", 4).over(w).alias("lag4"))


_ROLL = "CASE WHEN count(CASE WHEN 1 + ret > 0 THEN ln(1 + ret) END) OVER f >= {n} THEN exp(sum(CASE WHEN 1 + ret > 0 THEN ln(1 + ret) END) OVER f) - 1 END"


@query("t02_compound", f"WITH {M}, c AS (SELECT asset_id, date, {_ROLL.format(n=5)} AS v FROM m WINDOW f AS ({_BY} ROWS BETWEEN 12 PRECEDING AND 7 PRECEDING)) SELECT asset_id, date, {rs('v', 7)} AS v FROM c")
def t02(spark: SparkSession, root: str) -> DataFrame:
    """Compounded over rows 12 to 7 back, five of them enough."""
    return monthly(spark, root).select("asset_id", "date", r(rolling_compound("ret", along("asset_id", "date"), 6, 7, 5), 7, "v"))


@query("t03_strict_compound", f"WITH {M}, c AS (SELECT asset_id, date, CASE WHEN count(ret) OVER f = 11 THEN CASE WHEN min(1 + ret) OVER f <= 0 THEN -1 ELSE product(1 + ret) OVER f - 1 END END AS v FROM m WINDOW f AS ({_BY} ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)) SELECT asset_id, date, {rs('v', 7)} AS v FROM c")
def t03(spark: SparkSession, root: str) -> DataFrame:
    """Compounded over eleven full rows ending two back."""
    return monthly(spark, root).select("asset_id", "date", r(strict_compound("ret", along("asset_id", "date"), 11, 2), 7, "v"))


@query("t04_rolling_std", f"WITH {M}, c AS (SELECT asset_id, date, CASE WHEN count(ret) OVER f >= 8 THEN stddev_samp(ret) OVER f END AS v FROM m WINDOW f AS ({_BY} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT asset_id, date, {rs('v', 7)} AS v FROM c")
def t04(spark: SparkSession, root: str) -> DataFrame:
    """Deviation of twelve rows, eight of them enough."""
    return monthly(spark, root).select("asset_id", "date", r(rolling_std("ret", along("asset_id", "date"), -11, 0, 8), 7, "v"))


@query("t11_rolling_corr", f"WITH {M}, p AS (SELECT *, CASE WHEN ret IS NOT NULL AND retx IS NOT NULL THEN ret END AS a, CASE WHEN ret IS NOT NULL AND retx IS NOT NULL THEN retx END AS b FROM m), c AS (SELECT asset_id, date, CASE WHEN count(a) OVER f >= 12 THEN covar_pop(a, b) OVER f / nullif(stddev_pop(a) OVER f * stddev_pop(b) OVER f, 0) END AS v FROM p WINDOW f AS ({_BY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT asset_id, date, {rs('v', 6)} AS v FROM c")
def t11(spark: SparkSession, root: str) -> DataFrame:
    """Rolling correlation of 24 rows, twelve pairs enough."""
    return monthly(spark, root).select("asset_id", "date", r(rolling_corr("ret", "retx", along("asset_id", "date"), 24, 12), 6, "v"))


@query("t13_three_days", f"WITH {D}, c AS (SELECT asset_id, date, CASE WHEN count(CASE WHEN ret > -1 THEN ret END) OVER f = 3 THEN sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER f END AS v FROM d WINDOW f AS ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT asset_id, date, {rs('v')} AS v FROM c")
def t13(spark: SparkSession, root: str) -> DataFrame:
    """Overlapping three-day log returns."""
    f = along("asset_id", "date").rowsBetween(-2, 0)
    x = F.log1p(F.when(F.col("ret") > -1, F.col("ret")))
    return daily(spark, root).select("asset_id", "date", r(F.when(F.count(x).over(f) == 3, F.sum(x).over(f)), 8, "v"))


@query("t18_drawdown", f"WITH {M}, e AS (SELECT date, avg(ret) AS ret FROM m GROUP BY date), w AS (SELECT date, product(1 + coalesce(ret, 0)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM e) SELECT date, {rs('wealth', 6)} AS wealth, {rs('wealth / max(wealth) OVER (ORDER BY date) - 1', 6)} AS drawdown FROM w")
def t18(spark: SparkSession, root: str) -> DataFrame:
    """Wealth and drawdown of the equal-weighted market (T18, S18 series)."""
    e = monthly(spark, root).groupBy("date").agg(F.avg("ret").alias("ret")).withColumn("series", F.lit("ew"))
    return with_drawdown(e, ["series"], "date", "ret").select("date", r("wealth", 6), r("drawdown", 6))


@query("t20_share_growth", f"WITH {M}, g AS (SELECT asset_id, date, CASE WHEN market_equity_security > 0 THEN ln(market_equity_security) END AS lm, CASE WHEN retx > -1 THEN ln(1 + retx) END AS lp FROM m), c AS (SELECT asset_id, date, lag(lm, 6) OVER w - lag(lm, 18) OVER w AS i, CASE WHEN count(lp) OVER (w ROWS BETWEEN 17 PRECEDING AND 6 PRECEDING) = 12 THEN sum(lp) OVER (w ROWS BETWEEN 17 PRECEDING AND 6 PRECEDING) END AS p FROM g WINDOW w AS ({_BY})) SELECT asset_id, date, {rs('-(i - p)', 7)} AS exposure FROM c WHERE i - p IS NOT NULL AND date BETWEEN DATE '2008-01-31' AND DATE '2025-11-30'")
def t20(spark: SparkSession, root: str) -> DataFrame:
    """Net share growth with its sign turned."""
    w = along("asset_id", "date")
    g = monthly(spark, root).select("asset_id", "date", F.log(F.when(F.col("market_equity_security") > 0, F.col("market_equity_security"))).alias("lm"), F.log1p(F.when(F.col("retx") > -1, F.col("retx"))).alias("lp"))
    f = w.rowsBetween(-17, -6)
    v = -(F.lag("lm", 6).over(w) - F.lag("lm", 18).over(w) - F.when(F.count("lp").over(f) == 12, F.sum("lp").over(f)))
    return g.select("asset_id", "date", r(v, 7, "exposure")).where("exposure is not null and date between date'2008-01-31' and date'2025-11-30'")


def realized_days(spark: SparkSession, root: str, least: int = 20) -> DataFrame:
    """Realized moments per asset-day over the 78 five-minute prices, the closing auction included."""
    bars = table(spark, root, "minute_bars").select("asset_id", "date_key", "session_minute", "open", "close", "loaded_at")
    src = ["asset_id", "date_key"]
    grid = gauge_grid(bars, src, "session_minute", SLOTS, SLOT_MINUTES, "open", "close", "loaded_at", ("open", CLOSE_MINUTE)).where("price is not null")
    b = bars.where("session_minute between 0 and 389 and close > 0 and not isnan(close)")
    first = b.groupBy(*src).agg(F.max_by(F.when((F.col("open") > 0) & ~F.isnan("open"), F.col("open")), F.struct(-F.col("session_minute"), "loaded_at")).alias("first_price"), F.countDistinct("session_minute").alias("n_observed")).where("n_observed >= 20")
    out = realized_from_grid(grid, src, first.select(*src, "first_price"), least)
    return out.withColumn("date", as_date("date_key"))


_RET = "sqrt(n) * s3 / pow(rv, 1.5) AS rsk, n * s4 / (rv * rv) AS rkt"


@query(
    "a17_realized_bars",
    f"""WITH b AS (SELECT asset_id, date_key, session_minute, arg_max(close, (coalesce(loaded_at, TIMESTAMP '1900-01-01'), close)) AS p FROM minute_bars WHERE session_minute BETWEEN 0 AND 389 AND close > 0 AND NOT isnan(close) GROUP BY ALL),
x AS (SELECT asset_id, date_key, ln(p / lag(p) OVER (PARTITION BY asset_id, date_key ORDER BY session_minute)) AS x FROM b),
s AS (SELECT asset_id, date_key, sum(CASE WHEN x > 0 THEN x * x ELSE 0 END) AS rp, sum(CASE WHEN x < 0 THEN x * x ELSE 0 END) AS rm, sum(x * x) AS rv, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)
SELECT asset_id, CAST(date_key AS BIGINT) AS date_key, {rs('rv')} AS rv, {rs('greatest(-1, least(1, (rp - rm) / nullif(rv, 0)))', 6)} AS rsj, {rs('sqrt(n) * s3 / pow(nullif(rv, 0), 1.5)', 5)} AS rsk, {rs('n * s4 / nullif(rv * rv, 0)', 5)} AS rkt, n FROM s""",
)
def a17(spark: SparkSession, root: str) -> DataFrame:
    """Realized moments of irregular bars, nothing crossing the night."""
    b = table(spark, root, "minute_bars").where("session_minute between 0 and 389 and close > 0 and not isnan(close)")
    b = b.groupBy("asset_id", "date_key", "session_minute").agg(F.max(F.struct("loaded_at", "close")).getField("close").alias("p"))
    out = realized_from_bars(b, ["asset_id", "date_key"], "session_minute", "p", 10)
    return out.select("asset_id", F.col("date_key").cast("long").alias("date_key"), r("rv"), r("rsj", 6), r("rsk", 5), r("rkt", 5), "n")


_A18 = f"""WITH gp AS ({PROBLEMS["p6_prices"]}), mb AS (SELECT asset_id, date_key, session_minute AS m, arg_max_null(CASE WHEN open > 0 AND NOT isnan(open) THEN open END, coalesce(loaded_at, TIMESTAMP '1900-01-01')) AS o FROM minute_bars WHERE session_minute BETWEEN 0 AND 389 AND close > 0 AND NOT isnan(close) GROUP BY ALL),
fo AS (SELECT asset_id, date_key, first(o ORDER BY m) AS o0, count(*) AS n FROM mb GROUP BY ALL HAVING count(*) >= 20),
rr AS (SELECT gp.asset_id, gp.date_key, CASE WHEN price > 0 AND coalesce(lag(price) OVER w, o0) > 0 THEN ln(price / coalesce(lag(price) OVER w, o0)) END AS x FROM gp JOIN fo ON fo.asset_id = gp.asset_id AND fo.date_key = gp.date_key WHERE price IS NOT NULL WINDOW w AS (PARTITION BY gp.asset_id, gp.date_key ORDER BY slot_no)),
s AS (SELECT asset_id, date_key, sum(CASE WHEN x > 0 THEN x * x ELSE 0 END) AS rp, sum(CASE WHEN x < 0 THEN x * x ELSE 0 END) AS rm, sum(x * x) AS rv, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, count(*) AS n FROM rr WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)
SELECT asset_id, CAST(strptime(CAST(date_key AS VARCHAR), '%Y%m%d') AS DATE) AS date, {rs('rv')} AS rv, {rs('greatest(-1, least(1, (rp - rm) / nullif(rv, 0)))', 6)} AS rsj, {rs('sqrt(n) * s3 / pow(nullif(rv, 0), 1.5)', 5)} AS rsk, {rs('n * s4 / nullif(rv * rv, 0)', 5)} AS rkt, n FROM s"""


@query("a18_realized_grid", _A18)
def a18(spark: SparkSession, root: str) -> DataFrame:
    """Realized moments over the full row of five-minute prices."""
    return realized_days(spark, root).select("asset_id", "date", r("rv"), r("rsj", 6), r("rsk", 5), r("rkt", 5), "n")


@query("t16_weekly_mean", f"WITH {D}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM d)), j AS (SELECT asset_id, d.date, p - lag(p, 4) OVER (PARTITION BY asset_id ORDER BY d.date) AS gap, CASE WHEN count(ret) OVER f = 5 THEN avg(ret) OVER f END AS v FROM d JOIN c ON c.date = d.date WINDOW f AS (PARTITION BY asset_id ORDER BY d.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT asset_id, date, {rs('v')} AS exposure FROM j WHERE gap = 4 AND v IS NOT NULL AND isodow(date) = 2")
def t16(spark: SparkSession, root: str) -> DataFrame:
    """Five-day means without gaps, on Tuesdays."""
    d = daily(spark, root).select("asset_id", "date", "ret")
    return trailing_mean(d, "asset_id", "date", "ret", calendar(d, "date")).where(is_tuesday("date")).select("asset_id", "date", r("ret_mean", 8, "exposure"))


# Engine. The book: value-weighted size deciles formed each quarter, and their spread.
def _formed(spark: SparkSession, root: str) -> DataFrame:
    d = log_size(spark, root).where("month(date) in (3, 6, 9, 12)")
    own = F.struct(F.col("label").alias("portfolio"), F.col("weight").alias("weight"))
    top, bottom = F.struct(F.lit("HL").alias("portfolio"), F.col("weight").alias("weight")), F.struct(F.lit("HL").alias("portfolio"), (-F.col("weight")).alias("weight"))
    both = F.array_compact(F.array(own, F.when(F.col("label") == "D10", top).when(F.col("label") == "D01", bottom)))  # a row of an end bucket is in two portfolios
    w = decile_weights(d).select(F.col("date").alias("rebalance_date"), "asset_id", F.explode(both).alias("x")).select("rebalance_date", "x.portfolio", "asset_id", "x.weight")
    return materialize(book_from_holdings(w))  # a book is small and read several times


def _rets(spark: SparkSession, root: str) -> DataFrame:
    return monthly(spark, root).select("date", "asset_id", "ret", "market_equity")


_BOOK = f"""{X}, {_W.replace('FROM x WHERE x IS NOT NULL)', 'FROM x WHERE x IS NOT NULL AND month(date) IN (3, 6, 9, 12))')},
bk AS (SELECT date AS rebalance_date, 'D' || lpad(CAST(code + 1 AS VARCHAR), 2, '0') AS portfolio, asset_id, w AS weight FROM h UNION ALL SELECT date, 'HL', asset_id, CASE WHEN code = 9 THEN w ELSE -w END FROM h WHERE code IN (0, 9)),
rb AS (SELECT DISTINCT rebalance_date FROM bk), pd AS (SELECT t.date, rb.rebalance_date FROM (SELECT DISTINCT date FROM m) t ASOF JOIN rb ON t.date > rb.rebalance_date)"""


@query("e06_fixed_weights", f"WITH {_BOOK} SELECT pd.date, portfolio, {rs('sum(weight * ret)')} AS ret, count(*) AS n_assets FROM bk JOIN pd USING (rebalance_date) JOIN m ON m.date = pd.date AND m.asset_id = bk.asset_id WHERE m.ret IS NOT NULL AND weight <> 0 GROUP BY ALL")
def e06(spark: SparkSession, root: str) -> DataFrame:
    """Held at constant weights."""
    return simulate_fixed(_formed(spark, root), _rets(spark, root)).select("date", "portfolio", r("ret"), "n_assets")


@query("e09_turnover", f"WITH {_BOOK}, n AS (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS n FROM rb), p AS (SELECT n, portfolio, asset_id, weight FROM bk JOIN n USING (rebalance_date)), ch AS (SELECT coalesce(a.n, b.n + 1) AS n, coalesce(a.portfolio, b.portfolio) AS portfolio, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS w FROM p a FULL JOIN p b ON b.n + 1 = a.n AND b.portfolio = a.portfolio AND b.asset_id = a.asset_id) SELECT rebalance_date, portfolio, {rs('sum(abs(w)) / 2')} AS turnover FROM ch JOIN n USING (n) GROUP BY ALL")
def e09(spark: SparkSession, root: str) -> DataFrame:
    """Turnover between rebalances."""
    return turnover(_formed(spark, root)).select("rebalance_date", "portfolio", r("turnover"))


_GRID = "g AS (SELECT bk.rebalance_date, portfolio, bk.asset_id, pd.date, weight, m.ret, product(1 + coalesce(m.ret, 0)) OVER (PARTITION BY bk.rebalance_date, portfolio, bk.asset_id ORDER BY pd.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM bk JOIN pd ON pd.rebalance_date = bk.rebalance_date LEFT JOIN m ON m.date = pd.date AND m.asset_id = bk.asset_id WHERE weight <> 0), nv AS (SELECT rebalance_date, portfolio, date, 1 + sum(weight * (g - 1)) AS nav FROM g GROUP BY ALL)"


@query("e07_drift", f"WITH {_BOOK}, {_GRID} SELECT date, portfolio, {rs('nav / coalesce(lag(nav) OVER (PARTITION BY rebalance_date, portfolio ORDER BY date), 1) - 1', 7)} AS ret FROM nv")
def e07(spark: SparkSession, root: str) -> DataFrame:
    """Bought and held between rebalances."""
    return simulate_drift(_formed(spark, root), _rets(spark, root))[0].select("date", "portfolio", r("ret", 7))


@query(
    "e10_cost",
    f"""WITH {_BOOK}, {_GRID}, n AS (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS n FROM rb), ls AS (SELECT rebalance_date, max(date) AS d FROM pd GROUP BY ALL),
e AS (SELECT n + 1 AS n, g.portfolio, asset_id, weight * g / nav AS w FROM g JOIN nv USING (rebalance_date, portfolio, date) JOIN ls ON ls.rebalance_date = g.rebalance_date AND ls.d = g.date JOIN n ON n.rebalance_date = g.rebalance_date),
t AS (SELECT n, portfolio, asset_id, weight AS w FROM bk JOIN n USING (rebalance_date)),
ch AS (SELECT coalesce(t.n, e.n) AS n, coalesce(t.portfolio, e.portfolio) AS portfolio, coalesce(t.w, 0) - coalesce(e.w, 0) AS w FROM t FULL JOIN e ON e.n = t.n AND e.portfolio = t.portfolio AND e.asset_id = t.asset_id)
SELECT rebalance_date, portfolio, {rs('t', 7)} AS turnover, {rs('CASE WHEN h.r IS NOT NULL THEN 2 * t * 10 / 10000 ELSE 0 END', 7)} AS cost FROM (SELECT rebalance_date, portfolio, sum(abs(w)) / 2 AS t FROM ch JOIN n USING (n) GROUP BY ALL) LEFT JOIN (SELECT DISTINCT rebalance_date AS r FROM pd) h ON h.r = rebalance_date""",
)
def e10(spark: SparkSession, root: str) -> DataFrame:
    """Turnover from drifted weights and its cost at 10 basis points."""
    t = simulate_drift(_formed(spark, root), _rets(spark, root), 10.0)[1]
    return t.select("rebalance_date", "portfolio", r("turnover", 7), r("cost", 7))


@query("e08_layers", f"WITH {_BOOK} SELECT pd.date, portfolio, {rs('sum(m.market_equity * coalesce(m.ret, 0)) / sum(m.market_equity)')} AS ret, count(*) AS n_assets FROM bk JOIN pd USING (rebalance_date) JOIN m ON m.date = pd.date AND m.asset_id = bk.asset_id WHERE m.market_equity > 0 AND portfolio <> 'HL' GROUP BY ALL")
def e08(spark: SparkSession, root: str) -> DataFrame:
    """Fixed members, re-weighted every date."""
    members = _formed(spark, root).where("portfolio <> 'HL'").select("rebalance_date", "portfolio", "asset_id")
    return simulate_layers(members, _rets(spark, root), "market_equity").select("date", "portfolio", r("ret"), "n_assets")


@query("e12_forward", f"WITH {_BOOK} SELECT rebalance_date, asset_id, {rs('product(1 + ret) - 1', 7)} AS forward FROM pd JOIN m ON m.date = pd.date WHERE ret IS NOT NULL GROUP BY ALL")
def e12(spark: SparkSession, root: str) -> DataFrame:
    """Returns over the period held after each signal."""
    return forward_returns(_formed(spark, root).select("rebalance_date"), _rets(spark, root)).select("rebalance_date", "asset_id", r("forward", 7))


@query("e14_next_period", f"WITH {_BOOK}, fr AS (SELECT rebalance_date, min(date) AS date FROM pd GROUP BY ALL) SELECT rebalance_date, asset_id, ret AS forward FROM fr JOIN m USING (date) WHERE ret IS NOT NULL")
def e14(spark: SparkSession, root: str) -> DataFrame:
    """Return of the first date after each signal."""
    return next_period_returns(_formed(spark, root).select("rebalance_date"), _rets(spark, root))


@query("e04_layer_spread", f"WITH {_BOOK}, ly AS (SELECT pd.date, portfolio, sum(m.market_equity * coalesce(m.ret, 0)) / sum(m.market_equity) AS ret FROM bk JOIN pd USING (rebalance_date) JOIN m ON m.date = pd.date AND m.asset_id = bk.asset_id WHERE m.market_equity > 0 AND portfolio <> 'HL' GROUP BY ALL) SELECT date, CASE WHEN count(*) FILTER (portfolio IN ('D01', 'D02', 'D09', 'D10')) = 4 THEN {rs("sum(CASE WHEN portfolio IN ('D09', 'D10') THEN ret / 2 WHEN portfolio IN ('D01', 'D02') THEN -ret / 2 ELSE 0 END)", 7)} ELSE 0 END AS ret FROM ly GROUP BY date")
def e04(spark: SparkSession, root: str) -> DataFrame:
    """A spread over layers that are re-weighted every date, nil where one of its layers is empty; each asset in one layer."""
    members = assert_layers(_formed(spark, root).where("portfolio <> 'HL'").select("rebalance_date", "portfolio", "asset_id"))
    layers = simulate_layers(members, _rets(spark, root), "market_equity")
    return layer_spread(layers, {"D01": -0.5, "D02": -0.5, "D09": 0.5, "D10": 0.5}, "HL").select("date", r("ret", 7))


@query("e20_book", f"WITH {_BOOK} SELECT portfolio, min(rebalance_date) AS first_rebalance, max(rebalance_date) AS last_rebalance, count(DISTINCT rebalance_date) AS n_rebalances FROM bk GROUP BY portfolio")
def e20(spark: SparkSession, root: str) -> DataFrame:
    """Names and rebalances of a book."""
    return names(_formed(spark, root))


@query("e20_weights_at", f"WITH {_BOOK} SELECT portfolio, asset_id, {rs('weight')} AS weight FROM bk WHERE rebalance_date = DATE '2015-06-30'")
def e20_at(spark: SparkSession, root: str) -> DataFrame:
    """The weights of one rebalance."""
    return weights_at(_formed(spark, root), "2015-06-30").select("portfolio", "asset_id", r("weight"))


@query("x26_sorted_legs", f"WITH {X}, {_W.split(', h AS')[0]}, g AS (SELECT *, CASE WHEN code >= 7 THEN 1 WHEN code <= 1 THEN -1 END AS side FROM c WHERE code IS NOT NULL AND market_equity > 0) SELECT date, asset_id, CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS leg, {rs('side * market_equity / sum(market_equity) OVER (PARTITION BY date, side)')} AS weight FROM g WHERE side IS NOT NULL")
def x26(spark: SparkSession, root: str) -> DataFrame:
    """Legs of several groups, each weighted over all of its groups together."""
    d = log_size(spark, root).where("x is not null").select("date", "asset_id", F.col("x").alias("exposure"), "market_equity")
    f = BucketFactor("size", limits=None, long_codes=(7, 8, 9), short_codes=(0, 1)).build(d)
    return f.holdings.where("portfolio = 'HL'").select(F.col("rebalance_date").alias("date"), "asset_id", "leg", r("weight"))


@query("x32_quintile_spread", f"WITH {X}, {_W.replace('>= 10 THEN', '>= 5 THEN').replace(str([share(j, 10) for j in range(1, 10)]), str([share(j, 5) for j in range(1, 5)]))} SELECT date, asset_id, 'G' || CAST(code + 1 AS VARCHAR) AS grp, {rs('CASE WHEN code = 0 THEN w WHEN code = 4 THEN -w END')} AS weight FROM h WHERE code IN (0, 4)")
def x32(spark: SparkSession, root: str) -> DataFrame:
    """Quintiles of a signal that is bought low and sold high, with their labels."""
    d = log_size(spark, root).where("x is not null").select("date", "asset_id", F.col("x").alias("exposure"), "market_equity")
    f = BucketFactor("size", buckets=5, limits=None, top_is_long=False, label="G").build(d)
    return f.holdings.where("portfolio = 'HL'").select(F.col("rebalance_date").alias("date"), "asset_id", F.when(F.col("leg") == "long", "G1").otherwise("G5").alias("grp"), r("weight"))


@query("a11_diagnostics", f"WITH {_BOOK} SELECT rebalance_date, portfolio, count(DISTINCT asset_id) AS n_assets, {rs('sum(abs(weight))')} AS gross, {rs('sum(weight)')} AS net FROM bk GROUP BY ALL")
def a11(spark: SparkSession, root: str) -> DataFrame:
    """Names, gross and net exposure of each book."""
    return holdings_diagnostics(_formed(spark, root), ["rebalance_date", "portfolio"]).select("rebalance_date", "portfolio", "n_assets", r("gross"), r("net"))


# Evaluation. Signal: log size; forward: next month's return.
def pairs(spark: SparkSession, root: str) -> DataFrame:
    x = log_size(spark, root).select("date", "asset_id", "x")
    nxt = monthly(spark, root).select(F.last_day(F.add_months("date", -1)).alias("date"), "asset_id", F.col("ret").alias("fwd"))
    return x.join(nxt, ["date", "asset_id"]).where("x is not null and fwd is not null")


_P = f"{X}, pr AS (SELECT x.date, x.asset_id, x.x, m.ret AS fwd FROM x JOIN m ON m.asset_id = x.asset_id AND m.date = last_day(x.date + INTERVAL 1 MONTH) WHERE x.x IS NOT NULL AND m.ret IS NOT NULL)"
_IC = f"{_P}, ic AS (SELECT date, count(*) AS n, CASE WHEN count(*) >= 2 AND var_pop(x) > 1e-20 AND var_pop(fwd) > 1e-20 THEN covar_pop(x, fwd) / (stddev_pop(x) * stddev_pop(fwd)) END AS ic FROM pr GROUP BY date)"


@query("v01_ic_pearson", f"WITH {_IC} SELECT date, n, {rs('ic', 7)} AS ic FROM ic")
def v01(spark: SparkSession, root: str) -> DataFrame:
    """Correlation of signal and next return per date."""
    return information_coefficient(pairs(spark, root), ["date"], "x", "fwd").select("date", "n", r("ic", 7))


@query("v01_ic_spearman", f"WITH {_P}, k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0::DOUBLE AS fwd FROM pr) SELECT date, count(*) AS n, {rs('CASE WHEN count(*) >= 2 THEN covar_pop(x, fwd) / nullif(stddev_pop(x) * stddev_pop(fwd), 0) END', 7)} AS ic FROM k GROUP BY date")
def v01_rank(spark: SparkSession, root: str) -> DataFrame:
    """Rank correlation with average ties."""
    return information_coefficient(pairs(spark, root), ["date"], "x", "fwd", "spearman").select("date", "n", r("ic", 7))


@query("v01_ic_cosine", f"WITH {_P} SELECT date, count(*) AS n, {rs('CASE WHEN count(*) >= 2 THEN sum(x * fwd) / nullif(sqrt(sum(x * x) * sum(fwd * fwd)), 0) END', 7)} AS ic FROM pr GROUP BY date")
def v01_cos(spark: SparkSession, root: str) -> DataFrame:
    """Cosine similarity."""
    return information_coefficient(pairs(spark, root), ["date"], "x", "fwd", "cosine").select("date", "n", r("ic", 7))


@query("v02_cumulative_ic", f"WITH {_IC} SELECT date, {rs('sum(coalesce(ic, 0)) OVER (ORDER BY date)', 6)} AS cumulative_ic, {rs('(avg(ic) OVER ()) / (stddev_samp(ic) OVER ())', 6)} AS ir FROM ic")
def v02(spark: SparkSession, root: str) -> DataFrame:
    """Running sum of the IC and its full-sample ratio (V02). One row per date."""
    ic = information_coefficient(pairs(spark, root), ["date"], "x", "fwd").withColumn("_s", F.lit(0))
    w = W.partitionBy("_s")
    return ic.select("date", r(F.sum(F.coalesce("ic", F.lit(0.0))).over(w.orderBy("date").rowsBetween(W.unboundedPreceding, 0)), 6, "cumulative_ic"), r(F.avg("ic").over(w) / F.stddev_samp("ic").over(w), 6, "ir"))


@query("v03_univariate", f"WITH {_P} SELECT date, count(*) AS n, {rs('regr_intercept(fwd, x)', 6)} AS alpha, {rs('regr_slope(fwd, x)', 6)} AS beta, {rs('regr_r2(fwd, x)', 6)} AS r2 FROM pr GROUP BY date HAVING count(*) >= 3 AND var_pop(x) > 1e-20 AND var_pop(fwd) > 1e-20")
def v03(spark: SparkSession, root: str) -> DataFrame:
    """Fit of next return on signal per date."""
    return univariate_fit(pairs(spark, root), ["date"], "x", "fwd").select("date", "n", r("alpha", 6), r("beta", 6), r("r2", 6)).where("r2 is not null")


def nw_sql(series: str, key: str, x: str) -> str:
    """Newey-West on the SQL side: autocovariances by a self join on the row number."""
    return f"""s0 AS (SELECT {key} AS k, date, {x} AS v, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i, count(*) OVER (PARTITION BY {key}) AS n, avg({x}) OVER (PARTITION BY {key}) AS mu FROM {series} WHERE {x} IS NOT NULL),
s1 AS (SELECT *, CAST(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)) AS INTEGER) AS big FROM s0),
s2 AS (SELECT a.k, b.i - a.i AS lg, any_value(a.n) AS n, any_value(a.mu) AS mu, any_value(a.big) AS big, sum((a.v - a.mu) * (b.v - b.mu)) AS g FROM s1 a JOIN s1 b ON a.k = b.k AND b.i - a.i BETWEEN 0 AND a.big GROUP BY ALL),
nw AS (SELECT k, any_value(n) AS n, any_value(mu) AS mean, sum(CASE WHEN lg = 0 THEN g ELSE 2 * (1 - lg / (big + 1.0::DOUBLE)) * g END) / any_value(n) / any_value(n) AS q FROM s2 GROUP BY k)"""


@query("v05_newey_west", f"WITH {_IC}, {nw_sql('ic', '0', 'ic')} SELECT n, {rs('mean')} AS mean, {rs('sqrt(q)')} AS se, {rs('mean / sqrt(q)', 5)} AS t FROM nw WHERE q > 0")
def v05(spark: SparkSession, root: str) -> DataFrame:
    """Mean of a series with its Newey-West error."""
    ic = information_coefficient(pairs(spark, root), ["date"], "x", "fwd").withColumn("_s", F.lit(0))
    return newey_west(ic, ["_s"], "date", "ic").select("n", r("mean"), r("se"), r("t", 5))


@query("v05_newey_west_36", f"WITH {_IC}, {nw_sql('ic', '0', 'ic').replace('CAST(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)) AS INTEGER)', '36')} SELECT n, {rs('mean')} AS mean, {rs('sqrt(q)')} AS se, {rs('mean / sqrt(q)', 5)} AS t FROM nw WHERE q > 0")
def v05_36(spark: SparkSession, root: str) -> DataFrame:
    """The same with 36 lags."""
    ic = information_coefficient(pairs(spark, root), ["date"], "x", "fwd").withColumn("_s", F.lit(0))
    return newey_west(ic, ["_s"], "date", "ic", 36).select("n", r("mean"), r("se"), r("t", 5))


@query("v06_ic_summary", f"WITH {_IC}, {nw_sql('ic', '0', 'ic')}, a AS (SELECT avg(ic) AS m, stddev_samp(ic) AS s, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS h FROM ic WHERE ic IS NOT NULL) SELECT n, {rs('m', 7)} AS mean, {rs('s', 7)} AS std, {rs('m / s', 6)} AS ir, {rs('h', 6)} AS hit_rate, {rs('mean / sqrt(q)', 5)} AS t_nw FROM nw, a")
def v06(spark: SparkSession, root: str) -> DataFrame:
    """Summary of an IC series."""
    ic = information_coefficient(pairs(spark, root), ["date"], "x", "fwd").withColumn("_s", F.lit(0))
    return ic_summary(ic, ["_s"]).select("n", r("mean", 7), r("std", 7), r("ir", 6), r("hit_rate", 6), r("t_nw", 5))


H = 6


def decay(spark: SparkSession, root: str) -> DataFrame:
    """IC of the signal with the return h date positions later, h = 1..H: dates are numbered, so an asset's gaps stay gaps."""
    x = log_size(spark, root).where("x is not null").select("date", "asset_id", "x")
    cal = F.broadcast(calendar(monthly(spark, root), "date"))
    s = x.join(cal, "date").select("asset_id", "x", F.col("date"), F.explode(F.array(*[F.lit(h) for h in range(1, H + 1)])).alias("h"), "position")
    y = monthly(spark, root).where("ret is not null").join(cal, "date").select("asset_id", F.col("ret").alias("fwd"), F.col("position").alias("p2"))
    j = s.withColumn("p2", F.col("position") + F.col("h")).join(y, ["asset_id", "p2"])
    return information_coefficient(j, ["date", "h"], "x", "fwd")


@query("v07_ic_decay", f"WITH {X}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM m)), s AS (SELECT x.*, p FROM x JOIN c USING (date) WHERE x IS NOT NULL), y AS (SELECT asset_id, ret AS fwd, p FROM m JOIN c USING (date) WHERE ret IS NOT NULL), j AS (SELECT s.date, y.p - s.p AS h, x, fwd FROM s JOIN y ON y.asset_id = s.asset_id AND y.p - s.p BETWEEN 1 AND {H}), i AS (SELECT date, h, covar_pop(x, fwd) / nullif(stddev_pop(x) * stddev_pop(fwd), 0) AS ic FROM j GROUP BY ALL HAVING count(*) >= 2) SELECT h, {rs('avg(ic)', 6)} AS mean_ic, count(ic) AS n FROM i GROUP BY h")
def v07(spark: SparkSession, root: str) -> DataFrame:
    """Decay of the IC over horizons."""
    return decay(spark, root).where("ic is not null").groupBy(F.col("h").cast("long").alias("h")).agg(F.avg("ic").alias("m"), F.count("ic").alias("n")).select("h", r("m", 6, "mean_ic"), "n")


@query("v08_fama_macbeth", f"WITH {_P}, b AS (SELECT date, regr_slope(fwd, x) AS x, regr_intercept(fwd, x) AS const FROM pr GROUP BY date HAVING count(*) >= 30), ln AS (SELECT date, 'x' AS name, x AS coef FROM b UNION ALL SELECT date, 'const', const FROM b), {nw_sql('ln', 'name', 'coef')} SELECT k AS name, n, {rs('mean', 7)} AS mean, {rs('sqrt(q)', 7)} AS se, {rs('mean / sqrt(q)', 4)} AS t FROM nw WHERE q > 0")
def v08(spark: SparkSession, root: str) -> DataFrame:
    """Fama-MacBeth regression with Newey-West errors."""
    return fama_macbeth(pairs(spark, root), "date", "fwd", ["x"]).select("name", "n", r("mean", 7), r("se", 7), r("t", 4))


_PERF = "pf AS (SELECT k, avg(v) * 12 AS ar, stddev_samp(v) * sqrt(12) AS av, min(dd) AS dd, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS h FROM (SELECT *, w / max(w) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM (SELECT *, product(1 + v) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM s0)) GROUP BY k)"
_SIM = "sm AS (SELECT pd.date, portfolio, sum(weight * ret) AS ret FROM bk JOIN pd USING (rebalance_date) JOIN m ON m.date = pd.date AND m.asset_id = bk.asset_id WHERE m.ret IS NOT NULL AND weight <> 0 GROUP BY ALL)"


@query("v09_performance", f"WITH {_BOOK}, {_SIM}, {nw_sql('sm', 'portfolio', 'ret')}, {_PERF} SELECT k AS portfolio, n, {rs('ar', 7)} AS ann_return, {rs('av', 7)} AS ann_vol, {rs('ar / av', 6)} AS sharpe, {rs('mean / sqrt(q)', 5)} AS t_nw, {rs('dd', 6)} AS max_drawdown, {rs('h', 6)} AS hit_rate FROM nw JOIN pf USING (k)")
def v09(spark: SparkSession, root: str) -> DataFrame:
    """Summary of each portfolio's returns."""
    sim = simulate_fixed(_formed(spark, root), _rets(spark, root))
    return performance(sim, ["portfolio"], "date", "ret").select("portfolio", "n", r("ann_return", 7), r("ann_vol", 7), r("sharpe", 6), r("t_nw", 5), r("max_drawdown", 6), r("hit_rate", 6))


@query("v10_by_year", f"WITH {_BOOK}, {_SIM} SELECT portfolio, CAST(year(date) AS BIGINT) AS year, {rs('product(1 + ret) - 1', 7)} AS ret, count(*) AS n FROM sm GROUP BY ALL")
def v10(spark: SparkSession, root: str) -> DataFrame:
    """Calendar-year returns."""
    sim = simulate_fixed(_formed(spark, root), _rets(spark, root))
    return sim.groupBy("portfolio", F.year("date").cast("long").alias("year")).agg((F.product(F.col("ret") + 1) - 1).alias("ret"), F.count(F.lit(1)).alias("n")).select("portfolio", "year", r("ret", 7), "n")


@query("v11_ic_by_year", f"WITH {_IC} SELECT CAST(year(date) AS BIGINT) AS year, {rs('avg(ic)', 6)} AS mean_ic, count(ic) AS n, {rs('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)', 6)} AS hit_rate FROM ic WHERE ic IS NOT NULL GROUP BY ALL")
def v11(spark: SparkSession, root: str) -> DataFrame:
    """IC by year."""
    ic = information_coefficient(pairs(spark, root), ["date"], "x", "fwd").where("ic is not null")
    return ic.groupBy(F.year("date").cast("long").alias("year")).agg(F.avg("ic").alias("m"), F.count("ic").alias("n"), F.avg((F.col("ic") > 0).cast("double")).alias("h")).select("year", r("m", 6, "mean_ic"), "n", r("h", 6, "hit_rate"))


@query("v14_factor_regressions", f"WITH {M}, mk AS (SELECT date, avg(ret) AS mkt FROM m GROUP BY date) SELECT asset_id, count(*) AS n, {rs('regr_slope(ret, mkt)', 6)} AS beta, {rs('12 * regr_intercept(ret, mkt)', 6)} AS alpha_ann, {rs('regr_r2(ret, mkt)', 6)} AS r2 FROM m JOIN mk USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY asset_id HAVING count(*) >= 24")
def v14(spark: SparkSession, root: str) -> DataFrame:
    """Each asset on the market."""
    from panelweave.operators.regression import group_ols

    m = monthly(spark, root).select("asset_id", "date", "ret")
    mkt = F.broadcast(m.groupBy("date").agg(F.avg("ret").alias("mkt")))  # one row per month
    f = group_ols(m.join(mkt, "date"), ["asset_id"], "ret", ["mkt"], min_obs=24)
    return f.select("asset_id", "n", r("beta_mkt", 6, "beta"), r(F.col("alpha") * 12, 6, "alpha_ann"), r("r2", 6))


@query("v18_comparison", f"WITH {M}, e AS (SELECT date, avg(ret) AS a, sum(ret * market_equity) / sum(CASE WHEN ret IS NOT NULL THEN market_equity END) AS b FROM m WHERE market_equity > 0 GROUP BY date) SELECT count(*) AS n, {rs('corr(a, b)', 6)} AS corr, {rs('12 * avg(a - b)', 7)} AS ann_mean_diff, {rs('sqrt(12) * stddev_samp(a - b)', 7)} AS tracking_error, {rs('avg(abs(a - b))', 7)} AS mae, {rs('max(abs(a - b))', 7)} AS max_abs_diff FROM e WHERE a IS NOT NULL AND b IS NOT NULL")
def v18(spark: SparkSession, root: str) -> DataFrame:
    """Equal- against value-weighted market."""
    m = monthly(spark, root).where("market_equity > 0")
    e = m.groupBy("date").agg(F.avg("ret").alias("a"), (F.sum(F.col("ret") * F.col("market_equity")) / F.sum(F.when(F.col("ret").isNotNull(), F.col("market_equity")))).alias("b")).withColumn("k", F.lit(0))
    return compare_series(e, ["k"], "a", "b").select("n", r("corr", 6), r("ann_mean_diff", 7), r("tracking_error", 7), r("mae", 7), r("max_abs_diff", 7))


@query("a21_inventory", "SELECT CAST(floor(date_key / 10000) AS BIGINT) AS year, count(*) AS n, count(DISTINCT asset_id) AS n_assets, CAST(sum(CASE WHEN close <= 0 OR isnan(close) OR close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_prices, CAST(sum(CASE WHEN session_minute NOT BETWEEN 0 AND 390 OR session_minute IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS outside, CAST(count(*) - count(DISTINCT (asset_id, date_key, bar_ts)) AS BIGINT) AS repeated FROM minute_bars GROUP BY ALL")
def a21(spark: SparkSession, root: str) -> DataFrame:
    """What a source holds, by year: rows, assets, unusable prices, bars outside the session, repeated keys."""
    b = table(spark, root, "minute_bars").withColumn("year", F.floor(F.col("date_key") / 10000).cast("long"))
    bad = F.coalesce((F.col("close") <= 0) | F.isnan("close"), F.lit(True))
    out = ~F.coalesce(F.col("session_minute").between(0, 390), F.lit(False))
    # distinct keys are counted after grouping by them, so no task holds a year's keys
    k = b.groupBy("year", "asset_id", "date_key", "bar_ts").agg(F.count(F.lit(1)).alias("c"), F.sum(bad.cast("long")).alias("bad"), F.sum(out.cast("long")).alias("out"))
    a = k.groupBy("year", "asset_id").agg(F.sum("c").alias("c"), F.sum("bad").alias("bad"), F.sum("out").alias("out"), F.sum(F.col("c") - 1).alias("rep"))
    return a.groupBy("year").agg(F.sum("c").alias("n"), F.count("asset_id").alias("n_assets"), F.sum("bad").alias("bad_prices"), F.sum("out").alias("outside"), F.sum("rep").alias("repeated"))


@query("m10_session_minute", "SELECT DISTINCT asset_id, date_key, bar_ts, CAST(session_minute AS BIGINT) AS session_minute FROM minute_bars WHERE session_minute IS NOT NULL")
def m10(spark: SparkSession, root: str) -> DataFrame:
    """Minutes since the opening, from the UTC time of a bar and New York's clock."""
    b = table(spark, root, "minute_bars").where("session_minute is not null").select("asset_id", "date_key", "bar_ts").distinct()
    return b.select("asset_id", "date_key", "bar_ts", session_minute(F.col("bar_ts").cast("timestamp")).cast("long").alias("session_minute"))


@query("x03_signals_long", f"WITH {M}, s AS (SELECT date, asset_id, ret, retx FROM m) SELECT date, asset_id, name, {rs('v')} AS v FROM (UNPIVOT s ON ret, retx INTO NAME name VALUE v) WHERE v IS NOT NULL")
def x02(spark: SparkSession, root: str) -> DataFrame:
    """Columns to rows, missing values left out."""
    m = monthly(spark, root).select("date", "asset_id", "ret", "retx")
    return m.unpivot(["date", "asset_id"], ["ret", "retx"], "name", "v").where("v is not null").select("date", "asset_id", "name", r("v"))


@query("e19_market_turnover", f"WITH {M}, w AS (SELECT date, asset_id, market_equity / sum(market_equity) OVER (PARTITION BY date) AS w FROM m WHERE market_equity > 0), n AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM w)), p AS (SELECT n, asset_id, w FROM w JOIN n USING (date)), ch AS (SELECT coalesce(a.n, b.n + 1) AS n, coalesce(a.w, 0) - coalesce(b.w, 0) AS x FROM p a FULL JOIN p b ON b.n + 1 = a.n AND b.asset_id = a.asset_id) SELECT date AS rebalance_date, {rs('sum(abs(x)) / 2', 7)} AS turnover FROM ch JOIN n USING (n) GROUP BY date")
def e19(spark: SparkSession, root: str) -> DataFrame:
    """Turnover of the value-weighted market."""
    w = leg_weights(monthly(spark, root).select("date", "asset_id", "market_equity"), ["date"], "market_equity")
    b = w.select(F.col("date").alias("rebalance_date"), F.lit("market").alias("portfolio"), "asset_id", "weight")
    return turnover(materialize(b)).select("rebalance_date", r("turnover", 7))


_FULL = f"""{X}, {_W}, bk AS (SELECT date AS rebalance_date, 'D' || lpad(CAST(code + 1 AS VARCHAR), 2, '0') AS portfolio, asset_id, w AS weight FROM h UNION ALL SELECT date, 'HL', asset_id, CASE WHEN code = 9 THEN w ELSE -w END FROM h WHERE code IN (0, 9)),
rb AS (SELECT DISTINCT rebalance_date FROM bk), pd AS (SELECT t.date, rb.rebalance_date FROM (SELECT DISTINCT date FROM m) t ASOF JOIN rb ON t.date > rb.rebalance_date)"""


@query("v16_bucket_report", f"WITH {_FULL}, {_SIM}, {nw_sql('sm', 'portfolio', 'ret')}, {_PERF} SELECT k AS portfolio, n, {rs('ar', 6)} AS ann_return, {rs('av', 6)} AS ann_vol, {rs('mean / sqrt(q)', 4)} AS t_nw, {rs('dd', 5)} AS max_drawdown FROM nw JOIN pf USING (k)")
def v16(spark: SparkSession, root: str) -> DataFrame:
    """The whole report of a bucket factor: built, held, summarised."""
    d = log_size(spark, root).where("x is not null").select("date", "asset_id", F.col("x").alias("exposure"), "market_equity")
    f = BucketFactor("size", limits=None).build(d)
    f = Factor(f.name, materialize(f.holdings), f.meta)
    s = Backtest(monthly(spark, root).select("date", "asset_id", "ret")).summary(f)
    return s.select("portfolio", "n", r("ann_return", 6), r("ann_vol", 6), r("t_nw", 4), r("max_drawdown", 5))


def _size_factor(spark: SparkSession, root: str) -> tuple[Factor, Backtest]:
    d = log_size(spark, root).where("x is not null").select("date", "asset_id", F.col("x").alias("exposure"), "market_equity")
    f = BucketFactor("size", limits=None).build(d)
    return Factor(f.name, materialize(f.holdings), f.meta), Backtest(monthly(spark, root).select("date", "asset_id", "ret"))


_TURN = f"{_FULL}, n AS (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS n FROM rb), p AS (SELECT n, portfolio, asset_id, weight FROM bk JOIN n USING (rebalance_date)), ch AS (SELECT coalesce(a.n, b.n + 1) AS n, coalesce(a.portfolio, b.portfolio) AS portfolio, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS w FROM p a FULL JOIN p b ON b.n + 1 = a.n AND b.portfolio = a.portfolio AND b.asset_id = a.asset_id), tn AS (SELECT portfolio AS k, avg(t) AS t FROM (SELECT n, portfolio, sum(abs(w)) / 2 AS t FROM ch JOIN n USING (n) GROUP BY ALL) GROUP BY ALL)"


@query("v12_with_turnover", f"WITH {_TURN}, {_SIM}, {nw_sql('sm', 'portfolio', 'ret')}, {_PERF} SELECT k AS portfolio, n, {rs('ar', 6)} AS ann_return, {rs('t', 6)} AS avg_turnover FROM nw JOIN pf USING (k) JOIN tn USING (k)")
def v12(spark: SparkSession, root: str) -> DataFrame:
    """The summary with its turnover column."""
    f, b = _size_factor(spark, root)
    return b.summary(f).select("portfolio", "n", r("ann_return", 6), r("avg_turnover", 6))


@query("v22_by_year", f"WITH {_FULL}, {_SIM} SELECT portfolio, CAST(year(date) AS BIGINT) AS year, {rs('product(1 + ret) - 1', 6)} AS ret, count(*) AS n FROM sm GROUP BY ALL")
def v22_year(spark: SparkSession, root: str) -> DataFrame:
    """Calendar years of a built factor."""
    f, b = _size_factor(spark, root)
    return b.by_year(f).select("portfolio", "year", r("ret", 6), "n")


@query("v22_newey_west", f"WITH {_FULL}, {_SIM}, {nw_sql('sm', 'portfolio', 'ret')} SELECT k AS portfolio, n, {rs('mean', 7)} AS mean, {rs('mean / sqrt(q)', 4)} AS t FROM nw WHERE q > 0")
def v22_nw(spark: SparkSession, root: str) -> DataFrame:
    """Mean returns of a built factor with their errors."""
    f, b = _size_factor(spark, root)
    return b.newey_west(f).select("portfolio", "n", r("mean", 7), r("t", 4))


@query("v22_ic_decay", ORACLE["v07_ic_decay"])
def v22_decay(spark: SparkSession, root: str) -> DataFrame:
    """Decay of an exposure's IC."""
    b = Backtest(monthly(spark, root).select("date", "asset_id", "ret"))
    x = log_size(spark, root).select("date", "asset_id", F.col("x").alias("exposure"))
    return b.ic_decay(x, H).select("h", r("mean_ic", 6), "n")


@query("v13_series_ols", f"WITH {M}, mk AS (SELECT date, avg(ret) AS x, sum(ret * market_equity) / sum(CASE WHEN ret IS NOT NULL THEN market_equity END) AS y FROM m WHERE market_equity > 0 GROUP BY date), p AS (SELECT * FROM mk WHERE x IS NOT NULL AND y IS NOT NULL), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, avg(x) AS mx, sum(x * x) AS sxx FROM p), e AS (SELECT sum(pow(y - a - b * x, 2)) / any_value(n - 2) AS s2 FROM p, f) SELECT n, {rs('a', 7)} AS alpha, {rs('b', 6)} AS beta, {rs('r2', 6)} AS r2, {rs('sqrt(s2 / (sxx - n * mx * mx))', 6)} AS se_beta FROM f, e")
def v13(spark: SparkSession, root: str) -> DataFrame:
    """Least squares of one series on another with classical errors."""
    m = monthly(spark, root).where("market_equity > 0")
    s = m.groupBy("date").agg(F.avg("ret").alias("x"), (F.sum(F.col("ret") * F.col("market_equity")) / F.sum(F.when(F.col("ret").isNotNull(), F.col("market_equity")))).alias("y"))
    # one series of months goes to one task
    fit = s.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(_series_fit, "n long, alpha double, beta double, r2 double, se_beta double")
    return fit.select("n", r("alpha", 7), r("beta", 6), r("r2", 6), r("se_beta", 6))


def _series_fit(pdf):  # noqa: ANN001, ANN202
    import pandas as pd

    from panelweave.operators.regression import series_ols

    f = series_ols(pdf["y"].to_numpy(dtype=float), pdf[["x"]].to_numpy(dtype=float))
    return pd.DataFrame([(f["n"], f["coef"][0], f["coef"][1], f["r2"], f["se"][1])], columns=["n", "alpha", "beta", "r2", "se_beta"])


@query("s03_factor_store", f"WITH {M} SELECT date, asset_id, {rs('ln(market_equity)')} AS exposure FROM m WHERE market_equity > 0")
def s03(spark: SparkSession, root: str) -> DataFrame:
    """A factor saved to shared storage and read back."""
    import uuid

    m = monthly(spark, root).select("date", "asset_id", F.log(F.when(F.col("market_equity") > 0, F.col("market_equity"))).alias("exposure"))
    folder = save_factor(m, f"{ensure_checkpoint_dir(spark)}/factor-{uuid.uuid4().hex}", {"name": "size"})
    return load_factor(spark, folder)[0].select("date", "asset_id", r("exposure"))


@query(
    "f24_realized_signals",
    f"WITH a18 AS ({_A18}), c AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT CAST(date AS DATE) AS date FROM crsp_daily)), j AS (SELECT a18.asset_id, a18.date, p - lag(p, 4) OVER (PARTITION BY asset_id ORDER BY a18.date) AS gap, avg(rsk) OVER f AS k, avg(rkt) OVER f AS t, avg(rsj) OVER f AS s FROM a18 JOIN c ON c.date = a18.date WINDOW f AS (PARTITION BY asset_id ORDER BY a18.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT asset_id, date, {rs('-k', 4)} AS low_rsk, {rs('t', 4)} AS rkt, {rs('-s', 5)} AS low_rsj FROM j WHERE gap = 4 AND isodow(date) = 2",
)
def f24(spark: SparkSession, root: str) -> DataFrame:
    """Weekly signals from realized skewness, kurtosis and signed jumps, formed on Tuesdays after five days without a gap."""
    d = materialize(realized_days(spark, root).select("asset_id", "date", "rsk", "rkt", "rsj"))
    cal = calendar(table(spark, root, "crsp_daily").select(F.col("date").cast("date").alias("date")), "date")
    out = d
    for x in ("rsk", "rkt", "rsj"):
        out = out.join(trailing_mean(d.select("asset_id", "date", x), "asset_id", "date", x, cal).select("asset_id", "date", f"{x}_mean"), ["asset_id", "date"])
    return out.where(is_tuesday("date")).select("asset_id", "date", r(-F.col("rsk_mean"), 4, "low_rsk"), r("rkt_mean", 4, "rkt"), r(-F.col("rsj_mean"), 5, "low_rsj"))
