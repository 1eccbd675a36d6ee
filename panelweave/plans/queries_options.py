"""Option operators over a chain derived by plain arithmetic from crsp_daily, since no option table is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.dates import third_friday
from panelweave.operators.options import band_table, before_fees, hedge_daily, levered_pairs, low_leverage_spread, roll_pairs, tradable, trades
from panelweave.operators.time_series import with_drawdown
from panelweave.plans.panels import daily
from panelweave.plans.queries_factors import _RF, risk_free
from panelweave.plans.registry import ORACLE, D, query, r, rs
from panelweave.session import materialize


def spots(spark: SparkSession, root: str) -> DataFrame:
    return daily(spark, root).where("price > 0").select(F.col("asset_id").cast("string").alias("ticker"), "date", F.col("price").alias("spot"), "asset_id")


def chain(spark: SparkSession, root: str) -> DataFrame:
    """A call and a put per asset-day, expiring on the third Friday after next."""
    s = spots(spark, root)
    own = F.when(F.col("date") > third_friday("date"), F.add_months(F.trunc("date", "month"), 1)).otherwise(F.trunc("date", "month"))
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    d = s.withColumns({"_m": own}).withColumn("_k", k)
    a = F.col("asset_id") % 10
    mid = F.col("spot") * (0.02 + 0.001 * (F.col("asset_id") % 7) + 0.004 * F.col("_k")) + 0.01 * F.dayofmonth("date")
    delta = (0.1 + 0.08 * a) * (1 - 2 * F.col("_k"))
    return d.select(
        "ticker", "date", ((F.year("_m") * 12 + F.month("_m")) * 2 + F.col("_k")).cast("long").alias("optionid"), third_friday(F.add_months("_m", 1)).alias("exdate"), F.when(F.col("_k") == 0, "C").otherwise("P").alias("cp_flag"),
        (mid * 0.95).alias("best_bid"), (mid * 1.05).alias("best_offer"), (F.col("asset_id") % 50).alias("open_interest"), F.lit(100.0).alias("contract_size"), delta.alias("delta"),
    )


_FRI = "({m} + CAST((5 - isodow({m}) + 7) % 7 AS INTEGER) + 14)"
_M0 = "CAST(date_trunc('month', date) AS DATE)"
_OWN = f"CASE WHEN date > {_FRI.format(m=_M0)} THEN CAST({_M0} + INTERVAL 1 MONTH AS DATE) ELSE {_M0} END"
_S = f"{D}, sp AS (SELECT CAST(asset_id AS VARCHAR) AS ticker, asset_id, date, price AS spot, {_OWN} AS m FROM d WHERE price > 0)"
_R = "rl AS (SELECT ticker, m, min(date) AS entry_date, max(date) AS exit_date FROM sp GROUP BY ALL HAVING min(date) < max(date))"
_NEXT = "CAST(m + INTERVAL 1 MONTH AS DATE)"
_C = f"""ch AS (SELECT sp.*, k, (year(m) * 12 + month(m)) * 2 + k AS optionid, {_FRI.format(m=_NEXT)} AS exdate, spot * (0.02::DOUBLE + 0.001::DOUBLE * (asset_id % 7) + 0.004::DOUBLE * k) + 0.01::DOUBLE * day(date) AS mid, (0.1::DOUBLE + 0.08::DOUBLE * (asset_id % 10)) * (1 - 2 * k) AS delta, asset_id % 50 AS oi FROM sp, (SELECT unnest([0, 1]) AS k)),
tq AS (SELECT * FROM ch WHERE mid > 0 AND exdate - date BETWEEN 14 AND 400 AND oi >= 1 AND abs(delta) BETWEEN 0.02 AND 0.98),
tr AS (SELECT a.ticker, rl.entry_date, rl.exit_date, a.optionid, abs(a.delta) * a.spot / a.mid AS omega, (b.mid - a.mid - a.delta * (b.spot - a.spot)) / a.mid AS dh, a.mid * a.oi * 100.0::DOUBLE AS v, a.delta, a.exdate - a.date AS dte FROM tq a JOIN rl ON rl.ticker = a.ticker AND rl.entry_date = a.date JOIN tq b ON b.ticker = a.ticker AND b.optionid = a.optionid AND b.date = rl.exit_date)"""


@query("m14_roll_pairs", f"WITH {_S}, {_R} SELECT ticker, entry_date, exit_date FROM rl")
def m14(spark: SparkSession, root: str) -> DataFrame:
    """First trading day after one third Friday, last one up to the next."""
    return roll_pairs(spots(spark, root))


def period_trades(spark: SparkSession, root: str) -> DataFrame:
    s = materialize(spots(spark, root))
    return trades(materialize(tradable(chain(spark, root))), s, roll_pairs(s))


@query(
    "a19_option_bands",
    f"WITH {_S}, {_R}, {_C}, b AS (SELECT *, CASE WHEN abs(delta) <= 0.2 THEN 'DOTM' WHEN abs(delta) <= 0.4 THEN 'OTM' WHEN abs(delta) <= 0.6 THEN 'ATM' WHEN abs(delta) <= 0.8 THEN 'ITM' ELSE 'DITM' END AS delta_band, CASE WHEN dte <= 45 THEN '1m' WHEN dte <= 75 THEN '2m' WHEN dte <= 105 THEN '3m' ELSE '6m' END AS maturity_band FROM tr) SELECT delta_band, maturity_band, count(*) AS n, {rs('sum(omega * v) / sum(v)', 5)} AS omega_vw, {rs('100 * sum(dh * v) / sum(v)', 4)} AS dh_ret_vw_pct, {rs('100 * avg(dh)', 4)} AS dh_ret_ew_pct FROM b GROUP BY ALL",
)
def a19(spark: SparkSession, root: str) -> DataFrame:
    """Trades by delta and maturity."""
    return band_table(period_trades(spark, root)).select("delta_band", "maturity_band", "n", r("omega_vw", 5), r("dh_ret_vw_pct", 4), r("dh_ret_ew_pct", 4))


@query(
    "a20_option_spread",
    f"WITH {_S}, {_R}, {_C}, h AS (SELECT *, median(omega) OVER (PARTITION BY entry_date, ticker) AS med FROM tr), g AS (SELECT entry_date, ticker, sum(CASE WHEN omega <= med THEN dh * v END) / sum(CASE WHEN omega <= med THEN v END) / (sum(CASE WHEN omega <= med THEN omega * v END) / sum(CASE WHEN omega <= med THEN v END)) - sum(CASE WHEN omega > med THEN dh * v END) / sum(CASE WHEN omega > med THEN v END) / (sum(CASE WHEN omega > med THEN omega * v END) / sum(CASE WHEN omega > med THEN v END)) AS ret, count(*) AS n, sum(v) AS v FROM h GROUP BY ALL) SELECT entry_date, {rs('sum(ret * v) / sum(v)', 7)} AS ret, count(DISTINCT ticker) AS n_underlyings, CAST(sum(n) AS BIGINT) AS n_options FROM g WHERE ret IS NOT NULL GROUP BY entry_date",
)
def a20(spark: SparkSession, root: str) -> DataFrame:
    """Low minus high elasticity, over all underlyings."""
    return low_leverage_spread(period_trades(spark, root))[1].select("entry_date", r("ret", 7), "n_underlyings", "n_options")


@query(
    "t22_hedged_trades",
    f"""WITH {_S}, {_R}, {_C}, dd AS (SELECT tr.ticker, tr.optionid, tr.entry_date, tr.exit_date, q.date, q.mid, q.delta, q.spot FROM tr JOIN ch q ON q.ticker = tr.ticker AND q.optionid = tr.optionid AND q.date BETWEEN tr.entry_date AND tr.exit_date),
pn AS (SELECT *, coalesce((mid - lag(mid) OVER w) - lag(delta) OVER w * (spot - lag(spot) OVER w), 0) AS p FROM dd WINDOW w AS (PARTITION BY ticker, optionid, entry_date, exit_date ORDER BY date))
SELECT ticker, optionid, entry_date, {rs('sum(p) / arg_min(mid, date)', 6)} AS dh_ret, count(*) AS n_daily_obs FROM pn GROUP BY ticker, optionid, entry_date, exit_date HAVING min(date) = entry_date AND max(date) = exit_date""",
)
def t22(spark: SparkSession, root: str) -> DataFrame:
    """Trades hedged anew every day."""
    q = chain(spark, root)
    q = q.withColumn("mid", (F.col("best_bid") + F.col("best_offer")) / 2)
    h = hedge_daily(period_trades(spark, root), q, spots(spark, root).drop("asset_id"))
    return h.select("ticker", "optionid", "entry_date", r("dh_ret", 6), "n_daily_obs")


@query("v19_option_summary", ORACLE["a20_option_spread"].replace(f"SELECT entry_date, {rs('sum(ret * v) / sum(v)', 7)} AS ret, count(DISTINCT ticker) AS n_underlyings, CAST(sum(n) AS BIGINT) AS n_options FROM g WHERE ret IS NOT NULL GROUP BY entry_date", f", z AS (SELECT entry_date, sum(ret * v) / sum(v) AS x FROM g WHERE ret IS NOT NULL GROUP BY entry_date) SELECT count(*) AS n_months, {rs('100 * avg(x)', 4)} AS mean_monthly_pct, {rs('100 * stddev_samp(x)', 4)} AS vol_monthly_pct, {rs('sqrt(12) * avg(x) / stddev_samp(x)', 4)} AS ann_sharpe, {rs('avg(x) / stddev_samp(x) * sqrt(count(*))', 4)} AS tstat FROM z"))
def v19(spark: SparkSession, root: str) -> DataFrame:
    """Summary of the spread's months."""
    t = low_leverage_spread(period_trades(spark, root))[1]
    m, s, n = F.avg("ret"), F.stddev_samp("ret"), F.count("ret")
    return t.agg(n.alias("n_months"), r(m * 100, 4, "mean_monthly_pct"), r(s * 100, 4, "vol_monthly_pct"), r(m / s * F.sqrt(F.lit(12.0)), 4, "ann_sharpe"), r(m / s * F.sqrt(n.cast("double")), 4, "tstat"))


_SAMPLES = {"all": "TRUE", "ATM": "abs(delta) BETWEEN 0.4 AND 0.6", "ex-2020": "year(entry_date) <> 2020"}
_LEG = lambda x, op: f"sum(CASE WHEN omega {op} med THEN {x} * v END) / sum(CASE WHEN omega {op} med THEN v END)"
_V21 = " UNION ALL ".join(
    f"SELECT '{n}' AS sample, entry_date, sum(ret * v) / sum(v) AS x FROM (SELECT entry_date, ticker, {_LEG('dh', '<=')} / ({_LEG('omega', '<=')}) - {_LEG('dh', '>')} / ({_LEG('omega', '>')}) AS ret, sum(v) AS v FROM (SELECT *, median(omega) OVER (PARTITION BY entry_date, ticker) AS med FROM tr WHERE {w}) GROUP BY ALL) WHERE ret IS NOT NULL GROUP BY entry_date"
    for n, w in _SAMPLES.items()
)


@query(
    "v21_subsamples",
    f"WITH {_S}, {_R}, {_C}, z AS ({_V21}), c AS (SELECT *, product(1 + x) OVER (PARTITION BY sample ORDER BY entry_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM z), dd AS (SELECT *, w / max(w) OVER (PARTITION BY sample ORDER BY entry_date) - 1 AS d FROM c) SELECT sample, count(*) AS n_months, {rs('12 * avg(x)', 5)} AS ann_return, {rs('sqrt(12) * stddev_samp(x)', 5)} AS ann_vol, {rs('arg_max(w, entry_date) - 1', 5)} AS total, {rs('min(d)', 5)} AS max_drawdown FROM dd GROUP BY sample",
)
def v21(spark: SparkSession, root: str) -> DataFrame:
    """The spread on subsamples: all, at the money, without 2020; annualised, with its path's end and drawdown (V21). One option a leg is enough, as the stand-in chain has no more."""
    t = materialize(period_trades(spark, root))
    out = None
    for name, where in _SAMPLES.items():
        x = low_leverage_spread(t.where(where))[1].select(F.lit(name).alias("sample"), "entry_date", "ret")
        out = x if out is None else out.unionByName(x)
    d = with_drawdown(out, ["sample"], "entry_date", "ret")
    a = d.groupBy("sample").agg(F.count("ret").alias("n_months"), (F.avg("ret") * 12).alias("ann_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("ann_vol"), (F.max_by("wealth", "entry_date") - 1).alias("total"), F.min("drawdown").alias("max_drawdown"))
    return a.select("sample", "n_months", r("ann_return", 5), r("ann_vol", 5), r("total", 5), r("max_drawdown", 5))


_FEE = "(5 * (asset_id % 20))"


@query(
    "f38_levered_pairs",
    f"WITH {D}, {_RF}, nt AS (SELECT last_day(date) AS mo, count(DISTINCT date) AS n FROM d GROUP BY ALL), rd AS (SELECT mo, pow(1 + coalesce(rf, 0), 1.0::DOUBLE / n) - 1 AS rf FROM nt LEFT JOIN rf ON rf.date = mo), x AS (SELECT asset_id, d.date, ret - rd.rf AS ex, ret - rd.rf + {_FEE} / 10000.0::DOUBLE / 252 AS eb FROM d JOIN rd ON rd.mo = last_day(d.date) WHERE ret IS NOT NULL), p AS (SELECT a.date, CAST(a.asset_id AS VARCHAR) AS pair, a.ex - 0.5 * b.ex AS s, a.eb - 0.5 * b.eb AS t FROM x a JOIN x b ON b.date = a.date AND b.asset_id = a.asset_id + 1 WHERE a.asset_id % 2 = 1) SELECT date, pair, {rs('s')} AS spread_after_fee, {rs('t')} AS spread_before_fee FROM p UNION ALL SELECT date, 'ALL', {rs('avg(s)')}, {rs('avg(t)')} FROM p GROUP BY date",
)
def f38(spark: SparkSession, root: str) -> DataFrame:
    """One-fold minus half two-fold funds, after and before fees (F38): every odd asset stands for a fund, the next one for its two-fold twin, and a number of the asset for its fee."""
    d = daily(spark, root).select("asset_id", "date", "ret")
    x = d.where("ret is not null").withColumn("_m", F.last_day("date")).join(F.broadcast(daily_rates(spark, root)), "_m")  # one row per month
    x = x.withColumn("after_fee", F.col("ret") - F.col("rf_daily"))
    pairs = d.where("asset_id % 2 = 1").select(F.col("asset_id").cast("string").alias("pair"), F.col("asset_id").cast("string").alias("one_fold"), (F.col("asset_id") + 1).cast("string").alias("two_fold")).distinct()
    out = levered_pairs(x.select("date", F.col("asset_id").cast("string").alias("ticker"), "after_fee", before_fees(F.col("after_fee"), F.expr(_FEE)).alias("before_fee")), pairs, ["after_fee", "before_fee"])
    return out.select("date", "pair", r("spread_after_fee"), r("spread_before_fee"))


def daily_rates(spark: SparkSession, root: str) -> DataFrame:
    """(_m, n_days, rf_daily): the month's rate spread over its trading days; one row per month."""
    n = daily(spark, root).select("date").distinct().groupBy(F.last_day("date").alias("_m")).agg(F.count(F.lit(1)).alias("n_days"))
    rf = risk_free(spark, root).withColumnRenamed("date", "_m")
    return n.join(rf, "_m", "left").select("_m", "n_days", (F.pow(1 + F.coalesce("rf", F.lit(0.0)), 1.0 / F.col("n_days")) - 1).alias("rf_daily"))


@query("t15_daily_rates", f"WITH {D}, {_RF}, nt AS (SELECT last_day(date) AS mo, count(DISTINCT date) AS n FROM d GROUP BY ALL) SELECT mo AS month_end, n AS n_days, {rs('pow(1 + coalesce(rf, 0), 1.0::DOUBLE / n) - 1', 9)} AS rf_daily FROM nt LEFT JOIN rf ON rf.date = mo")
def t15(spark: SparkSession, root: str) -> DataFrame:
    """Daily rates from monthly ones."""
    return daily_rates(spark, root).select(F.col("_m").alias("month_end"), "n_days", r("rf_daily", 9))
