"""Factor signals and factor returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.dates import formation_year, next_month_end
from panelweave.functions.nulls import finite, positive
from panelweave.operators.asof import asof_backward, calendar, code_of_range, next_in_calendar
from panelweave.operators.cross_section import breakpoints, bucket_codes, share, size_buckets
from panelweave.operators.portfolio import high_minus_low, leg_weights, simulate_fixed, spread, value_weighted
from panelweave.operators.time_series import along, long_rolling_corr, long_rolling_std, rolling_compound, rolling_std, strict_compound
from panelweave.plans.panels import SAMPLE, daily, is_financial, june_accounts, june_formation, link, monthly, monthly_accounts, quarters
from panelweave.operators.allocation import eigenrisk_concentration, risk_parity
from panelweave.operators.regression import rolling_residual
from panelweave.plans.queries_cross import _EDGE, rank_weights
from panelweave.plans.queries_panel import _BEQ, _LINKED, _PUBLIC, _RANGES, _SAMPLE, JUNE, june_sql
from panelweave.plans.queries_series import f24, t20
from panelweave.plans.registry import D, L, M, ORACLE, QUERIES, q_sql, query, r, rs
from panelweave.session import materialize, side_by_side, table

_BY = "PARTITION BY asset_id ORDER BY date"


def in_sample(d: DataFrame) -> DataFrame:
    return d.where(F.col("date").between(*[F.lit(x).cast("date") for x in SAMPLE]))


def exposure(d: DataFrame, x: Column, digits: int = 7) -> DataFrame:
    """(date, asset_id, exposure) of the sample, without missing values."""
    return in_sample(d.select("date", "asset_id", r(x, digits, "exposure"))).where("exposure is not null")


def _exp_sql(source: str, x: str, digits: int = 7) -> str:
    return f"SELECT date, asset_id, {rs(x, digits)} AS exposure FROM {source} WHERE ({x}) IS NOT NULL AND {_SAMPLE}"


def _price(name: str, doc: str, x: Callable[[WindowSpec], Column], sql: str, frame: str = "") -> None:
    """A signal of an asset's own months; x makes the expression once there is a session."""

    def f(spark: SparkSession, root: str) -> DataFrame:
        return exposure(monthly(spark, root), x(along("asset_id", "date")))

    f.__doc__ = doc
    query(name, f"WITH {M}, s AS (SELECT date, asset_id, {sql} AS v FROM m {frame}) {_exp_sql('s', 'v')}")(f)


_LN = "CASE WHEN 1 + ret > 0 THEN ln(1 + ret) END"
_roll = lambda first, last: f"WINDOW f AS ({_BY} ROWS BETWEEN {first} PRECEDING AND {last} PRECEDING)"


def _register_prices() -> None:
    _price("f01_size", "Minus log market equity (F01).", lambda w: -F.log(positive(F.col("market_equity"))), "CASE WHEN market_equity > 0 THEN -ln(market_equity) END")
    _price("f02_momentum", "Months 12 to 2 back, all present (F02).", lambda w: strict_compound("ret", w, 11, 2), "CASE WHEN count(ret) OVER f = 11 THEN CASE WHEN min(1 + ret) OVER f <= 0 THEN -1 ELSE product(1 + ret) OVER f - 1 END END", _roll(12, 2))
    _price("f03_reversal", "Minus last month's return (F03).", lambda w: -F.col("ret"), "-ret")
    _price("f04_long_reversal", "Minus the return of months 60 to 13 back, 36 of them enough (F04).", lambda w: -rolling_compound("ret", w, 48, 13, 36), f"CASE WHEN count({_LN}) OVER f >= 36 THEN -(exp(sum({_LN}) OVER f) - 1) END", _roll(60, 13))
    _price("f05_intermediate_momentum", "Months 12 to 7 back, five of them enough (F05).", lambda w: rolling_compound("ret", w, 6, 7, 5), f"CASE WHEN count({_LN}) OVER f >= 5 THEN exp(sum({_LN}) OVER f) - 1 END", _roll(12, 7))
    _price("f07_low_volatility", "Minus the deviation of twelve months, eight of them enough (F07).", lambda w: -rolling_std("ret", w, -11, 0, 8), "CASE WHEN count(ret) OVER f >= 8 THEN -stddev_samp(ret) OVER f END", f"WINDOW f AS ({_BY} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
    _price("f08_illiquidity", "Absolute return per million of dollar volume (F08).", lambda w: F.abs("ret") * 1e6 / positive(F.col("dollar_volume")), "CASE WHEN dollar_volume > 0 THEN abs(ret) * 1e6 / dollar_volume END")


@query("f09_low_max", f"WITH {D}, s AS (SELECT last_day(date) AS date, asset_id, CASE WHEN count(ret) >= 15 THEN -max(ret) END AS v FROM d GROUP BY ALL) {_exp_sql('s', 'v')}")
def f09(spark: SparkSession, root: str) -> DataFrame:
    """Minus the largest daily return of the month."""
    d = daily(spark, root).groupBy(F.last_day("date").alias("date"), "asset_id").agg(F.when(F.count("ret") >= 15, -F.max("ret")).alias("v"))
    return exposure(d, F.col("v"))


@query("f10_book_to_market", f"WITH {june_sql([])} SELECT rebalance_date AS date, asset_id, {rs('bm', 7)} AS exposure FROM jf")
def f10(spark: SparkSession, root: str) -> DataFrame:
    """Book to market of the June formation."""
    return june_formation(spark, root).select(F.col("rebalance_date").alias("date"), "asset_id", r("bm", 7, "exposure"))


def accounts_sql(cols: list[str], yoy: list[str]) -> str:
    y = "".join(f", CASE WHEN date_diff('day', lag(datadate, 4) OVER w, datadate) BETWEEN 330 AND 400 THEN lag({c}, 4) OVER w END AS yoy_{c}" for c in yoy)
    return f"""{M}, {L}, {q_sql(cols)}, y AS (SELECT *{y} FROM q WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)), {_LINKED.replace('FROM q JOIN', 'FROM y q JOIN')}, {_PUBLIC},
ac AS (SELECT s.date, s.asset_id, s.market_equity, pq.* EXCLUDE (asset_id) FROM (SELECT * FROM m WHERE {_SAMPLE} AND NOT coalesce(siccd BETWEEN 6000 AND 6999, FALSE)) s ASOF JOIN pq ON pq.asset_id = s.asset_id AND pq.available_date <= s.date WHERE date_diff('day', pq.datadate, s.date) <= 366)"""


_AT = "CASE WHEN atq > 0 THEN atq END"
#: name -> (docstring, columns, year-ago columns, SQL expression; the same text is read by Spark).
RATIOS = {
    "f11_earnings_yield": ("Net income of a year over market equity (F11).", ["net_income_q_ttm"], [], "net_income_q_ttm * 1000 / CASE WHEN market_equity > 0 THEN market_equity END"),
    "f12_gross_profit": ("Gross profit over assets (F12).", ["gross_profit_q_ttm", "atq"], [], f"gross_profit_q_ttm / {_AT}"),
    "f13_operating_profit": ("Operating profit over assets (F13).", ["oiadpq_ttm", "atq"], [], f"oiadpq_ttm / {_AT}"),
    "f14_roa": ("Net income over assets (F14).", ["net_income_q_ttm", "atq"], [], f"net_income_q_ttm / {_AT}"),
    "f15_asset_growth": ("Minus the growth of assets (F15).", ["atq"], ["atq"], "-(atq / CASE WHEN yoy_atq > 0 THEN yoy_atq END - 1)"),
    "f16_sales_growth": ("Growth of sales (F16).", ["saleq_ttm"], ["saleq_ttm"], "saleq_ttm / CASE WHEN yoy_saleq_ttm > 0 THEN yoy_saleq_ttm END - 1"),
    "f17_low_leverage": ("Minus debt over assets; missing debt is none (F17).", ["atq", "dlttq", "dlcq"], [], f"-((coalesce(dlttq, 0) + coalesce(dlcq, 0)) / {_AT})"),
    "f18_cash": ("Cash over assets (F18).", ["atq", "cheq"], [], f"cheq / {_AT}"),
    "f19_low_accruals": (
        "Minus balance-sheet accruals over average assets (F19).",
        ["atq", "actq", "cheq", "lctq", "dlcq", "dpq_ttm"],
        ["atq", "actq", "cheq", "lctq", "dlcq"],
        "-(((actq - yoy_actq) - (cheq - yoy_cheq) - ((lctq - yoy_lctq) - (coalesce(dlcq, 0) - coalesce(yoy_dlcq, 0))) - coalesce(dpq_ttm, 0)) / CASE WHEN (atq + yoy_atq) / 2 > 0 THEN (atq + yoy_atq) / 2 END)",
    ),
    "f20_low_capex": ("Minus capital expenditure over assets (F20).", ["atq", "capx_q_ttm"], [], f"-(capx_q_ttm / {_AT})"),
}


def _register_ratios() -> None:
    for name, (doc, cols, yoy, x) in RATIOS.items():

        def f(spark: SparkSession, root: str, cols: list[str] = cols, yoy: list[str] = yoy, x: str = x) -> DataFrame:
            a = monthly_accounts(spark, root, yoy, True, [*cols, *[f"yoy_{c}" for c in yoy]])
            return exposure(a, F.expr(x), 6)

        f.__doc__ = doc
        query(name, f"WITH {accounts_sql(cols, yoy)} {_exp_sql('ac', x, 6)}")(f)


_register_prices()
_register_ratios()

_RDQ = "rdq IS NOT NULL AND NOT coalesce(rdq_imputed, FALSE)"
_SUE = f"""{M}, {L}, {q_sql(['epspxq', 'ajexq'])}, a AS (SELECT *, epspxq / CASE WHEN ajexq > 0 THEN ajexq END AS eps FROM q WHERE {_RDQ}), u AS (SELECT *, eps - lag(eps, 4) OVER (PARTITION BY gvkey ORDER BY datadate) AS ue FROM a),
z AS (SELECT *, CASE WHEN count(ue) OVER f >= 4 THEN stddev_samp(ue) OVER f END AS sc FROM u WINDOW f AS (PARTITION BY gvkey ORDER BY datadate ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)), {_LINKED.replace('FROM q JOIN', 'FROM z q JOIN')},
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, available_date ORDER BY datadate DESC) AS k2 FROM lk) WHERE k2 = 1),
s AS (SELECT m.date, m.asset_id, o.ue / CASE WHEN o.sc > 1e-12 THEN o.sc END AS v FROM m ASOF JOIN o ON o.asset_id = m.asset_id AND o.available_date <= m.date WHERE m.date <= o.available_date + INTERVAL 6 MONTH)"""


@query("f21_sue", f"WITH {_SUE} {_exp_sql('s', 'v', 5)}")
def f21(spark: SparkSession, root: str) -> DataFrame:
    """Standardised unexpected earnings, carried six months."""
    w = along("gvkey", "datadate")
    q = quarters(spark, root).where("rdq is not null and not coalesce(rdq_imputed, false)").select("gvkey", "datadate", "available_date", (F.col("epspxq") / positive(F.col("ajexq"))).alias("eps"))
    q = q.withColumn("ue", F.col("eps") - F.lag("eps", 4).over(w))
    q = q.withColumn("sc", rolling_std("ue", w, -8, -1, 4))
    acc = link(spark, root, q, "datadate").select("asset_id", "available_date", "datadate", (F.col("ue") / F.when(F.col("sc") > 1e-12, F.col("sc"))).alias("v"))
    m = monthly(spark, root).select("date", "asset_id")
    out = asof_backward(m, acc, ["asset_id"], "date", "available_date", ["datadate"]).where(F.col("date") <= F.add_months("available_date", 6))
    return exposure(out, F.col("v"), 5)


def risk_free(spark: SparkSession, root: str) -> DataFrame:
    """(date, rf): last rate of the month as a decimal per month."""
    t = table(spark, root, "dgs1mo").select(F.last_day("observation_date").alias("date"), "observation_date", finite("dgs1mo").alias("v")).where("v is not null")
    return t.groupBy("date").agg((F.max_by("v", "observation_date") / 1200).alias("rf"))


_RF = "rf AS (SELECT last_day(observation_date) AS date, arg_max(dgs1mo, observation_date) / 1200 AS rf FROM dgs1mo WHERE dgs1mo IS NOT NULL AND isfinite(dgs1mo) GROUP BY ALL)"
_LAG = f"lm AS (SELECT *, lag(market_equity) OVER ({_BY}) AS lag_me, CASE WHEN month(date) >= 7 THEN year(date) ELSE year(date) - 1 END AS fyr FROM m)"


def lagged(spark: SparkSession, root: str) -> DataFrame:
    """Months with the market equity of the row before and the year of the June formation that holds."""
    m = monthly(spark, root).select("date", "asset_id", "ret", "market_equity", "exchange_code", "siccd")
    return m.withColumns({"lag_me": F.lag("market_equity").over(along("asset_id", "date")), "formation_year": formation_year("date")})


def two_by_three(source: str, c: str, lo: float = 0.3, hi: float = 0.7) -> str:
    return f"bk AS (SELECT rebalance_date, median(market_equity) AS s, quantile_cont({c}, {lo}) AS lo, quantile_cont({c}, {hi}) AS hi FROM {source} WHERE exchange_code = 1 GROUP BY ALL HAVING count(*) >= 3), gp AS (SELECT t.*, CASE WHEN market_equity <= s THEN 'S' ELSE 'B' END || CASE WHEN {c} <= lo THEN 'L' WHEN {c} > hi THEN 'H' ELSE 'M' END AS grp FROM {source} t JOIN bk USING (rebalance_date))"


_FF3 = f"""{june_sql([])}, {_RF}, {_LAG}, {two_by_three('jf', 'bm')},
gr AS (SELECT lm.date, grp, sum(lag_me * coalesce(ret, 0)) / sum(lag_me) AS ret FROM lm JOIN gp ON year(gp.rebalance_date) = lm.fyr AND gp.asset_id = lm.asset_id WHERE lag_me > 0 GROUP BY ALL),
mk AS (SELECT date, sum(ret * lag_me) / sum(lag_me) AS mkt FROM lm WHERE ret IS NOT NULL AND lag_me > 0 GROUP BY ALL),
f3 AS (SELECT g.date, avg(CASE WHEN grp IN ('SL', 'SM', 'SH') THEN g.ret END) - avg(CASE WHEN grp IN ('BL', 'BM', 'BH') THEN g.ret END) AS smb, avg(CASE WHEN grp IN ('SH', 'BH') THEN g.ret END) - avg(CASE WHEN grp IN ('SL', 'BL') THEN g.ret END) AS hml FROM gr g GROUP BY g.date),
ff AS (SELECT f3.date, mkt - coalesce(rf, 0) AS mkt_rf, smb, hml, coalesce(rf, 0) AS rf FROM f3 LEFT JOIN mk USING (date) LEFT JOIN rf USING (date))"""


def june_groups(spark: SparkSession, root: str) -> DataFrame:
    """(date, group, ret) of the June 2 x 3 sort on book to market; a member without a return counts 0."""
    g = size_buckets(materialize(june_formation(spark, root).select("rebalance_date", "asset_id", "market_equity", "exchange_code", "bm")), ["rebalance_date"], "bm").select(F.year("rebalance_date").cast("long").alias("formation_year"), "asset_id", "group")
    j = lagged(spark, root).where("lag_me > 0").join(g, ["formation_year", "asset_id"])
    return j.groupBy("date", "group").agg((F.sum(F.col("lag_me") * F.coalesce("ret", F.lit(0.0))) / F.sum("lag_me")).alias("ret"))


def three_factors(spark: SparkSession, root: str) -> DataFrame:
    """(date, mkt_rf, smb, hml, rf): groups of the June 2 x 3 sort, re-weighted monthly by lagged market equity."""
    lm, gr = lagged(spark, root), june_groups(spark, root)
    leg = lambda *names: F.avg(F.when(F.col("group").isin(*names), F.col("ret")))
    f3 = gr.groupBy("date").agg((leg("SL", "SM", "SH") - leg("BL", "BM", "BH")).alias("smb"), (leg("SH", "BH") - leg("SL", "BL")).alias("hml"))
    mk = value_weighted(lm, ["date"], "ret", "lag_me").select("date", F.col("ret").alias("mkt"))
    d = f3.join(mk, "date", "left").join(risk_free(spark, root), "date", "left")
    return d.select("date", (F.col("mkt") - F.coalesce("rf", F.lit(0.0))).alias("mkt_rf"), "smb", "hml", F.coalesce("rf", F.lit(0.0)).alias("rf"))


@query("f32_three_factors", f"WITH {_FF3} SELECT date, {rs('mkt_rf', 7)} AS mkt_rf, {rs('smb', 7)} AS smb, {rs('hml', 7)} AS hml, {rs('rf')} AS rf FROM ff")
def f32(spark: SparkSession, root: str) -> DataFrame:
    """Market, size and value."""
    return three_factors(spark, root).select("date", r("mkt_rf", 7), r("smb", 7), r("hml", 7), r("rf"))


def annual_factor(spark: SparkSession, root: str, x: str, lag_cols: list[str], name: str) -> DataFrame:
    a = june_accounts(spark, root, lag_cols)
    sic = monthly(spark, root).select(F.col("date").alias("rebalance_date"), "asset_id", "siccd")
    a = a.join(sic, ["rebalance_date", "asset_id"], "left").where(~is_financial("siccd")).withColumn("c", F.expr(x)).where("c is not null and exchange_code is not null")
    g = size_buckets(materialize(a.select("rebalance_date", "asset_id", "market_equity", "exchange_code", "c")), ["rebalance_date"], "c").select(F.year("rebalance_date").cast("long").alias("formation_year"), "asset_id", "group")
    groups = value_weighted(lagged(spark, root).join(g, ["formation_year", "asset_id"]), ["date", "group"], "ret", "lag_me")
    return high_minus_low(groups, name)


_ANNUAL = {
    "f28_rmw": ("Robust minus weak (F28).", "operating_profit_q_ttm / CASE WHEN book_equity > 0 THEN book_equity END", ["operating_profit_q_ttm"], []),
    "f29_cma": ("Conservative minus aggressive (F29).", "-(atq / CASE WHEN lag_atq > 0 THEN lag_atq END - 1)", ["atq"], ["atq"]),
    "f30_low_noa": (
        "Low net operating assets (F30).",
        "-(((atq - coalesce(cheq, 0)) - (atq - coalesce(dlcq, 0) - coalesce(dlttq, 0) - coalesce(mibq, 0) - coalesce(pstkq, 0) - coalesce(ceqq, 0))) / CASE WHEN lag_atq > 0 THEN lag_atq END)",
        ["atq", "cheq", "dlcq", "dlttq", "mibq", "pstkq", "ceqq"],
        ["atq"],
    ),
}
_LEGS = "hl AS (SELECT date, max(CASE WHEN grp = 'SH' THEN ret END) AS sh, max(CASE WHEN grp = 'BH' THEN ret END) AS bh, max(CASE WHEN grp = 'SL' THEN ret END) AS sl, max(CASE WHEN grp = 'BL' THEN ret END) AS bl FROM gr GROUP BY date)"
for _n, (_doc, _x, _cols, _lags) in _ANNUAL.items():

    def _annual(spark: SparkSession, root: str, x: str = _x, lags: list[str] = _lags) -> DataFrame:
        return annual_factor(spark, root, x, lags, "ret").select("date", r("ret", 7))

    _annual.__doc__ = _doc
    query(
        _n,
        f"""WITH {june_sql(_cols)}, {_LAG}, an AS (SELECT * FROM (SELECT jf.*, {_x} AS c FROM jf JOIN (SELECT * EXCLUDE (book_equity) FROM fy) f ON f.asset_id = jf.asset_id AND f.fyear = jf.be_year WHERE f.available_date <= jf.rebalance_date AND NOT coalesce(jf.siccd BETWEEN 6000 AND 6999, FALSE)) WHERE c IS NOT NULL AND exchange_code IS NOT NULL),
{two_by_three('an', 'c')}, gr AS (SELECT lm.date, grp, sum(lag_me * ret) / sum(lag_me) AS ret FROM lm JOIN gp ON year(gp.rebalance_date) = lm.fyr AND gp.asset_id = lm.asset_id WHERE lag_me > 0 AND ret IS NOT NULL GROUP BY ALL), {_LEGS}
SELECT date, {rs('(sh + bh) / 2 - (sl + bl) / 2', 7)} AS ret FROM hl WHERE sh + bh + sl + bl IS NOT NULL""",
    )(_annual)


_F_LAGS = ["atq", "net_income_q_ttm", "dlttq", "actq", "lctq", "gross_profit_q_ttm", "saleq_ttm", "cshoq", "ajexq"]


def f_score(spark: SparkSession, root: str) -> DataFrame:
    """(rebalance_date, asset_id, bm, exchange_code, f_score): nine binary signals; none where any input is missing."""
    a = june_accounts(spark, root, _F_LAGS)
    return a.select("rebalance_date", "asset_id", "bm", "exchange_code", F.expr(_SCORE).cast("long").alias("f_score"))


_pos = lambda c: f"(CASE WHEN {c} > 0 THEN {c} END)"
_roa, _lroa, _cfo = f"net_income_q_ttm / {_pos('lag_atq')}", f"lag_net_income_q_ttm / {_pos('lag_atq')}", f"oancfy / {_pos('lag_atq')}"
_PAIRS = [
    (_roa, ">", "0"), (_cfo, ">", "0"), (_roa, ">", _lroa), (_cfo, ">", _roa),
    (f"dlttq / {_pos('atq')}", "<", f"lag_dlttq / {_pos('lag_atq')}"), (f"actq / {_pos('lctq')}", ">", f"lag_actq / {_pos('lag_lctq')}"),
    ("cshoq * ajexq", "<=", "lag_cshoq * lag_ajexq"),
    ("gross_profit_q_ttm / (CASE WHEN saleq_ttm <> 0 THEN saleq_ttm END)", ">", "lag_gross_profit_q_ttm / (CASE WHEN lag_saleq_ttm <> 0 THEN lag_saleq_ttm END)"),
    (f"saleq_ttm / {_pos('atq')}", ">", f"lag_saleq_ttm / {_pos('lag_atq')}"),
]
_SCORE = " + ".join(f"CASE WHEN {a} {op} {b} THEN 1 WHEN NOT ({a} {op} {b}) THEN 0 END" for a, op, b in _PAIRS)
_FCOLS = sorted({*_F_LAGS, "oancfy"})
_F_SQL = f"""{june_sql(_FCOLS)}""".replace("lag(atq) OVER (PARTITION BY gvkey ORDER BY datadate) AS lag_atq", ", ".join(f"lag({c}) OVER (PARTITION BY gvkey ORDER BY datadate) AS lag_{c}" for c in _F_LAGS))


@query("f22_f_score", f"WITH {_F_SQL}, sc AS (SELECT jf.rebalance_date, jf.asset_id, jf.bm, jf.exchange_code, {_SCORE} AS f_score FROM jf JOIN (SELECT * EXCLUDE (book_equity) FROM fy) f ON f.asset_id = jf.asset_id AND f.fyear = jf.be_year WHERE f.available_date <= jf.rebalance_date), ct AS (SELECT rebalance_date, quantile_cont(bm, 0.8) AS cut FROM sc WHERE exchange_code = 1 GROUP BY ALL) SELECT rebalance_date AS date, asset_id, CAST(f_score AS BIGINT) AS f_score FROM sc JOIN ct USING (rebalance_date) WHERE bm >= cut - 1e-12 AND f_score IS NOT NULL")
def f22(spark: SparkSession, root: str) -> DataFrame:
    """Nine-signal score inside the top book-to-market quintile of exchange 1."""
    a = materialize(f_score(spark, root))
    ct = breakpoints(a, ["rebalance_date"], {"bm": ("bm", [0.8])}, F.col("exchange_code") == 1)
    return a.join(ct, "rebalance_date").where("bm >= bm_0 - 1e-12 and f_score is not null").select(F.col("rebalance_date").alias("date"), "asset_id", "f_score")


_CAR = f"""{M}, {D}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM d)), dl AS (SELECT *, lag(market_equity) OVER ({_BY}) AS lag_me FROM d),
mk AS (SELECT date, sum(ret * lag_me) / sum(lag_me) AS mkt FROM dl WHERE ret IS NOT NULL AND lag_me > 0 GROUP BY ALL), ab AS (SELECT asset_id, dl.date, ret - mkt AS ab, p FROM dl JOIN cal ON cal.date = dl.date LEFT JOIN mk ON mk.date = dl.date),
{L}, {q_sql(['atq'])}, qq AS (SELECT * FROM q WHERE {_RDQ} AND date_diff('day', datadate, rdq) BETWEEN 0 AND 180), {_LINKED.replace('FROM q JOIN', 'FROM qq q JOIN')},
e AS (SELECT lk.asset_id, lk.gvkey, lk.datadate, lk.rdq, (SELECT min(p) FROM cal WHERE cal.date >= lk.rdq) AS p FROM lk),
car AS (SELECT e.asset_id, e.gvkey, e.datadate, e.rdq, e.p, coalesce(sum(ab), 0) AS car, count(ab) AS n FROM e LEFT JOIN ab ON ab.asset_id = e.asset_id AND ab.p BETWEEN e.p - 2 AND e.p + 1 WHERE e.p >= 2 AND e.p + 2 < (SELECT count(*) FROM cal) GROUP BY ALL HAVING count(ab) >= 2),
ev AS (SELECT car.*, c2.date AS available_date FROM car JOIN cal c2 ON c2.p = car.p + 2)"""


def announcement_returns(spark: SparkSession, root: str) -> DataFrame:
    """(asset_id, gvkey, datadate, rdq, available_date, car, n): abnormal return of the four trading days around an announcement."""
    d = daily(spark, root).select("asset_id", "date", "ret", "market_equity")
    cal = materialize(calendar(d, "date"))
    days = cal.count()
    dl = d.withColumn("lag_me", F.lag("market_equity").over(along("asset_id", "date")))
    mk = value_weighted(dl, ["date"], "ret", "lag_me").select("date", F.col("ret").alias("mkt"))
    ab = dl.join(F.broadcast(mk), "date", "left").join(F.broadcast(cal), "date").select("asset_id", (F.col("ret") - F.col("mkt")).alias("ab"), F.col("position").alias("_at"))
    q = quarters(spark, root).where("rdq is not null and not coalesce(rdq_imputed, false)").where(F.datediff("rdq", "datadate").between(0, 180)).select("gvkey", "datadate", "available_date", "rdq")
    e = link(spark, root, q, "datadate").select("asset_id", "gvkey", "datadate", "rdq")
    e = next_in_calendar(e, cal, "rdq", "date").where((F.col("position") >= 2) & (F.col("position") + 2 < days))
    w = e.withColumn("_at", F.explode(F.sequence(F.col("position") - 2, F.col("position") + 1)))
    car = w.join(ab, ["asset_id", "_at"], "left").groupBy("asset_id", "gvkey", "datadate", "rdq", "position").agg(F.coalesce(F.sum("ab"), F.lit(0.0)).alias("car"), F.count("ab").alias("n")).where("n >= 2")
    after = F.broadcast(cal.select((F.col("position") - 2).alias("position"), F.col("date").alias("available_date")))
    return car.join(after, "position").select("asset_id", "gvkey", "datadate", "rdq", "available_date", "car", "n")


@query("a16_announcement_returns", f"WITH {_CAR} SELECT asset_id, gvkey, datadate, rdq, available_date, {rs('car')} AS car, n FROM ev")
def a16(spark: SparkSession, root: str) -> DataFrame:
    """Abnormal returns around announcements."""
    return announcement_returns(spark, root).select("asset_id", "gvkey", "datadate", "rdq", "available_date", r("car"), "n")


def drift_signal(spark: SparkSession, root: str) -> DataFrame:
    m = monthly(spark, root).select("date", "asset_id")
    out = asof_backward(m, announcement_returns(spark, root), ["asset_id"], "date", "available_date", ["datadate"])
    return in_sample(out.where(F.col("date") <= F.add_months("available_date", 6))).select("date", "asset_id", "car")


_PEAD = f"{_CAR}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, available_date ORDER BY datadate DESC) AS k2 FROM ev) WHERE k2 = 1), sg AS (SELECT m.date AS rebalance_date, m.asset_id, m.market_equity, m.exchange_code, o.car AS c FROM m ASOF JOIN o ON o.asset_id = m.asset_id AND o.available_date <= m.date WHERE m.date <= o.available_date + INTERVAL 6 MONTH AND m.{_SAMPLE} AND NOT coalesce(m.siccd BETWEEN 6000 AND 6999, FALSE) AND m.market_equity IS NOT NULL AND m.exchange_code IS NOT NULL)"


@query("f27_pead", f"WITH {_PEAD}, {two_by_three('sg', 'c', 0.2, 0.8)}, gr AS (SELECT m.date, grp, sum(m.ret * gp.market_equity) / sum(gp.market_equity) AS ret FROM gp JOIN m ON m.asset_id = gp.asset_id AND m.date = last_day(gp.rebalance_date + INTERVAL 1 MONTH) WHERE m.ret IS NOT NULL AND gp.market_equity > 0 GROUP BY ALL), {_LEGS} SELECT date, {rs('(sh + bh) / 2 - (sl + bl) / 2', 7)} AS ret FROM hl WHERE sh + bh + sl + bl IS NOT NULL")
def f27(spark: SparkSession, root: str) -> DataFrame:
    """Drift after announcements, 2 x 3 on 20/80 breakpoints."""
    m = monthly(spark, root)
    s = drift_signal(spark, root).join(m.select("date", "asset_id", "market_equity", "exchange_code", "siccd"), ["date", "asset_id"]).where(~is_financial("siccd")).where("car is not null and market_equity is not null and exchange_code is not null")
    g = size_buckets(materialize(s.withColumnRenamed("date", "rebalance_date")), ["rebalance_date"], "car", 0.2, 0.8)
    g = g.select(next_month_end("rebalance_date").alias("date"), "asset_id", "group", F.col("market_equity").alias("w"))
    return high_minus_low(value_weighted(g.join(m.select("date", "asset_id", "ret"), ["date", "asset_id"]), ["date", "group"], "ret", "w"), "ret").select("date", r("ret", 7))


@query("f34_industries", f"WITH {M}, {_LAG}, rg(lo, hi, industry, o) AS (VALUES {', '.join(f'({a}, {b}, {c!r}, {i})' for i, (a, b, c) in enumerate(_RANGES))}), x AS (SELECT asset_id, date, any_value(ret) AS ret, any_value(lag_me) AS lag_me, arg_max(industry, o) AS industry FROM lm JOIN rg ON CAST(trunc(siccd) AS BIGINT) BETWEEN lo AND hi WHERE ret IS NOT NULL AND lag_me > 0 GROUP BY ALL) SELECT date, industry, {rs('sum(ret * lag_me) / sum(lag_me)', 7)} AS ret FROM x GROUP BY ALL")
def f34(spark: SparkSession, root: str) -> DataFrame:
    """Industry portfolios."""
    ranges = spark.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate(_RANGES)], "lo int, hi int, industry string, o int")
    d = code_of_range(lagged(spark, root).where("siccd is not null"), ranges, "siccd", "lo", "hi", "industry", "o")
    return value_weighted(d, ["date", "industry"], "ret", "lag_me").select("date", "industry", r("ret", 7))


#: Days, and least days, of the correlation and of the deviations in a market beta.
BETA_DAYS = (1250, 750, 252, 120)


def market_beta(spark: SparkSession, root: str, days: tuple[int, int, int, int] = BETA_DAYS) -> DataFrame:
    """(date, asset_id, beta): correlation of overlapping three-day log returns over five years of days times the ratio of one-year deviations, at month ends."""
    d = daily(spark, root).select("asset_id", "date", "ret", "market_equity")
    w = along("asset_id", "date")
    d = d.withColumn("lag_me", F.coalesce(F.lag("market_equity").over(w), F.col("market_equity")))
    mk = value_weighted(d, ["date"], "ret", "lag_me").select("date", F.col("ret").alias("mkt"))
    n = d.select("date").distinct().groupBy(F.last_day("date").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    rf = n.join(risk_free(spark, root).withColumnRenamed("date", "_m"), "_m", "left").select("_m", (F.pow(1 + F.col("rf"), 1.0 / F.col("_n")) - 1).alias("rf"))
    j = d.join(F.broadcast(mk), "date", "left").withColumn("_m", F.last_day("date")).join(F.broadcast(rf), "_m", "left")
    lg = lambda c: F.log1p(F.greatest(F.col(c), F.lit(-0.999999))) - F.log1p("rf")
    j = j.select("asset_id", "date", F.when(F.col("ret").isNotNull(), lg("ret")).alias("s"), F.when(F.col("mkt").isNotNull(), lg("mkt")).alias("m"))
    f = w.rowsBetween(-2, 0)
    three = lambda c: F.when(F.count(c).over(f) == 3, F.sum(c).over(f))
    j = j.withColumns({"s3": three("s"), "m3": three("m")})
    j = long_rolling_corr(j, "asset_id", "date", "s3", "m3", days[0], days[1], "corr")
    j = long_rolling_std(long_rolling_std(j, "asset_id", "date", "s", days[2], days[3], "sd_s"), "asset_id", "date", "m", days[2], days[3], "sd_m")
    last = F.row_number().over(W.partitionBy("asset_id", F.last_day("date")).orderBy(F.desc("date")))
    return j.withColumn("_k", last).where("_k = 1").select(F.last_day("date").alias("date"), "asset_id", (F.col("corr") * F.col("sd_s") / F.when(F.col("sd_m") > 0, F.col("sd_m"))).alias("beta"))


_BETA = f"""{D}, {_RF}, l0 AS (SELECT *, coalesce(lag(market_equity) OVER ({_BY}), market_equity) AS lag_me FROM d), mk AS (SELECT date, sum(ret * lag_me) / sum(lag_me) AS mkt FROM l0 WHERE ret IS NOT NULL AND lag_me > 0 GROUP BY ALL),
nt AS (SELECT last_day(date) AS mo, count(DISTINCT date) AS n FROM d GROUP BY ALL), rd AS (SELECT mo, pow(1 + rf, 1.0::DOUBLE / n) - 1 AS rf FROM nt LEFT JOIN rf ON rf.date = mo),
j AS (SELECT asset_id, l0.date, CASE WHEN ret IS NOT NULL THEN ln(1 + greatest(ret, -0.999999)) - ln(1 + rd.rf) END AS s, CASE WHEN mkt IS NOT NULL THEN ln(1 + greatest(mkt, -0.999999)) - ln(1 + rd.rf) END AS m FROM l0 LEFT JOIN mk ON mk.date = l0.date LEFT JOIN rd ON rd.mo = last_day(l0.date)),
j3 AS (SELECT *, CASE WHEN count(s) OVER f = 3 THEN sum(s) OVER f END AS s3, CASE WHEN count(m) OVER f = 3 THEN sum(m) OVER f END AS m3 FROM j WINDOW f AS ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
j4 AS (SELECT *, CASE WHEN s3 IS NOT NULL AND m3 IS NOT NULL THEN s3 END AS a, CASE WHEN s3 IS NOT NULL AND m3 IS NOT NULL THEN m3 END AS b FROM j3),
j5 AS (SELECT asset_id, date, CASE WHEN count(a) OVER g >= 750 THEN covar_pop(a, b) OVER g / nullif(stddev_pop(a) OVER g * stddev_pop(b) OVER g, 0) END AS c, CASE WHEN count(s) OVER h >= 120 THEN stddev_samp(s) OVER h END AS ss, CASE WHEN count(m) OVER h >= 120 THEN stddev_samp(m) OVER h END AS sm
  FROM j4 WINDOW g AS ({_BY} ROWS BETWEEN 1249 PRECEDING AND CURRENT ROW), h AS ({_BY} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
be AS (SELECT last_day(date) AS date, asset_id, c * ss / nullif(sm, 0) AS beta FROM j5 QUALIFY row_number() OVER (PARTITION BY asset_id, last_day(date) ORDER BY j5.date DESC) = 1)"""


@query("t14_market_beta", f"WITH {_BETA} SELECT date, asset_id, {rs('beta', 5)} AS beta FROM be WHERE beta IS NOT NULL")
def t14(spark: SparkSession, root: str) -> DataFrame:
    """Market beta at month ends."""
    return market_beta(spark, root).where("beta is not null").select("date", "asset_id", r("beta", 5))


def low_beta(spark: SparkSession, root: str, least: int = 10, days: tuple[int, int, int, int] = BETA_DAYS) -> DataFrame:
    """(date, low_ret, high_ret, beta_low, beta_high, bab): rank weights on shrunk betas; missing returns get no weight back."""
    m = monthly(spark, root)
    b = market_beta(spark, root, days).where("beta is not null").withColumn("sb", 0.6 * F.col("beta") + 0.4).join(m.select("date", "asset_id"), ["date", "asset_id"])
    k = rank_weights(materialize(b), "sb")
    t = k.groupBy("date").agg(F.sum(F.col("w_low") * F.col("sb")).alias("beta_low"), F.sum(F.col("w_high") * F.col("sb")).alias("beta_high"))
    k = k.join(t, "date").select(next_month_end("date").alias("date"), "asset_id", "w_low", "w_high", "beta_low", "beta_high")
    j = k.join(m.select("date", "asset_id", "ret"), ["date", "asset_id"]).where("ret is not null")
    g = j.groupBy("date", "beta_low", "beta_high").agg(F.sum(F.col("w_low") * F.col("ret")).alias("low_ret"), F.sum(F.col("w_high") * F.col("ret")).alias("high_ret"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    g = g.join(risk_free(spark, root), "date", "left")
    return g.withColumn("bab", (F.col("low_ret") - F.col("rf")) / F.when(F.col("beta_low") != 0, F.col("beta_low")) - (F.col("high_ret") - F.col("rf")) / F.when(F.col("beta_high") != 0, F.col("beta_high")))


_BAB = f"""{M}, {_BETA}, b0 AS (SELECT be.date, be.asset_id, 0.6::DOUBLE * beta + 0.4::DOUBLE AS sb FROM be JOIN m ON m.date = be.date AND m.asset_id = be.asset_id WHERE beta IS NOT NULL),
k AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY sb) + (count(*) OVER (PARTITION BY date, sb) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS p FROM b0), z AS (SELECT *, p - avg(p) OVER (PARTITION BY date) AS z FROM k),
w AS (SELECT *, greatest(z, 0) / nullif(sum(greatest(z, 0)) OVER (PARTITION BY date), 0) AS wh, greatest(-z, 0) / nullif(sum(greatest(-z, 0)) OVER (PARTITION BY date), 0) AS wl FROM z),
t AS (SELECT *, sum(wl * sb) OVER (PARTITION BY date) AS bl, sum(wh * sb) OVER (PARTITION BY date) AS bh FROM w),
g AS (SELECT m.date, bl, bh, sum(wl * m.ret) AS lo, sum(wh * m.ret) AS hi FROM t JOIN m ON m.asset_id = t.asset_id AND m.date = last_day(t.date + INTERVAL 1 MONTH) WHERE m.ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)"""


_BAB_OUT = f"SELECT g.date, {rs('lo', 7)} AS low_ret, {rs('hi', 7)} AS high_ret, {rs('bl', 5)} AS beta_low, {rs('bh', 5)} AS beta_high, {rs('(lo - rf) / nullif(bl, 0) - (hi - rf) / nullif(bh, 0)', 4)} AS bab FROM g LEFT JOIN rf ON rf.date = g.date"


def _bab_columns(d: DataFrame) -> DataFrame:
    return d.select("date", r("low_ret", 7), r("high_ret", 7), r("beta_low", 5), r("beta_high", 5), r("bab", 4))


@query("f31_low_beta", f"WITH {_BAB} {_BAB_OUT}")
def f31(spark: SparkSession, root: str) -> DataFrame:
    """Betting against beta."""
    return _bab_columns(low_beta(spark, root))


#: Windows short enough for tables of few days, and the SQL with them.
_SHORT = (60, 30, 40, 20)
_BAB_SHORT = _BAB.replace("1249 PRECEDING", "59 PRECEDING").replace(">= 750", ">= 30").replace("251 PRECEDING", "39 PRECEDING").replace(">= 120", ">= 20").replace("count(*) >= 10)", "count(*) >= 3)")


@query("f31_short_windows", f"WITH {_BAB_SHORT} {_BAB_OUT}")
def f31_short(spark: SparkSession, root: str) -> DataFrame:
    """The same over 60 days with three assets enough, so that small tables have months to compare."""
    return _bab_columns(low_beta(spark, root, 3, _SHORT))


def q_factors(spark: SparkSession, root: str) -> DataFrame:
    """(date, r_me, r_ia, r_roe) of the 2 x 3 x 3 sort: size and investment in June, profitability monthly."""
    a = june_accounts(spark, root, ["atq"])
    sic = monthly(spark, root).select(F.col("date").alias("rebalance_date"), "asset_id", "siccd")
    a = a.join(sic, ["rebalance_date", "asset_id"], "left").where(~is_financial("siccd")).withColumn("inv", F.col("atq") / positive(F.col("lag_atq")) - 1).where("inv is not null and exchange_code is not null")
    a = size_buckets(materialize(a.select("rebalance_date", "asset_id", "market_equity", "exchange_code", "inv")), ["rebalance_date"], "inv", min_reference=1).select(F.year("rebalance_date").cast("long").alias("formation_year"), "asset_id", "size_bucket", F.col("characteristic_bucket").alias("inv_bucket"))
    w = along("gvkey", "datadate")
    q = quarters(spark, root).select("gvkey", "datadate", "available_date", "rdq", "rdq_imputed", "ibq", F.lag("book_equity").over(w).alias("lbe"), F.datediff("datadate", F.lag("datadate").over(w)).alias("gap"))
    q = q.where("rdq is not null and not coalesce(rdq_imputed, false)").select("gvkey", "datadate", "available_date", (F.col("ibq") / F.when(F.col("gap").between(60, 130), positive(F.col("lbe")))).alias("roe"))
    q = link(spark, root, q, "datadate").select("asset_id", "available_date", "datadate", "roe")
    m = monthly(spark, root)
    f = asof_backward(in_sample(m.select("date", "asset_id", "market_equity", "exchange_code")), q, ["asset_id"], "date", "available_date", ["datadate"]).where(F.datediff("date", "datadate") <= 180)
    f = materialize(f.withColumn("formation_year", formation_year("date")).join(a, ["formation_year", "asset_id"]).where("roe is not null"))
    b = breakpoints(f, ["date"], {"r": ("roe", [0.3, 0.7])}, F.col("exchange_code") == 1)
    f = f.join(b, "date").withColumn("roe_bucket", F.when(F.col("roe") <= F.col("r_0"), "L").when(F.col("roe") > F.col("r_1"), "H").otherwise("M"))
    f = f.select(next_month_end("date").alias("date"), "asset_id", "size_bucket", "inv_bucket", "roe_bucket", F.col("market_equity").alias("w"))
    g = value_weighted(f.join(m.select("date", "asset_id", "ret"), ["date", "asset_id"]), ["date", "size_bucket", "inv_bucket", "roe_bucket"], "ret", "w")
    leg = lambda c, x: F.avg(F.when(F.col(c) == x, F.col("ret")))
    return g.groupBy("date").agg((leg("size_bucket", "S") - leg("size_bucket", "B")).alias("r_me"), (leg("inv_bucket", "L") - leg("inv_bucket", "H")).alias("r_ia"), (leg("roe_bucket", "H") - leg("roe_bucket", "L")).alias("r_roe"))


_QF = f"""{june_sql(['ibq'])}, an AS (SELECT * FROM (SELECT jf.*, f.atq / CASE WHEN f.lag_atq > 0 THEN f.lag_atq END - 1 AS inv FROM jf JOIN (SELECT * EXCLUDE (book_equity) FROM fy) f ON f.asset_id = jf.asset_id AND f.fyear = jf.be_year WHERE f.available_date <= jf.rebalance_date AND NOT coalesce(jf.siccd BETWEEN 6000 AND 6999, FALSE)) WHERE inv IS NOT NULL AND exchange_code IS NOT NULL),
{two_by_three('an', 'inv').replace('>= 3', '>= 1')},
zq AS (SELECT *, CASE WHEN date_diff('day', lag(datadate) OVER w, datadate) BETWEEN 60 AND 130 AND lag(book_equity) OVER w > 0 THEN ibq / lag(book_equity) OVER w END AS roe FROM q WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)), z2 AS (SELECT * FROM zq WHERE {_RDQ}), {_LINKED.replace('FROM q JOIN', 'FROM z2 q JOIN')},
o AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY asset_id, available_date ORDER BY datadate DESC) = 1),
fm AS (SELECT s.*, o.roe, o.datadate FROM (SELECT date, asset_id, market_equity, exchange_code, CASE WHEN month(date) >= 7 THEN year(date) ELSE year(date) - 1 END AS fyr FROM m WHERE {_SAMPLE}) s ASOF JOIN o ON o.asset_id = s.asset_id AND o.available_date <= s.date WHERE date_diff('day', o.datadate, s.date) <= 180),
f2 AS (SELECT fm.*, left(grp, 1) AS sb, right(grp, 1) AS ib FROM fm JOIN gp ON year(gp.rebalance_date) = fyr AND gp.asset_id = fm.asset_id WHERE roe IS NOT NULL),
rb AS (SELECT date, quantile_cont(roe, 0.3) AS lo, quantile_cont(roe, 0.7) AS hi FROM f2 WHERE exchange_code = 1 GROUP BY ALL),
f3 AS (SELECT f2.*, CASE WHEN roe <= lo THEN 'L' WHEN roe > hi THEN 'H' ELSE 'M' END AS pb FROM f2 JOIN rb USING (date)),
gr AS (SELECT m.date, sb, ib, pb, sum(m.ret * f3.market_equity) / sum(f3.market_equity) AS ret FROM f3 JOIN m ON m.asset_id = f3.asset_id AND m.date = last_day(f3.date + INTERVAL 1 MONTH) WHERE m.ret IS NOT NULL AND f3.market_equity > 0 GROUP BY ALL)"""


@query(
    "f33_q_factors",
    f"WITH {_QF} SELECT date, {rs(chr(39).join(['avg(CASE WHEN sb = ', 'S', ' THEN ret END) - avg(CASE WHEN sb = ', 'B', ' THEN ret END)']), 7)} AS r_me, {rs(chr(39).join(['avg(CASE WHEN ib = ', 'L', ' THEN ret END) - avg(CASE WHEN ib = ', 'H', ' THEN ret END)']), 7)} AS r_ia, {rs(chr(39).join(['avg(CASE WHEN pb = ', 'H', ' THEN ret END) - avg(CASE WHEN pb = ', 'L', ' THEN ret END)']), 7)} AS r_roe FROM gr GROUP BY date",
)
def f33(spark: SparkSession, root: str) -> DataFrame:
    """Size, investment and profitability factors."""
    return q_factors(spark, root).select("date", r("r_me", 7), r("r_ia", 7), r("r_roe", 7))


def bucket_returns(signals: DataFrame, returns: DataFrame, k: int = 10, min_count: int | None = None) -> DataFrame:
    """(date, factor, portfolio, ret) of signals (factor, date, asset_id, exposure) in one plan: value-weighted buckets and the top against the bottom one, held to the next signal date.

    returns: (date, asset_id, ret, market_equity). All signals must have the same rebalance dates.
    """
    s = signals.join(returns.select("date", "asset_id", "market_equity"), ["date", "asset_id"])
    c = leg_weights(bucket_codes(s, ["factor", "date"], "exposure", k, ["asset_id"], min_count=min_count).where("code is not null"), ["factor", "date", "code"], "market_equity")
    name = lambda p: F.concat(F.col("factor"), F.lit(":"), p)
    book = materialize(c.select(F.col("date").alias("rebalance_date"), "factor", "code", F.concat(F.lit("D"), F.lpad((F.col("code") + 1).cast("string"), 2, "0")).alias("p"), "asset_id", "weight"))
    side = F.when(F.col("code") == k - 1, 1).when(F.col("code") == 0, -1)
    hl = spread(book.withColumn("side", side), ["factor", "rebalance_date"], "side", "HL").select("rebalance_date", name(F.lit("HL")).alias("portfolio"), "asset_id", "weight")
    whole = book.select("rebalance_date", name(F.col("p")).alias("portfolio"), "asset_id", "weight").unionByName(hl)
    out = simulate_fixed(whole, returns.select("date", "asset_id", "ret"))
    return out.select("date", F.substring_index("portfolio", ":", 1).alias("factor"), F.substring_index("portfolio", ":", -1).alias("portfolio"), "ret")


_ASSETS = {
    "size": ("m", "CASE WHEN market_equity > 0 THEN -ln(market_equity) END", "", 7),
    "momentum": ("m", "CASE WHEN count(ret) OVER f = 11 THEN CASE WHEN min(1 + ret) OVER f <= 0 THEN -1 ELSE product(1 + ret) OVER f - 1 END END", _roll(12, 2), 7),
    "low_vol": ("m", "CASE WHEN count(ret) OVER f >= 8 THEN -stddev_samp(ret) OVER f END", f"WINDOW f AS ({_BY} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", 7),
    "gross_profit": ("ac", RATIOS["f12_gross_profit"][3], "", 6),
    "asset_growth": ("ac", RATIOS["f15_asset_growth"][3], "", 6),
    "value": ("(SELECT rebalance_date AS date, asset_id, bm FROM jf)", "bm", "", 7),
}


def deciles_sql(name: str, source: str, x: str, frame: str, digits: int) -> tuple[str, str]:
    """Tables and query of the ten value-weighted portfolios of a signal. Monthly signals rebalance on all of their dates together, as one book does."""
    n = name
    dates = "w_value" if n == "value" else "wm"
    parts = f"""e_{n} AS (SELECT date, asset_id, {rs('v', digits)} AS x FROM (SELECT date, asset_id, {x} AS v FROM {source} {frame}) WHERE v IS NOT NULL AND {_SAMPLE}),
k_{n} AS (SELECT e.*, m.market_equity, row_number() OVER (PARTITION BY e.date ORDER BY e.x, e.asset_id) AS rk, count(*) OVER (PARTITION BY e.date) AS n FROM e_{n} e JOIN m ON m.date = e.date AND m.asset_id = e.asset_id),
c_{n} AS (SELECT *, CASE WHEN n >= 10 THEN (SELECT count(*) FROM (SELECT unnest({[share(j, 10) for j in range(1, 10)]}::DOUBLE[]) AS p) WHERE rk > {_EDGE}) END AS code FROM k_{n}),
w_{n} AS (SELECT date AS rd, asset_id, code, market_equity / sum(market_equity) OVER (PARTITION BY date, code) AS w FROM c_{n} WHERE code IS NOT NULL AND market_equity > 0)"""
    held = f"(SELECT t.date, r.rd FROM (SELECT DISTINCT date FROM m) t ASOF JOIN (SELECT DISTINCT rd FROM {dates}) r ON t.date > r.rd)"
    return parts, f"SELECT p.date, '{n}:D' || lpad(CAST(code + 1 AS VARCHAR), 2, '0') AS portfolio, {rs('sum(w * m.ret)', 7)} AS ret FROM w_{n} w JOIN {held} p USING (rd) JOIN m ON m.date = p.date AND m.asset_id = w.asset_id WHERE m.ret IS NOT NULL GROUP BY ALL"


_DEC = [deciles_sql(n, *x) for n, x in _ASSETS.items()]
_WM = "wm AS (" + " UNION ".join(f"SELECT rd FROM w_{n}" for n in _ASSETS if n != "value") + ")"


def signals_of(d: DataFrame, columns: dict[str, Column], digits: int) -> DataFrame:
    """(factor, date, asset_id, exposure) of several signals of one table, in one pass."""
    wide = in_sample(d.select("date", "asset_id", *[r(x, digits, n) for n, x in columns.items()]))
    return wide.unpivot(["date", "asset_id"], list(columns), "factor", "exposure").where("exposure is not null")


def test_assets(spark: SparkSession, root: str) -> DataFrame:
    """(date, factor, portfolio, ret): ten portfolios on each of size, value, momentum, volatility, gross profitability and asset growth."""
    m = monthly(spark, root)
    w = along("asset_id", "date")
    price = signals_of(m, {"size": -F.log(positive(F.col("market_equity"))), "momentum": strict_compound("ret", w, 11, 2), "low_vol": -rolling_std("ret", w, -11, 0, 8)}, 7)
    a = monthly_accounts(spark, root, ["atq"], True, ["gross_profit_q_ttm", "atq", "yoy_atq"])
    ratio = signals_of(a, {"gross_profit": F.expr(RATIOS["f12_gross_profit"][3]), "asset_growth": F.expr(RATIOS["f15_asset_growth"][3])}, 6)
    value = in_sample(june_formation(spark, root).select(F.lit("value").alias("factor"), F.col("rebalance_date").alias("date"), "asset_id", r("bm", 7, "exposure")))
    returns = m.select("date", "asset_id", "ret", "market_equity")
    return bucket_returns(price.unionByName(ratio), returns).unionByName(bucket_returns(value, returns)).where("portfolio <> 'HL'")


@query("f36_test_assets", f"WITH {accounts_sql(['gross_profit_q_ttm', 'atq', 'book_equity'], ['atq'])}, {_BEQ}, {JUNE}, {', '.join(a for a, _ in _DEC)}, {_WM} {' UNION ALL '.join(b for _, b in _DEC)}")
def f36(spark: SparkSession, root: str) -> DataFrame:
    """Ten portfolios on each of six characteristics."""
    return test_assets(spark, root).select("date", F.concat_ws(":", "factor", "portfolio").alias("portfolio"), r("ret", 7))


_FS_PAIR = "sum(CASE WHEN f_score >= 8 THEN ret END) / count(CASE WHEN f_score >= 8 THEN ret END) - sum(CASE WHEN f_score <= 1 THEN ret END) / count(CASE WHEN f_score <= 1 THEN ret END)"


def f_score_returns(spark: SparkSession, root: str, high: int = 8, low: int = 1) -> DataFrame:
    """(date, ret): scores of `high` and more against `low` and less among the value stocks of June, equal weights, July to June."""
    g = f22(spark, root).select(F.year("date").cast("long").alias("formation_year"), "asset_id", "f_score")
    j = lagged(spark, root).where("ret is not null").join(g, ["formation_year", "asset_id"])
    mean = lambda ok: F.avg(F.when(ok, F.col("ret")))
    return j.groupBy("date").agg((mean(F.col("f_score") >= high) - mean(F.col("f_score") <= low)).alias("ret")).where("ret is not null")


@query("f22_f_score_returns", f"{ORACLE['f22_f_score'].replace('SELECT rebalance_date AS date, asset_id, CAST', ', fs AS (SELECT rebalance_date AS date, asset_id, CAST')}), {_LAG} SELECT lm.date, {rs('avg(CASE WHEN f_score >= 5 THEN ret END) - avg(CASE WHEN f_score <= 4 THEN ret END)', 7)} AS ret FROM lm JOIN fs ON year(fs.date) = lm.fyr AND fs.asset_id = lm.asset_id WHERE ret IS NOT NULL GROUP BY lm.date HAVING count(CASE WHEN f_score >= 5 THEN 1 END) > 0 AND count(CASE WHEN f_score <= 4 THEN 1 END) > 0")
def f22_returns(spark: SparkSession, root: str) -> DataFrame:
    """Returns of high against low scores (F22), split at five, so that small tables have both sides."""
    return f_score_returns(spark, root, 5, 4).select("date", r("ret", 7))


def monthly_signals(spark: SparkSession, root: str) -> DataFrame:
    """(factor, date, asset_id, exposure) of every registered signal that is formed monthly."""
    m = monthly(spark, root)
    w = along("asset_id", "date")
    price = signals_of(
        m,
        {
            "size": -F.log(positive(F.col("market_equity"))),
            "momentum": strict_compound("ret", w, 11, 2),
            "reversal": -F.col("ret"),
            "long_reversal": -rolling_compound("ret", w, 48, 13, 36),
            "intermediate_momentum": rolling_compound("ret", w, 6, 7, 5),
            "low_volatility": -rolling_std("ret", w, -11, 0, 8),
            "illiquidity": F.abs("ret") * 1e6 / positive(F.col("dollar_volume")),
        },
        7,
    )
    cols, yoy = sorted({c for _, cs, _, _ in RATIOS.values() for c in cs}), sorted({c for _, _, ys, _ in RATIOS.values() for c in ys})
    ratio = signals_of(monthly_accounts(spark, root, yoy, True, [*cols, *[f"yoy_{c}" for c in yoy]]), {n.split("_", 1)[1]: F.expr(x) for n, (_, _, _, x) in RATIOS.items()}, 6)
    out = price.unionByName(ratio)
    for name, f in {"low_max": f09, "sue": f21, "low_issuance": t20, "residual_momentum": f06}.items():
        out = out.unionByName(f(spark, root).select(F.lit(name).alias("factor"), "date", "asset_id", "exposure"))
    return out


def traded_series(spark: SparkSession, root: str) -> DataFrame:
    """(date, factor, ret) of the factors that bring returns of their own: three and q factors, earnings drift, profitability, investment, operating assets, score, beta."""
    out = None
    for x in side_by_side(_traded(spark, root)):
        out = x if out is None else out.unionByName(x)
    return out


def _traded(spark: SparkSession, root: str) -> list[Callable[[], DataFrame]]:
    tall = lambda d, names: d.unpivot(["date"], names, "factor", "ret")
    own = {"pead": f27, "f_score": f_score_returns, **{n.split("_", 1)[1]: QUERIES[n] for n in _ANNUAL}}
    named = [lambda name=name, f=f: f(spark, root).select("date", F.lit(name).alias("factor"), "ret") for name, f in own.items()]
    three = lambda: tall(three_factors(spark, root).select("date", "mkt_rf", "smb", "hml"), ["mkt_rf", "smb", "hml"])
    q = lambda: tall(q_factors(spark, root), ["r_me", "r_ia", "r_roe"])
    beta = lambda: low_beta(spark, root).select("date", F.lit("low_beta").alias("factor"), F.col("bab").alias("ret"))
    return [beta, q, three, *named]


def factor_universe(spark: SparkSession, root: str, least: int = 120) -> DataFrame:
    """(date, factor, ret): one monthly series of every registered factor with at least `least` months.

    Factors with returns of their own come as these; all other signals as the spread of their deciles, in one book per rhythm:
    monthly, June, and weekly (held over days and compounded to months).
    """
    m = monthly(spark, root).select("date", "asset_id", "ret", "market_equity")
    spread_of = lambda signals, returns: bucket_returns(signals, returns).where("portfolio = 'HL'").select("date", "factor", "ret")

    def value() -> DataFrame:
        return spread_of(june_formation(spark, root).select(F.lit("value").alias("factor"), F.col("rebalance_date").alias("date"), "asset_id", F.col("bm").alias("exposure")), m)

    def weekly() -> DataFrame:
        signals = f24(spark, root).unpivot(["date", "asset_id"], ["low_rsk", "rkt", "low_rsj"], "factor", "exposure").where("exposure is not null")
        days = spread_of(signals, daily(spark, root).select("date", "asset_id", "ret", "market_equity"))
        return days.groupBy(F.last_day("date").alias("date"), "factor").agg((F.product(F.col("ret") + 1) - 1).alias("ret"))

    out = None
    for x in side_by_side([lambda: spread_of(monthly_signals(spark, root), m), value, weekly, *_traded(spark, root)]):
        out = x.select("date", "factor", "ret") if out is None else out.unionByName(x)
    out = out.where("ret is not null")
    long_enough = out.groupBy("factor").count().where(F.col("count") >= least).select("factor")
    return out.join(F.broadcast(long_enough), "factor", "left_semi")  # one row per factor


_NAMES = {"f32_three_factors": ["mkt_rf", "smb", "hml"], "f33_q_factors": ["r_me", "r_ia", "r_roe"], "f27_pead": ["ret"], "f28_rmw": ["ret"], "f29_cma": ["ret"], "f30_low_noa": ["ret"]}
_TRADED = " UNION ALL ".join(f"SELECT date, '{n.split('_', 1)[1] if c == 'ret' else c}' AS factor, {rs(c, 5)} AS ret FROM ({ORACLE[n]}) WHERE {c} IS NOT NULL" for n, cs in _NAMES.items() for c in cs)


@query("f35_traded_series", _TRADED)
def f35_traded(spark: SparkSession, root: str) -> DataFrame:
    """Those factors of the universe that bring returns of their own, less the two with a query of their own beside it."""
    return traded_series(spark, root).where("factor not in ('f_score', 'low_beta') and ret is not null").select("date", "factor", r(r("ret", 7), 5, "ret"))


@query("f35_factor_universe")
def f35(spark: SparkSession, root: str) -> DataFrame:
    """Every registered factor in one table."""
    return factor_universe(spark, root).select("date", "factor", r("ret", 7))



# The SQL spells out each row's window and takes the regressors off one after the other.
_off = lambda x, cs: ", ".join(f"{c} - {x} * coalesce(sum({x} * {c}) OVER p / nullif(sum({x} * {x}) OVER p, 0), 0) AS {c}" for c in cs)
_RES = f"""d6 AS (SELECT m.asset_id, m.date, row_number() OVER (PARTITION BY m.asset_id ORDER BY m.date) AS i, m.ret - ff.rf AS y, mkt_rf AS x1, smb AS x2, hml AS x3 FROM m LEFT JOIN ff ON ff.date = m.date),
c6 AS (SELECT * FROM d6 WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL),
w0 AS (SELECT a.asset_id, a.i AS t0, b.i, b.y, b.x1, b.x2, b.x3 FROM c6 a JOIN c6 b ON b.asset_id = a.asset_id AND b.i BETWEEN a.i - 35 AND a.i),
w1 AS (SELECT asset_id, t0, i, count(*) OVER p AS n, {', '.join(f'{c} - avg({c}) OVER p AS {c}' for c in ('y', 'x1', 'x2', 'x3'))} FROM w0 WINDOW p AS (PARTITION BY asset_id, t0)),
w2 AS (SELECT asset_id, t0, i, n, {_off('x1', ['y', 'x2', 'x3'])} FROM w1 WINDOW p AS (PARTITION BY asset_id, t0)),
w3 AS (SELECT asset_id, t0, i, n, {_off('x2', ['y', 'x3'])} FROM w2 WINDOW p AS (PARTITION BY asset_id, t0)),
w4 AS (SELECT asset_id, t0, i, n, {_off('x3', ['y'])} FROM w3 WINDOW p AS (PARTITION BY asset_id, t0)),
r6 AS (SELECT d6.asset_id, d6.date, d6.i, w4.y AS res FROM d6 LEFT JOIN w4 ON w4.asset_id = d6.asset_id AND w4.t0 = d6.i AND w4.i = d6.i AND w4.n >= 24),
s6 AS (SELECT date, asset_id, avg(res) OVER f / CASE WHEN count(res) OVER f >= 8 AND stddev_samp(res) OVER f > 0 THEN stddev_samp(res) OVER f END AS v FROM r6 WINDOW f AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING))"""


@query("f06_residual_momentum", f"WITH {_FF3}, {_RES} {_exp_sql('s6', 'v', 5)}")
def f06(spark: SparkSession, root: str) -> DataFrame:
    """Mean over deviation of three-factor residuals, months 12 to 2 back."""
    m = monthly(spark, root).select("date", "asset_id", "ret")
    d = m.join(F.broadcast(materialize(three_factors(spark, root))), "date", "left").withColumn("excess", F.col("ret") - F.col("rf"))  # factors: one row per month
    w = along("asset_id", "date")
    d = rolling_residual(d, w, "excess", ["mkt_rf", "smb", "hml"], 36, 24, "res")
    f = w.rowsBetween(-12, -2)
    sd = rolling_std("res", w, -12, -2, 8)
    return exposure(d, F.avg("res").over(f) / F.when(sd > 0, sd), 5)


@query("m11_risk_parity")
def m11(spark: SparkSession, root: str) -> DataFrame:
    """Four allocation rules over all traded factors."""
    u = factor_universe(spark, root)
    return risk_parity(u)[0].select("date", "strategy", r("gross", 6), r("turnover", 4), r("cost", 6), r("ret", 6))


@query("a22_eigenrisk")
def a22(spark: SparkSession, root: str) -> DataFrame:
    """Concentration of risk over eigenvectors per rule."""
    return eigenrisk_concentration(risk_parity(factor_universe(spark, root))[2]).select("strategy", r("mean", 5), r("median", 5), r("max", 5))


def sdf_posterior(spark: SparkSession, root: str, draws: int = 3000, burn: int = 1000):  # noqa: ANN201
    """(factor names, test assets, posterior) of all traded factors against the industry portfolios; None where the tables are too short.

    Series of months are collected: factors and test assets are a few dozen columns by construction, whatever the panel. Industries with a
    month missing among the factors' common months are left out.
    """
    from panelweave.operators.allocation import prior_scale, spike_and_slab

    f = factor_universe(spark, root).toPandas().pivot(index="date", columns="factor", values="ret").dropna()
    a = f34(spark, root).toPandas().pivot(index="date", columns="industry", values="ret").reindex(f.index).dropna(axis=1)
    if a.shape[1] <= f.shape[1] or len(f) <= f.shape[1] + a.shape[1] + 12:
        return None
    x, y = f.to_numpy(), a.to_numpy()
    try:
        psi = prior_scale(x, y)
    except ValueError:
        psi = 1.0
    return list(f.columns), y, spike_and_slab(x, y, draws, burn, psi)


@query("m12_bayesian_sdf")
def m12(spark: SparkSession, root: str) -> DataFrame:
    """Inclusion probabilities and prices of the traded factors in a Bayesian discount factor."""
    schema = "factor string, inclusion double, price double, months long"
    got = sdf_posterior(spark, root)
    if got is None:
        return spark.createDataFrame([], schema)
    names, assets, p = got
    return spark.createDataFrame([(n, round(float(i), 6), round(float(x), 6), len(assets)) for n, i, x in zip(names, p.inclusion.mean(axis=0), p.price.mean(axis=0))], schema)


@query("v20_pricing_diagnostics")
def v20(spark: SparkSession, root: str) -> DataFrame:
    """Pricing errors of the averaged discount factor, model size and the difference of the chain's halves."""
    from panelweave.operators.allocation import pricing_diagnostics

    got = sdf_posterior(spark, root)
    rows = [] if got is None else [(k, round(v, 6)) for k, v in pricing_diagnostics(got[1], got[2]).items()]
    return spark.createDataFrame(rows, "name string, value double")


@query("e15_group_returns", f"WITH {_FF3} SELECT date, grp, {rs('ret', 7)} AS ret FROM gr")
def e15(spark: SparkSession, root: str) -> DataFrame:
    """Returns of the six June groups, re-weighted monthly by lagged market equity."""
    return june_groups(spark, root).select("date", F.col("group").alias("grp"), r("ret", 7))
