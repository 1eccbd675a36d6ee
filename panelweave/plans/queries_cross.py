"""Aggregations and cross-sectional operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.nulls import safe_div
from panelweave.operators.cross_section import average_ranks, bounds, bucket_codes, breakpoints, clip_outliers, cut, demean, fill_missing, moments, quantiles, share, size_buckets, winsorize, zscore
from panelweave.operators.portfolio import leg_weights, spread, value_weighted
from panelweave.operators.regression import group_ols, residuals
from panelweave.operators.rules import Missing, Neutralise, Outliers, Standardise, apply_rules
from panelweave.plans.panels import daily, monthly
from panelweave.plans.registry import D, M, query, r, rs

_QC = "quantile_cont({0}, {1})"
K = 10


def log_size(spark: SparkSession, root: str) -> DataFrame:
    """(date, asset_id, x = log market equity in millions, ret, exchange_code, market_equity, industry)."""
    m = monthly(spark, root)
    x = F.log(F.when(F.col("market_equity") > 0, F.col("market_equity") / 1000.0))
    return m.select("date", "asset_id", x.alias("x"), "ret", "exchange_code", "market_equity", F.floor(F.col("siccd") / 1000).cast("long").alias("industry"), "dollar_volume")


#: SQL side of log_size.
X = f"{M}, x AS (SELECT date, asset_id, CASE WHEN market_equity > 0 THEN ln(market_equity / 1000.0) END AS x, ret, exchange_code, market_equity, CAST(floor(siccd / 1000) AS BIGINT) AS industry, dollar_volume FROM m)"


@query("a02_quantiles", f"WITH {X} SELECT date, {rs(_QC.format('x', 0.05))} AS q05, {rs(_QC.format('x', 0.5))} AS q50, {rs(_QC.format('x', 0.95))} AS q95 FROM x GROUP BY date")
def a02(spark: SparkSession, root: str) -> DataFrame:
    """Exact quantiles per date."""
    return quantiles(log_size(spark, root), ["date"], "x", [0.05, 0.5, 0.95], ["q05", "q50", "q95"], bounded=True).select("date", r("q05"), r("q50"), r("q95"))


@query("a02_quantiles_split", f"WITH {X} SELECT exchange_code, {rs(_QC.format('x', 0.05))} AS q05, {rs(_QC.format('x', 0.5))} AS q50, {rs(_QC.format('x', 0.95))} AS q95 FROM x WHERE exchange_code IS NOT NULL GROUP BY ALL")
def a02_split(spark: SparkSession, root: str) -> DataFrame:
    """The same over very large groups, by the way that splits groups by value (A02 under skew)."""
    d = log_size(spark, root).where("exchange_code is not null")
    return quantiles(d, ["exchange_code"], "x", [0.05, 0.5, 0.95], ["q05", "q50", "q95"]).select("exchange_code", r("q05"), r("q50"), r("q95"))


@query("a04_moments", f"WITH {X} SELECT date, count(x) AS n, {rs('avg(x)')} AS mean, {rs('stddev_samp(x)')} AS std FROM x GROUP BY date")
def a04(spark: SparkSession, root: str) -> DataFrame:
    """Count, mean and deviation per date."""
    return moments(log_size(spark, root), ["date"], "x").select("date", "n", r("mean"), r("std"))


_BOUND_SQL = {
    "std": "SELECT date, avg(x) - 3 * stddev_samp(x) AS lo, avg(x) + 3 * stddev_samp(x) AS hi, stddev_samp(x) AS w FROM x GROUP BY date",
    "iqr": "SELECT date, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS w FROM (SELECT date, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY date)",
    "mad": "SELECT date, med - 3.5::DOUBLE * 1.4826 * mad AS lo, med + 3.5::DOUBLE * 1.4826 * mad AS hi, mad AS w FROM (SELECT date, any_value(med) AS med, median(abs(x - med)) AS mad FROM (SELECT *, median(x) OVER (PARTITION BY date) AS med FROM x) GROUP BY date)",
}
for _method, _sql in _BOUND_SQL.items():

    @query(f"a05_bounds_{_method}", f"WITH {X}, b AS ({_sql}) SELECT date, CASE WHEN w > 0 THEN {rs('lo', 7)} END AS lo, CASE WHEN w > 0 THEN {rs('hi', 7)} END AS hi FROM b")
    def _bounds(spark: SparkSession, root: str, method: str = _method) -> DataFrame:
        """Outlier limits per date."""
        return bounds(log_size(spark, root), ["date"], "x", method).select("date", r("lo", 7), r("hi", 7))


@query("a08_value_weighted", f"WITH {X} SELECT date, exchange_code, {rs('sum(ret * market_equity) / sum(market_equity)')} AS ret, count(*) AS n_assets FROM x WHERE ret IS NOT NULL AND market_equity > 0 GROUP BY ALL")
def a08(spark: SparkSession, root: str) -> DataFrame:
    """Value-weighted returns per date and group."""
    return value_weighted(log_size(spark, root), ["date", "exchange_code"], "ret", "market_equity").select("date", "exchange_code", r("ret"), "n_assets")


@query("a12_compound", f"WITH {D} SELECT asset_id, last_day(date) AS month_end, {rs('product(1 + ret) - 1', 7)} AS ret, count(*) AS n FROM d WHERE ret IS NOT NULL GROUP BY ALL")
def a12(spark: SparkSession, root: str) -> DataFrame:
    """Daily returns compounded to months."""
    d = daily(spark, root).where("ret is not null")
    return d.groupBy("asset_id", F.last_day("date").alias("month_end")).agg(F.product(F.col("ret") + 1).alias("g"), F.count(F.lit(1)).alias("n")).select("asset_id", "month_end", r(F.col("g") - 1, 7, "ret"), "n")


@query(
    "a13_security_months",
    f"""WITH {D} SELECT asset_id, last_day(date) AS month_end, {rs('coalesce(product(1 + ret), 1) - 1', 7)} AS ret, count(ret) AS n_ret, arg_max(market_equity, date) AS market_equity, max(date) AS last_trade_date, min(first_trade_date) AS first_trade_date,
CASE WHEN count(ret) >= 15 THEN max(ret) END AS max_return, {rs('avg(price * volume)', 2)} AS dollar_volume FROM d GROUP BY ALL""",
)
def a13(spark: SparkSession, root: str) -> DataFrame:
    """Security months from days: last values are the last known ones."""
    d = daily(spark, root)
    g = d.groupBy("asset_id", F.last_day("date").alias("month_end")).agg(
        F.product(F.col("ret") + 1).alias("g"), F.count("ret").alias("n_ret"), F.max_by("market_equity", F.when(F.col("market_equity").isNotNull(), F.col("date"))).alias("market_equity"), F.max("date").alias("last_trade_date"), F.min("first_trade_date").alias("first_trade_date"), F.max("ret").alias("x"), F.avg(F.col("price") * F.col("volume")).alias("dv")
    )
    return g.select("asset_id", "month_end", r(F.coalesce("g", F.lit(1.0)) - 1, 7, "ret"), "n_ret", "market_equity", "last_trade_date", "first_trade_date", F.when(F.col("n_ret") >= 15, F.col("x")).alias("max_return"), r("dv", 2, "dollar_volume"))


@query("a14_company", f"WITH {D} SELECT asset_id, date, {rs('sum(market_equity) OVER (PARTITION BY date, company_id)', 2)} AS company_me, coalesce(market_equity IS NOT NULL AND row_number() OVER (PARTITION BY date, company_id ORDER BY market_equity DESC NULLS LAST, asset_id) = 1, FALSE) AS is_primary FROM d WHERE company_id IS NOT NULL")
def a14(spark: SparkSession, root: str) -> DataFrame:
    """Company market equity and its primary share (A14). A company has few shares on a day; the hot company spreads over its days."""
    d = daily(spark, root).where("company_id is not null")
    w = W.partitionBy("date", "company_id")
    first = F.row_number().over(w.orderBy(F.desc_nulls_last("market_equity"), "asset_id")) == 1
    return d.select("asset_id", "date", r(F.sum("market_equity").over(w), 2, "company_me"), (F.col("market_equity").isNotNull() & first).alias("is_primary"))


@query("x04_clip_flag", f"WITH {X}, b AS ({_BOUND_SQL['mad']}) SELECT x.date, asset_id, {rs('CASE WHEN w > 0 THEN least(greatest(x, lo), hi) ELSE x END', 7)} AS x, coalesce(w > 0 AND (x < lo OR x > hi), FALSE) AS x_outlier FROM x LEFT JOIN b ON b.date = x.date WHERE x IS NOT NULL")
def x04(spark: SparkSession, root: str) -> DataFrame:
    """Values clipped at their date's limits, and flagged."""
    d = log_size(spark, root).where("x is not null").select("date", "asset_id", "x")
    return clip_outliers(d, ["date"], "x", "mad", "clip").select("date", "asset_id", r("x", 7), "x_outlier")


_Z = "w AS (SELECT x.*, least(greatest(x, lo), hi) AS wx FROM x JOIN (SELECT date, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM x GROUP BY date) USING (date))"


@query("x05_winsorize", f"WITH {X}, {_Z} SELECT date, asset_id, {rs('wx')} AS x FROM w WHERE x IS NOT NULL")
def x05(spark: SparkSession, root: str) -> DataFrame:
    """Winsorised at 1 and 99 per cent."""
    return winsorize(log_size(spark, root).where("x is not null").select("date", "asset_id", "x"), ["date"], "x").select("date", "asset_id", r("x"))


@query("x18_zscore", f"WITH {X}, {_Z}, s AS (SELECT date, avg(wx) AS a, stddev_samp(wx) AS s, count(wx) AS n FROM w WHERE x IS NOT NULL GROUP BY date) SELECT date, asset_id, CASE WHEN s > 1e-12 AND n >= 20 THEN {rs('(wx - a) / s', 7)} END AS x_z FROM w JOIN s USING (date) WHERE x IS NOT NULL")
def x18(spark: SparkSession, root: str) -> DataFrame:
    """Winsorised z-scores, from 20 values on."""
    d = winsorize(log_size(spark, root).where("x is not null").select("date", "asset_id", "x"), ["date"], "x")
    return zscore(d, ["date"], "x", "x_z", 20).select("date", "asset_id", r("x_z", 7))


@query("x07_fill_mean", f"WITH {X} SELECT date, asset_id, {rs('coalesce(ret, avg(ret) OVER (PARTITION BY date))')} AS ret, ret IS NULL AS ret_was_missing FROM x")
def x07_mean(spark: SparkSession, root: str) -> DataFrame:
    """Missing values by their date's mean."""
    return fill_missing(log_size(spark, root).select("date", "asset_id", "ret"), "ret", "mean", ["date"]).select("date", "asset_id", r("ret"), "ret_was_missing")


@query(
    "x07_ffill",
    f"WITH {X}, k AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date) AS n FROM x), f AS (SELECT *, max(CASE WHEN ret IS NOT NULL THEN n END) OVER (PARTITION BY asset_id ORDER BY n) AS s FROM k) SELECT a.date, a.asset_id, CASE WHEN a.n - a.s <= 2 THEN b.ret ELSE a.ret END AS ret FROM f a LEFT JOIN k b ON b.asset_id = a.asset_id AND b.n = a.s",
)
def x07_ffill(spark: SparkSession, root: str) -> DataFrame:
    """Carried along an asset's rows, two rows far at most."""
    return fill_missing(log_size(spark, root).select("date", "asset_id", "ret"), "ret", "ffill", ["asset_id"], "date", limit=2).select("date", "asset_id", "ret")


@query(
    "x07_universe",
    f"WITH {X}, u AS (SELECT *, coalesce(exchange_code = 1, FALSE) AS u FROM x), k AS (SELECT *, CASE WHEN u THEN ret END AS v, sum(u::INT) OVER (PARTITION BY asset_id ORDER BY date) AS n FROM u), f AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN n END) OVER (PARTITION BY asset_id ORDER BY date) AS s FROM k) SELECT f.date, f.asset_id, CASE WHEN f.u AND f.v IS NULL AND f.n - f.s <= 2 THEN b.v ELSE f.v END AS ret FROM f LEFT JOIN k b ON b.asset_id = f.asset_id AND b.n = f.s AND b.u",
)
def x07_universe(spark: SparkSession, root: str) -> DataFrame:
    """Carried within a universe: rows outside have no value, give none and are not counted."""
    d = log_size(spark, root).select("date", "asset_id", "ret", (F.col("exchange_code") == 1).alias("u"))
    return fill_missing(d, "ret", "ffill", ["asset_id"], "date", limit=2, universe="u").select("date", "asset_id", "ret")


@query("x07_universe_median", f"WITH {X}, u AS (SELECT date, asset_id, coalesce(exchange_code = 1, FALSE) AS u, CASE WHEN exchange_code = 1 THEN ret END AS v FROM x) SELECT date, asset_id, {rs('CASE WHEN u THEN coalesce(v, median(v) OVER (PARTITION BY date)) END')} AS ret FROM u")
def x07_universe_median(spark: SparkSession, root: str) -> DataFrame:
    """Medians of a universe, inside it."""
    d = log_size(spark, root).select("date", "asset_id", "ret", (F.col("exchange_code") == 1).alias("u"))
    return fill_missing(d, "ret", "median", ["date"], universe="u").select("date", "asset_id", r("ret"))


_POS = "(p * (n - 1))"
_EDGE = f"CASE WHEN {_POS} - floor({_POS}) >= 0.5 THEN floor({_POS}) + 2 - (1 - ({_POS} - floor({_POS}))) ELSE floor({_POS}) + 1 + ({_POS} - floor({_POS})) END"
_CODE = f"""k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, asset_id) AS rk, count(*) OVER (PARTITION BY date) AS n FROM x WHERE x IS NOT NULL),
c AS (SELECT *, CASE WHEN n >= {K} THEN CAST((SELECT count(*) FROM (SELECT unnest({[share(j, K) for j in range(1, K)]}::DOUBLE[]) AS p) WHERE rk > {_EDGE}) AS BIGINT) END AS code FROM k)"""


@query("x09_deciles", f"WITH {X}, {_CODE} SELECT date, asset_id, code FROM c WHERE code IS NOT NULL")
def x09(spark: SparkSession, root: str) -> DataFrame:
    """Equal-count buckets by first-come ranks."""
    d = log_size(spark, root).where("x is not null").select("date", "asset_id", "x")
    return bucket_codes(d, ["date"], "x", K, ["asset_id"]).where("code is not null").select("date", "asset_id", F.col("code").cast("long").alias("code"))


@query("x10_average_ranks", f"WITH {X} SELECT date, asset_id, rank() OVER (PARTITION BY date ORDER BY dollar_volume) + (count(*) OVER (PARTITION BY date, dollar_volume) - 1) / 2.0::DOUBLE AS rk FROM x WHERE dollar_volume IS NOT NULL")
def x10(spark: SparkSession, root: str) -> DataFrame:
    """Average ranks."""
    d = log_size(spark, root).where("dollar_volume is not null").select("date", "asset_id", "dollar_volume")
    return average_ranks(d, ["date"], "dollar_volume", "rk").select("date", "asset_id", "rk")


@query("x11_demean", f"WITH {X} SELECT date, asset_id, {rs('x - avg(x) OVER (PARTITION BY date, industry)', 7)} AS x FROM x WHERE x IS NOT NULL AND industry IS NOT NULL")
def x11(spark: SparkSession, root: str) -> DataFrame:
    """Less the mean of date and industry (X11)."""
    d = log_size(spark, root).where("x is not null and industry is not null").select("date", "asset_id", "industry", "x")
    return demean(d, ["date", "industry"], ["x"]).select("date", "asset_id", r("x", 7))


@query("x13_group_ols", f"WITH {X}, p AS (SELECT * FROM x WHERE ret IS NOT NULL AND x IS NOT NULL) SELECT date, count(*) AS n, {rs('regr_slope(ret, x)', 7)} AS beta, {rs('regr_intercept(ret, x)', 7)} AS alpha, {rs('regr_r2(ret, x)', 7)} AS r2 FROM p GROUP BY date HAVING count(*) >= 30")
def x13(spark: SparkSession, root: str) -> DataFrame:
    """Least squares per date."""
    f = group_ols(log_size(spark, root), ["date"], "ret", ["x"], min_obs=30)
    return f.select("date", "n", r("beta_x", 7, "beta"), r("alpha", 7), r("r2", 7))


@query("x12_residuals", f"WITH {X}, p AS (SELECT date, asset_id, ret - avg(ret) OVER (PARTITION BY date, industry) AS y, x - avg(x) OVER (PARTITION BY date, industry) AS x, count(*) OVER (PARTITION BY date) AS n FROM x WHERE ret IS NOT NULL AND x IS NOT NULL AND industry IS NOT NULL), b AS (SELECT date, sum(x * y) / sum(x * x) AS b FROM p GROUP BY date) SELECT date, asset_id, {rs('y - b * x', 7)} AS ret_neutral FROM p JOIN b USING (date) WHERE n >= 20")
def x12(spark: SparkSession, root: str) -> DataFrame:
    """Residuals on size with industries absorbed."""
    d = log_size(spark, root).select("date", "asset_id", "ret", "x", "industry")
    return residuals(d, ["date"], "ret", ["x"], "ret_neutral", category="industry").where("ret_neutral is not null").select("date", "asset_id", r("ret_neutral", 7))


_MULTI = f"""{X}, v AS (SELECT *, CASE WHEN dollar_volume > 0 THEN ln(dollar_volume) END AS lv FROM x), p0 AS (SELECT * FROM v WHERE ret IS NOT NULL AND x IS NOT NULL AND lv IS NOT NULL AND industry IS NOT NULL),
p AS (SELECT date, asset_id, ret - avg(ret) OVER w AS y, x - avg(x) OVER w AS x, lv - avg(lv) OVER w AS l, count(*) OVER (PARTITION BY date) AS n FROM p0 WINDOW w AS (PARTITION BY date, industry)),
b AS (SELECT date, (sum(l * l) * sum(x * y) - sum(x * l) * sum(l * y)) / nullif(sum(x * x) * sum(l * l) - sum(x * l) * sum(x * l), 0) AS b1, (sum(x * x) * sum(l * y) - sum(x * l) * sum(x * y)) / nullif(sum(x * x) * sum(l * l) - sum(x * l) * sum(x * l), 0) AS b2 FROM p WHERE n >= 20 GROUP BY date)"""


@query("x12_residuals_multi", f"WITH {_MULTI} SELECT date, asset_id, {rs('y - b1 * x - b2 * l', 6)} AS ret_neutral FROM p JOIN b USING (date) WHERE n >= 20")
def x12_multi(spark: SparkSession, root: str) -> DataFrame:
    """Residuals on two regressors and an absorbed category (X12, X13 with p > 1)."""
    d = log_size(spark, root).withColumn("lv", F.log(F.when(F.col("dollar_volume") > 0, F.col("dollar_volume"))))
    return residuals(d.select("date", "asset_id", "ret", "x", "lv", "industry"), ["date"], "ret", ["x", "lv"], "ret_neutral", category="industry").where("ret_neutral is not null").select("date", "asset_id", r("ret_neutral", 6))


# Two categories: effects of both, by the normal equations of a two-way table. The SQL repeats the two projections until they settle.
_SWEEPS = 60
_P0 = "p0 AS (SELECT date, asset_id, ret AS y, x, industry AS g, exchange_code AS h, count(*) OVER (PARTITION BY date) AS n FROM x WHERE ret IS NOT NULL AND x IS NOT NULL AND industry IS NOT NULL AND exchange_code IS NOT NULL)"
_TWO = ", ".join(f"s{i} AS (SELECT date, asset_id, g, h, n, y - avg(y) OVER a AS y, x - avg(x) OVER a AS x FROM (SELECT date, asset_id, g, h, n, y - avg(y) OVER b AS y, x - avg(x) OVER b AS x FROM {'p0' if i == 0 else f's{i - 1}'} WINDOW b AS (PARTITION BY date, g)) WINDOW a AS (PARTITION BY date, h))" for i in range(_SWEEPS))


@query("x12_two_categories", f"WITH {X}, {_P0}, {_TWO}, b AS (SELECT date, sum(x * y) / nullif(sum(x * x), 0) AS b FROM s{_SWEEPS - 1} GROUP BY date) SELECT date, asset_id, {rs('y - coalesce(b, 0) * x', 4)} AS ret_neutral FROM s{_SWEEPS - 1} JOIN b USING (date) WHERE n >= 20")
def x12_two(spark: SparkSession, root: str) -> DataFrame:
    """Residuals on size with industries and exchanges absorbed together."""
    d = log_size(spark, root).select("date", "asset_id", "ret", "x", "industry", "exchange_code")
    return residuals(d, ["date"], "ret", ["x"], "ret_neutral", category=["industry", "exchange_code"]).where("ret_neutral is not null").select("date", "asset_id", r("ret_neutral", 4))


@query("x17_no_intercept", f"WITH {X}, p AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM x WHERE ret IS NOT NULL AND x IS NOT NULL), b AS (SELECT date, sum(x * ret) / sum(x * x) AS b FROM p GROUP BY date) SELECT date, asset_id, {rs('ret - b * x', 7)} AS ret_neutral FROM p JOIN b USING (date) WHERE n >= 20")
def x17(spark: SparkSession, root: str) -> DataFrame:
    """Residuals through the origin."""
    d = log_size(spark, root).select("date", "asset_id", "ret", "x")
    return residuals(d, ["date"], "ret", ["x"], "ret_neutral", intercept=False).where("ret_neutral is not null").select("date", "asset_id", r("ret_neutral", 7))


_BK = "bk AS (SELECT date, median(market_equity) AS s, quantile_cont(ret, 0.3) AS lo, quantile_cont(ret, 0.7) AS hi FROM x WHERE exchange_code = 1 GROUP BY date HAVING count(*) >= 3)"


@query("x19_breakpoints", f"WITH {X} SELECT date, median(market_equity) AS size_0, {rs('quantile_cont(ret, 0.3)')} AS ret_0, {rs('quantile_cont(ret, 0.7)')} AS ret_1 FROM x WHERE exchange_code = 1 GROUP BY date")
def x19(spark: SparkSession, root: str) -> DataFrame:
    """Breakpoints of exchange 1."""
    b = breakpoints(log_size(spark, root), ["date"], {"size": ("market_equity", [0.5]), "ret": ("ret", [0.3, 0.7])}, F.col("exchange_code") == 1)
    return b.select("date", "size_0", r("ret_0"), r("ret_1"))


@query("x20_size_buckets", f"WITH {X}, {_BK} SELECT date, asset_id, CASE WHEN market_equity <= s THEN 'S' WHEN market_equity > s THEN 'B' END || CASE WHEN ret <= lo THEN 'L' WHEN ret > hi THEN 'H' WHEN ret IS NOT NULL THEN 'M' END AS grp FROM x JOIN bk USING (date)")
def x20(spark: SparkSession, root: str) -> DataFrame:
    """Independent 2 x 3 sort."""
    return size_buckets(log_size(spark, root), ["date"], "ret").select("date", "asset_id", F.col("group").alias("grp"))


_W = f"{_CODE}, h AS (SELECT date, asset_id, code, market_equity / sum(market_equity) OVER (PARTITION BY date, code) AS w FROM c WHERE code IS NOT NULL AND market_equity > 0)"


@query("x23_decile_weights", f"WITH {X}, {_W} SELECT date, asset_id, 'D' || lpad(CAST(code + 1 AS VARCHAR), 2, '0') AS label, {rs('w')} AS weight FROM h")
def x23(spark: SparkSession, root: str) -> DataFrame:
    """Value-weighted deciles."""
    return decile_weights(log_size(spark, root)).select("date", "asset_id", "label", r("weight"))


def decile_weights(d: DataFrame, k: int = K, x: str = "x", base: str | None = "market_equity") -> DataFrame:
    coded = bucket_codes(d.where(F.col(x).isNotNull()), ["date"], x, k, ["asset_id"]).where("code is not null")
    return leg_weights(coded, ["date", "code"], base).withColumn("label", F.concat(F.lit("D"), F.lpad((F.col("code") + 1).cast("string"), 2, "0")))


@query("x24_spread", f"WITH {X}, {_W} SELECT date, asset_id, {rs('CASE WHEN code = 9 THEN w ELSE -w END')} AS weight FROM h WHERE code IN (0, 9)")
def x24(spark: SparkSession, root: str) -> DataFrame:
    """Top decile against bottom decile."""
    w = decile_weights(log_size(spark, root)).withColumn("side", F.when(F.col("code") == K - 1, 1).when(F.col("code") == 0, -1))
    return spread(w, ["date"], "side", "HL").select("date", "asset_id", r("weight"))


@query("x28_rank_weights", f"WITH {X}, k AS (SELECT date, asset_id, (rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS p FROM x WHERE x IS NOT NULL), c AS (SELECT *, p - avg(p) OVER (PARTITION BY date) AS z FROM k) SELECT date, asset_id, {rs('greatest(z, 0) / nullif(sum(greatest(z, 0)) OVER (PARTITION BY date), 0)')} AS w_high, {rs('greatest(-z, 0) / nullif(sum(greatest(-z, 0)) OVER (PARTITION BY date), 0)')} AS w_low FROM c")
def x28(spark: SparkSession, root: str) -> DataFrame:
    """Weights by distance from the mean rank."""
    return rank_weights(log_size(spark, root).where("x is not null").select("date", "asset_id", "x"), "x").select("date", "asset_id", r("w_high"), r("w_low"))


def rank_weights(d: DataFrame, x: str) -> DataFrame:
    k = average_ranks(d, ["date"], x, "_p", pct=True)
    k = demean(k, ["date"], ["_p"]).withColumns({"_h": F.greatest(F.col("_p"), F.lit(0.0)), "_l": F.greatest(-F.col("_p"), F.lit(0.0))})
    t = k.groupBy("date").agg(F.sum("_h").alias("_th"), F.sum("_l").alias("_tl"))
    return k.join(t, "date").withColumns({"w_high": safe_div(F.col("_h"), F.col("_th")), "w_low": safe_div(F.col("_l"), F.col("_tl"))}).drop("_p", "_h", "_l", "_th", "_tl")


@query("x30_cut", f"WITH {X} SELECT date, asset_id, CASE WHEN x > 0 AND x <= 3 THEN 'micro' WHEN x > 3 AND x <= 6 THEN 'small' WHEN x > 6 AND x <= 9 THEN 'mid' WHEN x > 9 AND x <= 99 THEN 'large' END AS band FROM x WHERE x IS NOT NULL")
def x30(spark: SparkSession, root: str) -> DataFrame:
    """Fixed right-closed bins."""
    return log_size(spark, root).where("x is not null").select("date", "asset_id", cut(F.col("x"), [0, 3, 6, 9, 99], ["micro", "small", "mid", "large"]).alias("band"))


@query(
    "x14_rules",
    f"WITH {X}, {_Z}, f AS (SELECT date, asset_id, industry, coalesce(wx, avg(wx) OVER (PARTITION BY date)) AS v FROM (SELECT x.date, x.asset_id, x.industry, w.wx FROM x LEFT JOIN (SELECT date, asset_id, wx FROM w WHERE x IS NOT NULL) w ON w.date = x.date AND w.asset_id = x.asset_id)), z AS (SELECT *, (v - avg(v) OVER d) / CASE WHEN stddev_samp(v) OVER d > 1e-12 THEN stddev_samp(v) OVER d END AS z FROM f WINDOW d AS (PARTITION BY date)), n AS (SELECT *, count(z) FILTER (industry IS NOT NULL) OVER (PARTITION BY date) AS n, avg(z) OVER (PARTITION BY date, industry) AS m FROM z) SELECT date, asset_id, {rs('z', 6)} AS x_z, CASE WHEN n >= 20 AND industry IS NOT NULL THEN {rs('z - m', 6)} END AS x_neutral FROM n",
)
def x14(spark: SparkSession, root: str) -> DataFrame:
    """Outliers, missing values, scale and industry by rules, in order."""
    d = log_size(spark, root).select("date", "asset_id", "x", "industry")
    rules = [Outliers(("x",)), Missing(("x",), "mean"), Standardise(("x",)), Neutralise("x_z", (), "industry", output="x_neutral")]
    return apply_rules(d, rules).select("date", "asset_id", r("x_z", 6), r("x_neutral", 6))
