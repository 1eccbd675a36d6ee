"""Sources, filters, joins and panels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.dates import as_date, open_minute_utc, quarter_end, quarter_start
from panelweave.functions.keys import drop_ambiguous, last_rows
from panelweave.functions.nulls import finite, positive
from panelweave.operators.asof import asof_backward, calendar, code_of_range, next_in_calendar
from panelweave.operators.portfolio import holding_periods
from panelweave.operators.realized import tick_filter
from panelweave.operators.time_series import trailing_year, year_to_quarter
from panelweave.plans.panels import daily, exchange_code, fiscal_years, is_financial, june_accounts, june_formation, link, links, monthly, monthly_accounts, public_quarters, quarters, to_wide
from panelweave.plans.registry import D, L, M, fin, q_sql, query, r, rs
from panelweave.session import ensure_checkpoint_dir, table
from panelweave.sources.readers import read_code_ranges, read_csv, read_factor_text, read_glob, read_nested_zip, write_by_year
from panelweave.sources.store import write_bytes


@query("s01_scan", f"SELECT asset_id, date, {fin('ret')} AS ret FROM crsp_monthly WHERE date BETWEEN DATE '2015-01-01' AND DATE '2019-12-31'")
def scan(spark: SparkSession, root: str) -> DataFrame:
    """Columns and dates reach the scan."""
    return table(spark, root, "crsp_monthly").where("date between date'2015-01-01' and date'2019-12-31'").select("asset_id", "date", finite("ret").alias("ret"))


@query("s10_date_set", "SELECT asset_id, date, market_equity_security FROM crsp_monthly WHERE date IN (SELECT last_day(observation_date) FROM dgs1mo WHERE dgs1mo > 2 AND isfinite(dgs1mo)) AND isfinite(market_equity_security)")
def date_set(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose date is in a set that another table gives (S10): a semi join on one row per month, by which the scan can be pruned."""
    days = table(spark, root, "dgs1mo").where("dgs1mo > 2 and not isnan(dgs1mo) and dgs1mo < double('infinity')").select(F.last_day("observation_date").alias("date")).distinct()
    m = table(spark, root, "crsp_monthly").select("asset_id", "date", finite("market_equity_security").alias("market_equity_security")).where("market_equity_security is not null")
    return m.join(F.broadcast(days), "date", "left_semi").select("asset_id", "date", "market_equity_security")  # one row per month


@query("s11_many_files", "SELECT CAST(year(CAST(date AS DATE)) AS BIGINT) AS year, count(*) AS n, count(DISTINCT asset_id) AS n_assets FROM crsp_daily GROUP BY ALL")
def many_files(spark: SparkSession, root: str) -> DataFrame:
    """A table written as files by year, read back through a pattern of paths and put together by column name."""
    d = table(spark, root, "crsp_daily").select("asset_id", F.col("date").cast("date").alias("date"))
    folder = write_by_year(d, "date", f"{ensure_checkpoint_dir(spark)}/by-year-{uuid.uuid4().hex}")
    out = read_glob(spark, f"{folder}/year=*/*.parquet", folder)
    return out.groupBy("year", "asset_id").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("year").cast("long").alias("year")).agg(F.sum("c").alias("n"), F.count("asset_id").alias("n_assets"))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s07_csv_scan", f"SELECT asset_id, date, {fin('ret')} AS ret FROM crsp_monthly WHERE {fin('market_equity')} > 1000000")
def csv_scan(spark: SparkSession, root: str) -> DataFrame:
    """A table written as CSV and scanned again: columns by name, unreadable numbers null, filtered at the scan."""
    folder = _scratch(spark, "csv")
    table(spark, root, "crsp_monthly").select("date", "asset_id", "market_equity", F.coalesce(F.col("ret").cast("string"), F.lit("C")).alias("ret"), "siccd").write.option("header", "true").csv(folder)
    out = read_csv(spark, folder, "asset_id long, date date, ret double, market_equity double", "not isnan(market_equity) and market_equity > 1000000")
    return out.select("asset_id", "date", finite("ret").alias("ret"))


@query("s06_nested_zip", "SELECT * FROM (VALUES ('1', '0.5', NULL), ('2', '', 'b,c')) t(id, ret, note)")
def nested_zip(spark: SparkSession, root: str) -> DataFrame:
    """Rows of a CSV in a zip in a zip; a column the file lacks, and a field a line lacks, are null."""
    import io
    import zipfile

    def zipped(name: str, content: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, content)
        return out.getvalue()

    folder = _scratch(spark, "zip")
    write_bytes(spark, f"{folder}/a.zip", zipped("inner.zip", zipped("rows.csv", b'id,ret,note\n1,0.5\n2,,"b,c"\n')))
    return read_nested_zip(spark, f"{folder}/*.zip", ["id", "ret", "note"])


@query("s12_factor_text", f"SELECT last_day(observation_date) AS date, {rs('avg(dgs1mo) / 100')} AS rate, count(dgs1mo) / 100.0 AS days FROM dgs1mo WHERE isfinite(dgs1mo) GROUP BY ALL")
def factor_text(spark: SparkSession, root: str) -> DataFrame:
    """Monthly lines of a text with heads and notes, read back as decimals."""
    folder = _scratch(spark, "text")
    m = table(spark, root, "dgs1mo").where("dgs1mo is not null and not isnan(dgs1mo)").groupBy(F.date_format("observation_date", "yyyyMM").alias("m")).agg(F.avg("dgs1mo").alias("a"), F.count("dgs1mo").alias("n"))
    lines = m.select(F.concat_ws(",", F.concat(F.lit("  "), F.col("m")), F.format_string("  %.12f", "a"), F.col("n").cast("string")).alias("value"))
    notes = spark.createDataFrame([("This file was made by hand",), (",rate,days",), (" Annual Factors: January-December",), ("  2019,   2.1, 250",)], "value string")
    notes.unionByName(lines).write.text(folder)
    return read_factor_text(spark, folder, ["rate", "days"]).select("date", r("rate"), "days")


@query("s13_code_ranges", "SELECT * FROM (VALUES (100, 199, '01_Agric'), (2048, 2048, '01_Agric'), (2000, 2046, '02_Food'), (2070, 2079, '02_Food')) t(sic_low, sic_high, industry)")
def code_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Numbered heads and code ranges of a text."""
    folder = _scratch(spark, "ranges")
    text = " 1 Agric  Agriculture\n          0100-0199 Agric production - crops\n          2048-2048 Prepared feeds\n\n 2 Food   Food Products\n          2000-2046 Food\n          2070-2079 Fats and oils"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    return read_code_ranges(spark, folder, 2).select("sic_low", "sic_high", "industry")


@query("s08_daily_clean", f"WITH {D} SELECT asset_id, date, symbol, ret, price, market_equity, volume FROM d")
def daily_clean(spark: SparkSession, root: str) -> DataFrame:
    """The latest delivery of each asset-day, cleaned."""
    return daily(spark, root).select("asset_id", "date", "symbol", "ret", "price", "market_equity", "volume")


@query("s14_links", f"WITH {L} SELECT * FROM l")
def link_rows(spark: SparkSession, root: str) -> DataFrame:
    """Usable link rows with open ends spelled out."""
    return links(spark, root)


@query("proj03_complete_rows", f"WITH {M} SELECT asset_id, date, ret, market_equity, siccd FROM m WHERE ret IS NOT NULL AND market_equity IS NOT NULL AND siccd IS NOT NULL")
def complete_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows with every required column."""
    return monthly(spark, root).select("asset_id", "date", "ret", "market_equity", "siccd").dropna(subset=["ret", "market_equity", "siccd"])


@query("proj04_listing_age", f"WITH {M} SELECT asset_id, date FROM (SELECT *, coalesce(first_trade_date, min(date) OVER (PARTITION BY asset_id)) AS f FROM m) WHERE date_diff('day', f, date) >= 180")
def listing_age(spark: SparkSession, root: str) -> DataFrame:
    """Listed at least 180 days, from the first trade or else the first row."""
    m = monthly(spark, root)
    first = m.groupBy("asset_id").agg(F.min("date").alias("_f"))
    return m.join(first, "asset_id").where(F.datediff("date", F.coalesce("first_trade_date", "_f")) >= 180).select("asset_id", "date")


@query("proj05_active", f"WITH {D} SELECT asset_id, date FROM d WHERE ret IS NOT NULL AND coalesce(volume, 0) > 0 AND price > 5 AND market_equity > 0")
def active(spark: SparkSession, root: str) -> DataFrame:
    """Traded, liquid and positive."""
    return daily(spark, root).where("ret is not null and coalesce(volume, 0) > 0 and price > 5 and market_equity > 0").select("asset_id", "date")


@query("proj08_non_financial", f"WITH {M} SELECT asset_id, date, siccd FROM m WHERE NOT coalesce(siccd BETWEEN 6000 AND 6999, FALSE)")
def non_financial(spark: SparkSession, root: str) -> DataFrame:
    """Everything but SIC 6000-6999; unknown codes stay."""
    return monthly(spark, root).where(~is_financial("siccd")).select("asset_id", "date", "siccd")


def equity_of(q: DataFrame) -> DataFrame:
    """Book equity from its parts: shareholders' equity by the first source there is, plus deferred taxes, less preferred stock; not positive, no value."""
    se = F.coalesce("seqq", "ceqq", F.col("atq") - F.col("ltq"))
    be = se + F.coalesce("txditcq", F.lit(0.0)) - F.coalesce("pstkrq", "pstkq", F.lit(0.0))
    return q.withColumn("be", positive(be))


_BE = ["seqq", "ceqq", "atq", "ltq", "txditcq", "pstkrq", "pstkq"]


@query("proj12_book_equity", f"WITH {q_sql(_BE)}, b AS (SELECT gvkey, datadate, coalesce(seqq, ceqq, atq - ltq) + coalesce(txditcq, 0) - coalesce(pstkrq, pstkq, 0) AS be FROM q) SELECT gvkey, datadate, {rs('CASE WHEN be > 0 THEN be END', 6)} AS be FROM b")
def book_equity_parts(spark: SparkSession, root: str) -> DataFrame:
    """Book equity from its parts."""
    return equity_of(quarters(spark, root)).select("gvkey", "datadate", r("be", 6))


def common_stock(d: DataFrame, type_: str, subtype: str, us: str, status: str, conditional: str, exchange: str) -> DataFrame:
    """Common stock of US companies in active, regular trading on one of the three exchanges (fixed values); a missing code is none."""
    wanted = {type_: ["EQTY"], subtype: ["COM"], us: ["Y"], status: ["A"], conditional: ["RW"], exchange: ["N", "A", "Q"]}
    for c, values in wanted.items():
        d = d.where(F.col(c).isin(*values))
    return d


@query("proj09_common_stock", f"WITH {D} SELECT asset_id, date FROM d WHERE asset_id % 10 < 8 AND asset_id % 7 <> 0 AND exchange_code IN (1, 2, 3)")
def p09(spark: SparkSession, root: str) -> DataFrame:
    """The common-stock predicate on security codes that stand in for those the tables lack."""
    pick = lambda good, bad, ok: F.when(ok, good).otherwise(bad)
    codes = {"kind": F.lit("EQTY"), "sub": pick("COM", "ADR", F.col("asset_id") % 10 < 8), "us": pick("Y", None, F.col("asset_id") % 7 != 0), "state": F.lit("A"), "cond": F.lit("RW")}
    at = F.when(F.col("exchange_code") == 1, "N").when(F.col("exchange_code") == 2, "A").when(F.col("exchange_code") == 3, "Q")
    return common_stock(daily(spark, root).withColumns({**codes, "at": at}), "kind", "sub", "us", "state", "cond", "at").select("asset_id", "date")


def market_equity(price: Column, shares: Column) -> Column:
    """Price without its sign times shares; null if either is missing."""
    return F.abs(price) * shares


@query("proj11_market_equity", f"WITH q0 AS (SELECT DISTINCT gvkey, datadate, available_date, {fin('cshoq')} AS sh, {fin('ajexq')} AS p FROM compustat_quarterly) SELECT gvkey, datadate, available_date, {rs('max(abs(-p) * sh)', 6)} AS me FROM q0 GROUP BY ALL")
def p11(spark: SparkSession, root: str) -> DataFrame:
    """Market equity from a price that may be marked by a minus sign, and shares."""
    q = table(spark, root, "compustat_quarterly").select("gvkey", "datadate", "available_date", market_equity(-finite("ajexq"), finite("cshoq")).alias("me"))
    return q.groupBy("gvkey", "datadate", "available_date").agg(F.max("me").alias("me")).select("gvkey", "datadate", "available_date", r("me", 6))


_BARS = "b AS (SELECT asset_id, date_key, session_minute, arg_max(close, (coalesce(loaded_at, TIMESTAMP '1900-01-01'), close)) AS close FROM minute_bars WHERE session_minute BETWEEN 0 AND 389 AND close > 0 AND NOT isnan(close) GROUP BY ALL)"


@query(
    "proj16_ticks",
    f"""WITH {D}, {_BARS}, j AS (SELECT b.*, d.price FROM b JOIN d ON d.asset_id = b.asset_id AND d.date = strptime(CAST(b.date_key AS VARCHAR), '%Y%m%d')::DATE WHERE d.price > 0 AND b.close >= 0.5 * d.price AND b.close <= 2 * d.price),
w AS (SELECT *, median(close) OVER f AS med, count(*) OVER f AS n FROM j WINDOW f AS (PARTITION BY asset_id, date_key ORDER BY session_minute ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT asset_id, CAST(date_key AS BIGINT) AS date_key, CAST(session_minute AS BIGINT) AS session_minute, close FROM w WHERE n < 3 OR (close <= 1.5 * med AND close >= med / 1.5)""",
)
def ticks(spark: SparkSession, root: str) -> DataFrame:
    """Bars that agree with the day's price and with the bars around them."""
    b = table(spark, root, "minute_bars").where("session_minute between 0 and 389 and close > 0 and not isnan(close)")
    b = b.groupBy("asset_id", "date_key", "session_minute").agg(F.max(F.struct("loaded_at", "close")).getField("close").alias("close"))
    d = daily(spark, root).where("price > 0").select("asset_id", F.col("date").alias("_d"), "price")
    j = b.withColumn("_d", as_date("date_key")).join(d, ["asset_id", "_d"])
    t = tick_filter(j, ["asset_id", "date_key"], "session_minute", "close", "price")
    return t.select("asset_id", F.col("date_key").cast("long").alias("date_key"), F.col("session_minute").cast("long").alias("session_minute"), "close")


_ACC = ["atq", "saleq_ttm", "net_income_q_ttm", "gross_profit_q_ttm"]
_LINKED = """lk AS (SELECT * EXCLUDE k FROM (SELECT q.*, l.asset_id, row_number() OVER (PARTITION BY l.asset_id, q.datadate ORDER BY q.available_date DESC, q.gvkey) AS k FROM q JOIN l ON l.gvkey = q.gvkey AND q.datadate BETWEEN l.linkdt AND l.linkenddt) WHERE k = 1)"""
_PUBLIC = "pq AS (SELECT * EXCLUDE p FROM (SELECT *, max(datadate) OVER (PARTITION BY asset_id ORDER BY available_date, datadate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM lk) WHERE p IS NULL OR datadate > p)"
_SAMPLE = "date BETWEEN DATE '2008-01-31' AND DATE '2025-11-30'"


@query("j03_linked_quarters", f"WITH {L}, {q_sql(_ACC)}, {_LINKED} SELECT asset_id, gvkey, datadate, available_date FROM lk")
def linked(spark: SparkSession, root: str) -> DataFrame:
    """Quarters joined to assets by link window, one per asset and quarter end."""
    return link(spark, root, quarters(spark, root), "datadate").select("asset_id", "gvkey", "datadate", "available_date")


@query("m06_public_quarters", f"WITH {L}, {q_sql(_ACC)}, y AS (SELECT *, CASE WHEN date_diff('day', lag(datadate, 4) OVER w, datadate) BETWEEN 330 AND 400 THEN lag(atq, 4) OVER w END AS yoy_atq FROM q WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)), {_LINKED.replace('FROM q JOIN', 'FROM y q JOIN')}, {_PUBLIC} SELECT asset_id, gvkey, datadate, available_date, atq, yoy_atq FROM pq")
def m06(spark: SparkSession, root: str) -> DataFrame:
    """Quarters in the order they became public, with year-ago values."""
    return public_quarters(spark, root, ["atq"]).select("asset_id", "gvkey", "datadate", "available_date", "atq", "yoy_atq")


@query(
    "m07_monthly_accounts",
    f"""WITH {M}, {L}, {q_sql(_ACC)}, {_LINKED}, {_PUBLIC}
SELECT s.date, s.asset_id, s.market_equity, pq.datadate, pq.atq, pq.saleq_ttm FROM (SELECT * FROM m WHERE {_SAMPLE} AND NOT coalesce(siccd BETWEEN 6000 AND 6999, FALSE)) s ASOF JOIN pq ON pq.asset_id = s.asset_id AND pq.available_date <= s.date
WHERE date_diff('day', pq.datadate, s.date) <= 366""",
)
def m07(spark: SparkSession, root: str) -> DataFrame:
    """Each asset-month with the latest public quarter, fresh."""
    return monthly_accounts(spark, root, exclude_financials=True, columns=["atq", "saleq_ttm"]).select("date", "asset_id", "market_equity", "datadate", "atq", "saleq_ttm")


_Q4 = "f0 AS (SELECT *, lag(atq) OVER (PARTITION BY gvkey ORDER BY datadate) AS lag_atq FROM q WHERE fqtr = 4), f1 AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY gvkey, fyear ORDER BY datadate DESC) AS k FROM f0 WHERE fyear IS NOT NULL) WHERE k = 1), fy AS (SELECT * EXCLUDE k FROM (SELECT f1.*, l.asset_id, row_number() OVER (PARTITION BY l.asset_id, fyear ORDER BY datadate DESC, available_date DESC, f1.gvkey) AS k FROM f1 JOIN l ON l.gvkey = f1.gvkey AND datadate BETWEEN linkdt AND linkenddt) WHERE k = 1)"
_BEQ = "b1 AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY gvkey, fyear ORDER BY datadate DESC) AS k FROM q WHERE fqtr = 4 AND book_equity > 0 AND fyear IS NOT NULL) WHERE k = 1), be AS (SELECT * EXCLUDE k FROM (SELECT b1.*, l.asset_id, row_number() OVER (PARTITION BY l.asset_id, fyear ORDER BY datadate DESC, available_date DESC, b1.gvkey) AS k FROM b1 JOIN l ON l.gvkey = b1.gvkey AND datadate BETWEEN linkdt AND linkenddt) WHERE k = 1)"
JUNE = f"""jf AS (SELECT j.date AS rebalance_date, j.asset_id, CAST(year(j.date) - 1 AS BIGINT) AS be_year, j.market_equity, be.book_equity * 1000.0 / d.market_equity AS bm, j.exchange_code, be.book_equity, d.market_equity AS dec_market_equity, j.siccd
FROM m j JOIN m d ON d.asset_id = j.asset_id AND month(d.date) = 12 AND year(d.date) = year(j.date) - 1 AND d.market_equity > 0 JOIN be ON be.asset_id = j.asset_id AND be.fyear = year(j.date) - 1 AND be.available_date <= j.date
WHERE month(j.date) = 6 AND j.market_equity > 0 AND be.book_equity * 1000.0 / d.market_equity > 0 AND date_diff('day', j.first_trade_date, j.date) >= 180)"""


def june_sql(cols: list[str]) -> str:
    return f"{M}, {L}, {q_sql(sorted({*cols, 'atq', 'book_equity'}))}, {_BEQ}, {JUNE}, {_Q4}"


@query("m02_fiscal_years", f"WITH {L}, {q_sql(['atq'])}, {_Q4} SELECT asset_id, gvkey, CAST(fyear AS BIGINT) AS fyear, datadate, atq, lag_atq FROM fy")
def m02(spark: SparkSession, root: str) -> DataFrame:
    """Fiscal years per asset with the year before."""
    return fiscal_years(spark, root, ["atq"]).select("asset_id", "gvkey", "fyear", "datadate", "atq", "lag_atq")


@query("m04_june_formation", f"WITH {june_sql([])} SELECT rebalance_date, asset_id, market_equity, {rs('bm')} AS bm, exchange_code, book_equity, dec_market_equity FROM jf")
def m04(spark: SparkSession, root: str) -> DataFrame:
    """June formation universe."""
    return june_formation(spark, root).select("rebalance_date", "asset_id", "market_equity", r("bm"), "exchange_code", "book_equity", "dec_market_equity")


@query("m05_june_accounts", f"WITH {june_sql([])} SELECT jf.rebalance_date, jf.asset_id, fy.datadate, fy.atq, fy.lag_atq FROM jf JOIN fy ON fy.asset_id = jf.asset_id AND fy.fyear = jf.be_year WHERE fy.available_date <= jf.rebalance_date")
def m05(spark: SparkSession, root: str) -> DataFrame:
    """June formation with the year's accounts."""
    return june_accounts(spark, root, ["atq"]).select("rebalance_date", "asset_id", "datadate", "atq", "lag_atq")


@query(
    "m08_derived_quarters",
    f"""WITH {q_sql(['capxy', 'saleq'])}, c AS (SELECT *, CASE WHEN fqtr = 1 THEN capxy WHEN lag(fyear) OVER w = fyear AND lag(fqtr) OVER w = fqtr - 1 THEN capxy - lag(capxy) OVER w END AS capx_q FROM q WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)),
s AS (SELECT *, CASE WHEN count(saleq) OVER f = 4 AND date_diff('day', lag(datadate, 3) OVER (PARTITION BY gvkey ORDER BY datadate), datadate) <= 300 THEN sum(saleq) OVER f END AS ttm FROM c WINDOW f AS (PARTITION BY gvkey ORDER BY datadate ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT gvkey, datadate, {rs('capx_q', 4)} AS capx_q, {rs('ttm', 4)} AS saleq_ttm, CASE WHEN rdq IS NOT NULL AND rdq >= datadate THEN rdq ELSE datadate + 90 END AS public_from FROM s""",
)
def m08(spark: SparkSession, root: str) -> DataFrame:
    """Quarterly flows from year-to-date items, trailing years, and the date of publication."""
    q = quarters(spark, root).select("gvkey", "datadate", "fyear", "fqtr", "rdq", "capxy", "saleq")
    q = trailing_year(year_to_quarter(q, "gvkey", "datadate", "fyear", "fqtr", "capxy", "cx"), "gvkey", "datadate", "saleq", "ttm")
    day = F.when(F.col("rdq").isNotNull() & (F.col("rdq") >= F.col("datadate")), F.col("rdq")).otherwise(F.date_add("datadate", 90))
    return q.select("gvkey", "datadate", r("cx", 4, "capx_q"), r("ttm", 4, "saleq_ttm"), day.alias("public_from"))


@query("m16_matrix", f"WITH {M}, a AS (SELECT date, exchange_code AS e, avg(ret) AS v FROM m GROUP BY ALL) SELECT date, {', '.join(rs(f'max(CASE WHEN e = {k} THEN v END)') + f' AS x{k}' for k in (1, 2, 3))} FROM a GROUP BY date")
def m16_matrix(spark: SparkSession, root: str) -> DataFrame:
    """Mean returns as a matrix of months by exchange."""
    a = monthly(spark, root).groupBy("date", "exchange_code").agg(F.avg("ret").alias("v"))
    w = to_wide(a, "date", "exchange_code", [1.0, 2.0, 3.0], "v")
    return w.select("date", *[r(F.col(f"`{k}.0`"), 8, f"x{k}") for k in (1, 2, 3)])


@query("m16_quarters", f"WITH {D} SELECT CAST(date_trunc('quarter', date) AS DATE) AS quarter_start, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, CASE exchange_code WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE WHEN 3 THEN 3.0::DOUBLE END AS code, count(*) AS n FROM d GROUP BY ALL")
def m16_quarters(spark: SparkSession, root: str) -> DataFrame:
    """Asset-days by quarter, with its bounds, and by exchange, its letter turned into the code."""
    letter = F.when(F.col("exchange_code") == 1, "N").when(F.col("exchange_code") == 2, "A").when(F.col("exchange_code") == 3, "Q")
    d = daily(spark, root).select(quarter_start("date").alias("quarter_start"), quarter_end("date").alias("quarter_end"), exchange_code(letter).alias("code"))
    return d.groupBy("quarter_start", "quarter_end", "code").agg(F.count(F.lit(1)).alias("n"))


@query("m10_opening", "SELECT DISTINCT CAST(strptime(CAST(date_key AS VARCHAR), '%Y%m%d') AS DATE) AS date, CAST(minute_of_day - session_minute AS BIGINT) AS open_minute FROM minute_bars WHERE session_minute IS NOT NULL AND minute_of_day IS NOT NULL AND session_minute BETWEEN 0 AND 390")
def m10_opening(spark: SparkSession, root: str) -> DataFrame:
    """Minute of the UTC day at which New York opens, on every date with bars."""
    b = table(spark, root, "minute_bars").where("session_minute between 0 and 390 and minute_of_day is not null").select(as_date("date_key").alias("date")).distinct()
    return b.select("date", open_minute_utc("date").cast("long").alias("open_minute"))


_POLICY = f"o AS (SELECT observation_date AS date, max({fin('dgs1mo')}) AS v FROM dgs1mo GROUP BY ALL), u AS (SELECT date, ceil(v * 4) / 4 AS upper, ceil(v * 4) / 4 - 0.25::DOUBLE AS lower FROM o WHERE v IS NOT NULL)"


@query("m13_policy_panel", f"WITH {_POLICY}, c AS (SELECT *, upper - lag(upper) OVER (ORDER BY date) AS upper_change, lower - lag(lower) OVER (ORDER BY date) AS lower_change FROM u) SELECT date, upper, lower, (upper + lower) / 2 AS midpoint, coalesce(upper_change, 0) AS upper_change, coalesce(lower_change <> 0 OR upper_change <> 0, FALSE) AS changed FROM c")
def m13_panel(spark: SparkSession, root: str) -> DataFrame:
    """Target range, midpoint and changes by day (M13); the quarter-point band around the rate stands for the range, of which there is no table."""
    o = table(spark, root, "dgs1mo").groupBy(F.col("observation_date").alias("date")).agg(F.max(finite("dgs1mo")).alias("v")).where("v is not null")
    u = o.select("date", (F.ceil(F.col("v") * 4) / 4).alias("upper")).withColumn("lower", F.col("upper") - 0.25)
    w = W.orderBy("date")  # one row per calendar day
    c = u.withColumns({"upper_change": F.coalesce(F.col("upper") - F.lag("upper").over(w), F.lit(0.0)), "_l": F.coalesce(F.col("lower") - F.lag("lower").over(w), F.lit(0.0))})
    return c.select("date", "upper", "lower", ((F.col("upper") + F.col("lower")) / 2).alias("midpoint"), "upper_change", ((F.col("upper_change") != 0) | (F.col("_l") != 0)).alias("changed"))


@query(
    "m13_rate_changes",
    "WITH o AS (SELECT observation_date AS d, max(CASE WHEN isfinite(dgs1mo) THEN dgs1mo END) AS v FROM dgs1mo GROUP BY ALL), p AS (SELECT d, v, lag(v) OVER (ORDER BY d) AS b FROM o WHERE v IS NOT NULL) SELECT d AS observation_date, round((v - b) * 100, 4) + 0.0 AS change_bps, CASE WHEN v > b THEN 'up' ELSE 'down' END AS direction FROM p WHERE v <> b",
)
def m13(spark: SparkSession, root: str) -> DataFrame:
    """Days on which the rate changed, in basis points."""
    o = table(spark, root, "dgs1mo").groupBy("observation_date").agg(F.max(finite("dgs1mo")).alias("v")).where("v is not null")
    p = o.withColumn("b", F.lag("v").over(W.orderBy("observation_date"))).where("v <> b")  # one row per calendar day
    return p.select("observation_date", r((F.col("v") - F.col("b")) * 100, 4, "change_bps"), F.when(F.col("v") > F.col("b"), "up").otherwise("down").alias("direction"))


@query(
    "j07_event_days",
    f"""WITH {D}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM d)), {L}, {q_sql(['atq'])}, {_LINKED},
e AS (SELECT lk.asset_id, lk.datadate, lk.rdq, (SELECT min(p) FROM cal WHERE cal.date >= lk.rdq) AS p FROM lk WHERE rdq IS NOT NULL)
SELECT e.asset_id, e.datadate, e.rdq, CAST(o AS BIGINT) AS day_offset, cal.date FROM e, (SELECT unnest([-2, -1, 0, 1]) AS o) JOIN cal ON cal.p = e.p + o""",
)
def j07(spark: SparkSession, root: str) -> DataFrame:
    """Announcements to the trading days around them."""
    cal = calendar(daily(spark, root), "date")
    e = link(spark, root, quarters(spark, root), "datadate").where("rdq is not null").select("asset_id", "datadate", "rdq")
    at = next_in_calendar(e, cal, "rdq", "date").withColumnRenamed("position", "p")
    at = at.withColumn("day_offset", F.explode(F.array(*[F.lit(x).cast("long") for x in (-2, -1, 0, 1)])))
    return at.join(F.broadcast(cal), F.col("position") == F.col("p") + F.col("day_offset")).select("asset_id", "datadate", "rdq", "day_offset", "date")


@query("j09_symbol_map", f"WITH {D}, a AS (SELECT symbol, date FROM d WHERE symbol IS NOT NULL AND price BETWEEN 5 AND 1000 GROUP BY ALL HAVING count(DISTINCT asset_id) > 1) SELECT symbol, date, asset_id FROM d ANTI JOIN a USING (symbol, date) WHERE symbol IS NOT NULL AND price BETWEEN 5 AND 1000")
def j09(spark: SparkSession, root: str) -> DataFrame:
    """Symbols that mean one asset on their day."""
    d = daily(spark, root).where("symbol is not null and price between 5 and 1000").select("symbol", "date", "asset_id")
    return drop_ambiguous(d, ["symbol", "date"], "asset_id")


@query("j10_next_month", f"WITH {M} SELECT a.asset_id, a.date, b.ret AS next_ret FROM m a LEFT JOIN m b ON b.asset_id = a.asset_id AND b.date = last_day(a.date + INTERVAL 1 MONTH)")
def j10(spark: SparkSession, root: str) -> DataFrame:
    """Each asset-month with the next month's return."""
    m = monthly(spark, root).select("asset_id", "date", "ret")
    nxt = m.select("asset_id", F.last_day(F.add_months("date", -1)).alias("date"), F.col("ret").alias("next_ret"))
    return m.join(nxt, ["asset_id", "date"], "left").select("asset_id", "date", "next_ret")


@query("j06_holding_periods", f"WITH {M}, x AS (SELECT DISTINCT date FROM m), rb AS (SELECT date AS rebalance_date, lead(date) OVER (ORDER BY date) AS next_rebalance FROM x WHERE month(date) IN (3, 6, 9, 12)) SELECT x.date, rb.rebalance_date, rb.next_rebalance, x.date = min(x.date) OVER (PARTITION BY rb.rebalance_date) AS is_first FROM x ASOF JOIN rb ON x.date > rb.rebalance_date")
def j06(spark: SparkSession, root: str) -> DataFrame:
    """Return dates to the rebalance they follow."""
    m = monthly(spark, root)
    return holding_periods(m.where("month(date) in (3, 6, 9, 12)").select(F.col("date").alias("rebalance_date")), m).select("date", "rebalance_date", "next_rebalance", "is_first")


#: Stand-ins for the 49 published industries, made by rule: two major groups of the classification each, and one that overrules a part.
_RANGES = [(200 * i, 200 * i + 199, f"{i + 1:02d}_Major{2 * i:02d}") for i in range(50)] + [(2830, 2836, "51_Drugs")]


@query("j11_industries", f"WITH {M}, rg(lo, hi, industry, o) AS (VALUES {', '.join(f'({a}, {b}, {c!r}, {i})' for i, (a, b, c) in enumerate(_RANGES))}) SELECT asset_id, date, arg_max(industry, o) AS industry FROM m JOIN rg ON CAST(trunc(siccd) AS BIGINT) BETWEEN lo AND hi GROUP BY ALL")
def j11(spark: SparkSession, root: str) -> DataFrame:
    """Industry of a SIC code, later ranges overruling earlier ones."""
    ranges = spark.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate(_RANGES)], "lo int, hi int, industry string, o int")
    return code_of_range(monthly(spark, root).select("asset_id", "date", "siccd").where("siccd is not null"), ranges, "siccd", "lo", "hi", "industry", "o").select("asset_id", "date", "industry")


@query("j14_outer", f"WITH {M}, a AS (SELECT date, avg(ret) AS mean_ret FROM m GROUP BY ALL), b AS (SELECT last_day(observation_date) AS date, avg({fin('dgs1mo')}) AS rate FROM dgs1mo GROUP BY ALL) SELECT coalesce(a.date, b.date) AS date, {rs('mean_ret')} AS mean_ret, {rs('rate')} AS rate FROM a FULL JOIN b ON a.date = b.date")
def j14(spark: SparkSession, root: str) -> DataFrame:
    """Two monthly series side by side, whole."""
    a = monthly(spark, root).groupBy("date").agg(F.avg("ret").alias("mean_ret"))
    b = table(spark, root, "dgs1mo").groupBy(F.last_day("observation_date").alias("date")).agg(F.avg(finite("dgs1mo")).alias("rate"))
    return a.join(b, "date", "full_outer").select("date", r("mean_ret"), r("rate"))


@query("l03_last_rows", f"WITH {D} SELECT asset_id, date, ret FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k FROM d) WHERE k <= 5")
def l03(spark: SparkSession, root: str) -> DataFrame:
    """The last five days of each asset."""
    return last_rows(daily(spark, root).select("asset_id", "date", "ret"), "asset_id", "date", 5)


@query("l04_largest", f"WITH {M} SELECT asset_id, date, market_equity FROM m WHERE market_equity IS NOT NULL ORDER BY market_equity DESC, asset_id, date LIMIT 25")
def l04(spark: SparkSession, root: str) -> DataFrame:
    """The 25 largest asset-months: the limit is the feature."""
    return monthly(spark, root).where("market_equity is not null").select("asset_id", "date", "market_equity").orderBy(F.desc("market_equity"), "asset_id", "date").limit(25)


@query("j05_rates_on_trading_days", f"WITH {D}, t AS (SELECT DISTINCT date FROM d), o AS (SELECT observation_date, max({fin('dgs1mo')}) AS v FROM dgs1mo GROUP BY ALL) SELECT t.date, o.observation_date, o.v AS rate FROM t ASOF LEFT JOIN (SELECT * FROM o WHERE v IS NOT NULL) o ON o.observation_date <= t.date")
def j05(spark: SparkSession, root: str) -> DataFrame:
    """Each trading day with the last rate known; a join without key, cut into years."""
    t = daily(spark, root).select("date").distinct()
    o = table(spark, root, "dgs1mo").groupBy("observation_date").agg(F.max(finite("dgs1mo")).alias("rate")).where("rate is not null")
    return asof_backward(t, o, [], "date", "observation_date", ["rate"], span="year").select("date", "observation_date", "rate")
