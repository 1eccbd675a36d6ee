"""Standard panels: cleaned prices, linked and point-in-time accounts, June formation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.keys import keep_last
from panelweave.functions.nulls import finite, positive
from panelweave.operators.asof import asof_backward, in_interval, latest_per
from panelweave.operators.intervals import open_end
from panelweave.operators.time_series import along, never_backwards, year_ago
from panelweave.session import table

SAMPLE = ("2008-01-31", "2025-11-30")
FINANCIALS = (6000, 6999)
STALE_DAYS = 366
LISTED_DAYS = 180


def is_financial(sic: str | Column) -> Column:
    """SIC 6000-6999; an unknown code is not financial."""
    return F.coalesce((F.col(sic) if isinstance(sic, str) else sic).between(*FINANCIALS), F.lit(False))


def exchange_code(letter: str | Column) -> Column:
    """1, 2, 3 for N, A, Q (fixed values); null for others."""
    c = F.col(letter) if isinstance(letter, str) else letter
    return F.when(c == "N", 1.0).when(c == "A", 2.0).when(c == "Q", 3.0)


def to_wide(df: DataFrame, index: str, columns: str, names: list, value: str) -> DataFrame:
    """One row per index and one column per name, of several values the greatest; the names are given, so no job finds them."""
    return df.groupBy(index).pivot(columns, names).agg(F.max(value))


def monthly(spark: SparkSession, root: str, primary: bool = True) -> DataFrame:
    """crsp_monthly with missing values as nulls and one row per (asset_id, date), of repeated rows the greatest value of each column; by default only primary shares."""
    num = ["ret", "retx", "market_equity", "exchange_code", "dollar_volume", "siccd", "market_equity_security"]
    m = table(spark, root, "crsp_monthly").where("asset_id is not null and date is not null")
    if primary:
        m = m.where("ff_primary_share")
    rest = ["company_id", "first_trade_date", "ff_primary_share"]
    return m.groupBy("asset_id", "date").agg(*[F.max(c).alias(c) for c in rest], *[F.max(finite(c)).alias(c) for c in num])


def daily(spark: SparkSession, root: str) -> DataFrame:
    """crsp_daily, the latest delivery of each (asset_id, date), date as day, symbol tidied, price without its sign."""
    num = ["ret", "price", "market_equity", "volume"]
    d = table(spark, root, "crsp_daily").where("asset_id is not null and date is not null")
    d = d.select("asset_id", F.col("date").cast("date").alias("date"), "loaded_at", "company_id", F.upper(F.trim("symbol")).alias("symbol"), *[finite(c).alias(c) for c in num], "exchange_code", "first_trade_date")
    return keep_last(d, ["asset_id", "date"], ["loaded_at"]).withColumn("price", F.abs("price"))


def links(spark: SparkSession, root: str) -> DataFrame:
    """ccm_link rows of usable type, their open ends spelled out, each once."""
    l = table(spark, root, "ccm_link").where("linktype in ('LU', 'LC') and linkprim in ('P', 'C') and linkdt is not null and gvkey is not null and asset_id is not null")
    return l.select("gvkey", "asset_id", "linkdt", open_end("linkenddt").alias("linkenddt")).where("linkdt <= linkenddt").distinct()


def quarters(spark: SparkSession, root: str) -> DataFrame:
    """compustat_quarterly in its first publication: one row per (gvkey, datadate), never with figures known later."""
    q = table(spark, root, "compustat_quarterly").where("gvkey is not null and datadate is not null and available_date is not null")
    num = [c for c, t in q.dtypes if t == "double"]
    q = q.select("gvkey", "datadate", "available_date", "fyear", "fqtr", "rdq", "rdq_imputed", *[finite(c).alias(c) for c in num])
    rest = [c for c in q.columns if c not in ("gvkey", "datadate", "available_date")]
    best = q.groupBy("gvkey", "datadate").agg(F.min(F.struct("available_date", *rest)).alias("x"))
    return best.select("gvkey", "datadate", "x.available_date", *[f"x.{c}" for c in rest])


def link(spark: SparkSession, root: str, accounts: DataFrame, key: str) -> DataFrame:
    """accounts with asset_id where datadate lies in a link window; of several for one (asset_id, key) the latest datadate, then the least gvkey."""
    d = in_interval(accounts, links(spark, root), "gvkey", "datadate", "linkdt", "linkenddt").drop("linkdt", "linkenddt")
    keys = ["asset_id"] if key == "asset_id" else ["asset_id", key]
    return latest_per(d, keys, [F.col("datadate").desc(), F.col("available_date").desc(), F.col("gvkey")])


def fiscal_years(spark: SparkSession, root: str, lag_cols: list[str] | None = None) -> DataFrame:
    """Fiscal fourth quarters linked to assets, with lag_<col> of the company's fourth quarter before."""
    q = quarters(spark, root).where("fqtr = 4")
    w = along("gvkey", "datadate")
    q = q.withColumns({f"lag_{c}": F.lag(c).over(w) for c in lag_cols or []})
    q = latest_per(q.where("fyear is not null"), ["gvkey", "fyear"], [F.col("datadate").desc()])
    return link(spark, root, q, "fyear")


def book_equity(spark: SparkSession, root: str) -> DataFrame:
    """Positive fiscal-year book equity per asset."""
    q = latest_per(quarters(spark, root).where("fqtr = 4 and book_equity > 0 and fyear is not null"), ["gvkey", "fyear"], [F.col("datadate").desc()])
    return link(spark, root, q, "fyear").select("asset_id", "fyear", "datadate", "available_date", "book_equity")


def june_formation(spark: SparkSession, root: str) -> DataFrame:
    """June market equity, last December's, and book equity of the fiscal year that ended in the calendar year before, announced by June."""
    m = monthly(spark, root)
    june = m.where("month(date) = 6").select(F.col("date").alias("rebalance_date"), "asset_id", "company_id", "market_equity", "exchange_code", "first_trade_date", "dollar_volume", (F.year("date") - 1).cast("long").alias("be_year"))
    dec = m.where("month(date) = 12").select("asset_id", F.year("date").cast("long").alias("be_year"), F.col("market_equity").alias("dec_market_equity"))
    be = book_equity(spark, root).withColumnRenamed("fyear", "be_year").drop("datadate")
    d = june.join(dec, ["asset_id", "be_year"]).join(be, ["asset_id", "be_year"]).where("available_date <= rebalance_date")
    d = d.withColumn("bm", F.col("book_equity") * 1000.0 / positive(F.col("dec_market_equity"))).where("bm > 0 and market_equity > 0")
    d = d.where(F.datediff("rebalance_date", "first_trade_date") >= LISTED_DAYS)
    return d.select("rebalance_date", "asset_id", "company_id", "be_year", "market_equity", "bm", "exchange_code", "book_equity", "dec_market_equity", "dollar_volume")


def june_accounts(spark: SparkSession, root: str, lag_cols: list[str] | None = None) -> DataFrame:
    """June formation joined with the accounts of that fiscal year."""
    acc = fiscal_years(spark, root, lag_cols).withColumnRenamed("fyear", "be_year").drop("book_equity")
    return june_formation(spark, root).join(acc, ["asset_id", "be_year"]).where("available_date <= rebalance_date")


def public_quarters(spark: SparkSession, root: str, year_ago_cols: list[str] | None = None) -> DataFrame:
    """Quarters per asset in the order they became public, less those of which a later quarter was public already."""
    q = quarters(spark, root)
    if year_ago_cols:
        q = year_ago(q, "gvkey", "datadate", year_ago_cols)
    return never_backwards(link(spark, root, q, "datadate"), "asset_id", "available_date", "datadate")


def monthly_accounts(spark: SparkSession, root: str, year_ago_cols: list[str] | None = None, exclude_financials: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Each asset-month of the sample with the latest public quarter, at most a year past its period."""
    m = monthly(spark, root).where(F.col("date").between(*[F.lit(x).cast("date") for x in SAMPLE])).select("date", "asset_id", "market_equity", "siccd")
    if exclude_financials:
        m = m.where(~is_financial("siccd"))
    acc = public_quarters(spark, root, year_ago_cols)
    keep = ["asset_id", "available_date", "datadate", *(columns if columns is not None else [c for c in acc.columns if c not in ("asset_id", "available_date", "datadate", "gvkey")])]
    out = asof_backward(m, acc.select(*keep), ["asset_id"], "date", "available_date", ["datadate"])
    return out.where(F.datediff("date", "datadate") <= STALE_DAYS)
