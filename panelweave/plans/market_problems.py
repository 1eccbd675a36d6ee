"""Queries on the market tables for the data-preparation operators of the core (problems 1, 3, 4, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave.functions.nulls import finite
from panelweave.operators.bitemporal import known_at
from panelweave.operators.intervals import FAR_END, merge_intervals, periods_and_gaps
from panelweave.operators.regular_grid import counter_grid, gauge_grid, reading_gaps
from panelweave.operators.rolling import trailing_totals
from panelweave.session import table

SLOTS, SLOT_MINUTES, CLOSE_MINUTE = 78, 5, 390
ACCOUNT_ITEMS = ["atq", "ltq", "book_equity", "saleq_ttm", "net_income_q_ttm", "oiadpq_ttm", "epspxq"]


def linked_quarters(spark: SparkSession, root: str) -> DataFrame:
    """(asset_id, gvkey, datadate, available_date), distinct: the quarters that belong to each asset.

    Link rows are merged into disjoint periods first, so a quarter meets at most one period of an asset.
    """
    spans = merge_intervals(table(spark, root, "ccm_link").select("gvkey", "asset_id", "linkdt", "linkenddt"), ["gvkey", "asset_id"], "linkdt", "linkenddt")
    quarters = table(spark, root, "compustat_quarterly").select("gvkey", "datadate", "available_date").where("gvkey is not null and datadate is not null and available_date is not null").distinct()
    both = quarters.join(spans, "gvkey").where("datadate between start_date and end_date")
    return both.select("asset_id", "gvkey", "datadate", "available_date")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Each asset-month with the quarter of its linked company that was public then."""
    events = table(spark, root, "crsp_monthly").select("asset_id", F.col("date").alias("month_end")).where("asset_id is not null and month_end is not null").distinct()
    rank = [(F.col("datadate"), True), (F.col("available_date"), True), (F.col("gvkey"), False)]
    out = known_at(events, linked_quarters(spark, root), "asset_id", "month_end", "datadate", "available_date", rank, ["gvkey", "datadate", "available_date"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("asset_id", day("month_end"), "gvkey", day("datadate"), day("available_date"))


def p1_figures(spark: SparkSession, root: str) -> DataFrame:
    """p1_found with the figures of the quarter's version; of repeated rows the greatest value of each item."""
    figures = table(spark, root, "compustat_quarterly").select("gvkey", "datadate", "available_date", *ACCOUNT_ITEMS)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    one = figures.groupBy("gvkey", day("datadate"), day("available_date")).agg(*[F.max(finite(c)).alias(c) for c in ACCOUNT_ITEMS])
    return p1_found(spark, root).join(one, ["gvkey", "datadate", "available_date"], "left").select("asset_id", "month_end", "gvkey", "datadate", "available_date", *ACCOUNT_ITEMS)


def _daily(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "crsp_daily").select("asset_id", F.unix_date(F.col("date").cast("date")).cast("long").alias("i"), "loaded_at", "ret").where("asset_id is not null and i is not null")
    return rows.groupBy("asset_id", "i").agg(F.max(F.struct("loaded_at", "ret")).getField("ret").alias("v"))


def _month_number(c: str) -> F.Column:
    return F.year(c).cast("long") * 12 + F.month(c) - 1


def _month_end(number: F.Column) -> F.Column:
    return F.last_day(F.make_date(F.floor(number / 12).cast("int"), F.pmod(number, F.lit(12)).cast("int") + 1, F.lit(1)))


def daily_ret_totals(spark: SparkSession, root: str) -> DataFrame:
    out = trailing_totals(_daily(spark, root), "asset_id", "i", "v", [7, 30])
    return out.withColumn("period_end", F.date_from_unix_date(F.col("i").cast("int")))


def monthly_ret_totals(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "crsp_monthly").select("asset_id", _month_number("date").alias("i"), finite("ret").alias("ret")).where("asset_id is not null and i is not null")
    out = trailing_totals(rows.groupBy("asset_id", "i").agg(F.max("ret").alias("v")), "asset_id", "i", "v", [12])
    return out.withColumn("period_end", _month_end(F.col("i")))


def quarterly_eps_totals(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "compustat_quarterly").select("gvkey", _month_number("datadate").alias("m"), "available_date", "epspxq").where("gvkey is not null and m is not null")
    one = rows.groupBy("gvkey", "m").agg(F.max(F.struct("available_date", "epspxq")).getField("epspxq").alias("v"))
    first = rows.groupBy("gvkey").agg(F.min("m").alias("m0"))
    on_grid = one.join(first, "gvkey").where("(m - m0) % 3 = 0").select("gvkey", F.floor(F.col("m") / 3).alias("i"), "v")
    out = trailing_totals(on_grid, "gvkey", "i", "v", [4])
    phase = first.select("gvkey", (F.col("m0") % 3).alias("_phase"))
    return out.join(phase, "gvkey").withColumn("period_end", _month_end(F.col("i") * 3 + F.col("_phase"))).drop("_phase")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Periods whose trailing figure is below the bound of its series."""
    cut = lambda df, name, key, n, low: df.where(low).select(F.lit(name).alias("series_name"), F.col(key).cast("string").alias("entity_key"), F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.lit(n).cast("long").alias("window_len"))
    d = daily_ret_totals(spark, root)
    low7, low30 = F.col("total_7") < -0.1500005, F.col("average_30") < -0.01000002
    d = d.where(low7 | low30).withColumn("window_len", F.explode(F.array_compact(F.array(F.when(low7, F.lit(7).cast("long")), F.when(low30, F.lit(30).cast("long"))))))
    d = d.select(F.lit("daily_ret").alias("series_name"), F.col("asset_id").cast("string").alias("entity_key"), F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "window_len")
    m = cut(monthly_ret_totals(spark, root), "monthly_ret", "asset_id", 12, F.col("total_12") < -0.6000005)
    q = cut(quarterly_eps_totals(spark, root), "quarterly_eps", "gvkey", 4, F.col("total_4") < -6.005)
    return d.unionByName(m).unionByName(q)


def p3_daily(spark: SparkSession, root: str) -> DataFrame:
    """Every asset and calendar day with its trailing totals and averages of ret."""
    r = lambda c: (F.round(F.col(c), 8) + 0.0).alias(c)
    return daily_ret_totals(spark, root).select("asset_id", "period_end", r("total_7"), r("average_7"), r("total_30"), r("average_30"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Continuous link periods of each (gvkey, asset_id), and the gaps between them."""
    links = table(spark, root, "ccm_link").select("gvkey", "asset_id", "linkdt", "linkenddt")
    out = periods_and_gaps(links, ["gvkey", "asset_id"], "linkdt", "linkenddt")
    return out.select("span_kind", "gvkey", "asset_id", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The empty five-minute slots of each asset and day with a reading."""
    bars = table(spark, root, "minute_bars").select("asset_id", "date_key", "session_minute", "open", "close")
    priced = bars.where("(session_minute between 0 and 389 and close > 0 and not isnan(close)) or (session_minute = 390 and open > 0 and not isnan(open))")
    gaps = reading_gaps(priced, ["asset_id", "date_key"], "session_minute", SLOTS, SLOT_MINUTES, also_occupied=F.col("session_minute") == CLOSE_MINUTE)
    return gaps.select("asset_id", F.col("date_key").cast("long").alias("date_key"), F.col("slot_no").cast("long").alias("slot_no"), F.col("from_minute").cast("long").alias("from_minute"))


def p6_prices(spark: SparkSession, root: str) -> DataFrame:
    """The full row of 78 five-minute prices of each source, observed, filled or marked as leading."""
    bars = table(spark, root, "minute_bars").select("asset_id", "date_key", "session_minute", "open", "close", "loaded_at")
    g = gauge_grid(bars, ["asset_id", "date_key"], "session_minute", SLOTS, SLOT_MINUTES, "open", "close", "loaded_at", ("open", CLOSE_MINUTE))
    return g.select("asset_id", F.col("date_key").cast("long").alias("date_key"), F.col("slot_no").cast("long").alias("slot_no"), "price", "state", F.col("from_minute").cast("long").alias("from_minute"))


def _volumes(spark: SparkSession, root: str) -> DataFrame:
    """One volume per source and minute, read at the minute's end."""
    bars = table(spark, root, "minute_bars").select("asset_id", "date_key", "session_minute", "volume").where("asset_id is not null and date_key is not null and session_minute between 0 and 389 and volume >= 0 and not isnan(volume)")
    return bars.groupBy("asset_id", "date_key", (F.col("session_minute") + 1).alias("t")).agg(F.max("volume").alias("volume"))


def _volume_grid(readings: DataFrame, counter: str) -> DataFrame:
    g = counter_grid(readings, ["asset_id", "date_key"], "t", counter, SLOTS, SLOT_MINUTES, start=0)
    return g.select("asset_id", F.col("date_key").cast("long").alias("date_key"), F.col("slot_no").cast("long").alias("slot_no"), F.round(F.col("increment") + 3.7e-11, 4).alias("increment"), F.round(F.col("covered") + 3.7e-11, 6).alias("covered"))


def p6_volume(spark: SparkSession, root: str) -> DataFrame:
    """Volume per slot from the running volume counter of each source, spread over the time between readings; it adds up to the source's volume."""
    w = W.partitionBy("asset_id", "date_key").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return _volume_grid(_volumes(spark, root).withColumn("running", F.sum("volume").over(w)), "running")


def p6_resets(spark: SparkSession, root: str) -> DataFrame:
    """The same from a counter that really falls: it starts anew whenever the source was silent for over 15 minutes, and nothing but its fall tells."""
    w = W.partitionBy("asset_id", "date_key").orderBy("t")
    v = _volumes(spark, root).withColumn("anew", (F.col("t") - F.lag("t").over(w) > 15).cast("int"))
    v = v.withColumn("part", F.sum(F.coalesce("anew", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    since = W.partitionBy("asset_id", "date_key", "part").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return _volume_grid(v.withColumn("running", F.sum("volume").over(since)), "running")


QUERIES = {
    "p1_found": p1_found,
    "p1_figures": p1_figures,
    "p3_found": p3_found,
    "p3_daily": p3_daily,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_prices": p6_prices,
    "p6_volume": p6_volume,
    "p6_resets": p6_resets,
}

_LINKED = f"""linked AS (
  SELECT DISTINCT l.asset_id, c.gvkey, c.datadate, c.available_date
  FROM compustat_quarterly c JOIN ccm_link l ON c.gvkey = l.gvkey AND l.linkdt <= c.datadate AND c.datadate <= coalesce(l.linkenddt, DATE '{FAR_END}'))"""
_P1 = f"""WITH {_LINKED}, months AS (SELECT DISTINCT asset_id, date FROM crsp_monthly),
ranked AS (SELECT m.asset_id, m.date, q.gvkey, q.datadate, q.available_date,
  row_number() OVER (PARTITION BY m.asset_id, m.date ORDER BY q.datadate DESC, q.available_date DESC, q.gvkey) AS k
  FROM months m JOIN linked q ON q.asset_id = m.asset_id AND q.available_date <= m.date),
found AS (SELECT asset_id, strftime(date, '%Y-%m-%d') AS month_end, gvkey, strftime(datadate, '%Y-%m-%d') AS datadate, strftime(available_date, '%Y-%m-%d') AS available_date FROM ranked WHERE k = 1)"""
_FIG = ", ".join(f"max(CASE WHEN isfinite({c}) THEN {c} END) AS {c}" for c in ACCOUNT_ITEMS)
_VAL = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0 ELSE {0} END"
_DAILY = f"""one AS (SELECT asset_id, CAST(date AS DATE) AS d, {_VAL.format('arg_max(coalesce(ret, 0), loaded_at)')} AS v FROM crsp_daily GROUP BY ALL),
span AS (SELECT asset_id, min(d) AS lo, max(d) AS hi FROM one GROUP BY ALL),
grid AS (SELECT asset_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
tot AS (SELECT asset_id, d, sum(v) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t7, sum(v) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t30
  FROM (SELECT g.asset_id, g.d, coalesce(o.v, 0) AS v FROM grid g LEFT JOIN one o USING (asset_id, d)) WINDOW w AS (PARTITION BY asset_id ORDER BY d))"""
_P4 = f"""WITH b AS (SELECT DISTINCT gvkey, asset_id, linkdt AS s, coalesce(linkenddt, DATE '{FAR_END}') AS e FROM ccm_link WHERE linkdt IS NOT NULL AND linkdt <= coalesce(linkenddt, DATE '{FAR_END}')),
m AS (SELECT *, max(e) OVER (PARTITION BY gvkey, asset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gvkey, asset_id ORDER BY s, e) AS k FROM m),
r AS (SELECT gvkey, asset_id, min(s) AS s, max(e) AS e FROM i GROUP BY gvkey, asset_id, k),
g AS (SELECT gvkey, asset_id, e + 1 AS s, lead(s) OVER (PARTITION BY gvkey, asset_id ORDER BY s) - 1 AS e FROM r)
SELECT span_kind, gvkey, asset_id, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date
FROM (SELECT 'period' AS span_kind, * FROM r UNION ALL SELECT 'gap', * FROM g WHERE e IS NOT NULL)"""
_READ = "session_minute BETWEEN 0 AND 389 AND close > 0 AND NOT isnan(close)"
_SRC = f"""src AS (SELECT DISTINCT asset_id, date_key FROM minute_bars WHERE {_READ}),
cells AS (SELECT asset_id, date_key, unnest(generate_series(0, 77)) AS slot_no FROM src),
rd AS (SELECT DISTINCT asset_id, date_key, session_minute AS m FROM minute_bars WHERE {_READ})"""


def _counter_sql(running: str) -> str:
    return f"""WITH v AS (SELECT asset_id, date_key, session_minute + 1 AS t, max(volume) AS volume FROM minute_bars WHERE session_minute BETWEEN 0 AND 389 AND volume >= 0 AND NOT isnan(volume) AND asset_id IS NOT NULL AND date_key IS NOT NULL GROUP BY ALL),
g0 AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY asset_id, date_key ORDER BY t) > 15, FALSE)::INT AS anew FROM v),
g1 AS (SELECT *, sum(anew) OVER (PARTITION BY asset_id, date_key ORDER BY t) AS part FROM g0),
n AS (SELECT asset_id, date_key, t, {running} AS c FROM g1),
s AS (SELECT asset_id, date_key, t, coalesce(lag(t) OVER w, 0) AS a, c - CASE WHEN lag(c) OVER w <= c THEN lag(c) OVER w ELSE 0 END AS x FROM n WINDOW w AS (PARTITION BY asset_id, date_key ORDER BY t)),
c AS (SELECT asset_id, date_key, unnest(generate_series(0, 77)) AS k FROM (SELECT DISTINCT asset_id, date_key FROM v)),
o AS (SELECT c.asset_id, c.date_key, c.k, s.x / (s.t - s.a)::DOUBLE AS rate, least(s.t, c.k * 5 + 5) - greatest(s.a, c.k * 5) AS w FROM c JOIN s ON s.asset_id = c.asset_id AND s.date_key = c.date_key AND s.a < c.k * 5 + 5 AND s.t > c.k * 5),
g AS (SELECT asset_id, date_key, k, sum(rate * w) AS i, sum(w) / 5.0::DOUBLE AS cov FROM o GROUP BY ALL)
SELECT c.asset_id, CAST(c.date_key AS BIGINT) AS date_key, CAST(c.k AS BIGINT) AS slot_no, round(i + 3.7e-11, 4) AS increment, round(coalesce(cov, 0) + 3.7e-11, 6) AS covered FROM c LEFT JOIN g USING (asset_id, date_key, k)"""


ORACLE = {
    "p1_found": _P1 + " SELECT * FROM found",
    "p1_figures": _P1 + f", fig AS (SELECT gvkey, strftime(datadate, '%Y-%m-%d') AS datadate, strftime(available_date, '%Y-%m-%d') AS available_date, {_FIG} FROM compustat_quarterly GROUP BY ALL) SELECT found.*, {', '.join(ACCOUNT_ITEMS)} FROM found LEFT JOIN fig USING (gvkey, datadate, available_date)",
    "p3_daily": f"WITH {_DAILY} SELECT asset_id, d AS period_end, round(t7, 8) + 0.0 AS total_7, round(t7 / 7, 8) + 0.0 AS average_7, round(t30, 8) + 0.0 AS total_30, round(t30 / 30, 8) + 0.0 AS average_30 FROM tot",
    "p3_found": f"""WITH {_DAILY},
mo AS (SELECT asset_id, date AS d, max({_VAL.format('ret')}) AS v FROM crsp_monthly GROUP BY ALL),
mg AS (SELECT asset_id, last_day(CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE)) AS d FROM mo GROUP BY asset_id),
mt AS (SELECT g.asset_id, g.d, sum(coalesce(o.v, 0)) OVER (PARTITION BY g.asset_id ORDER BY g.d ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS t FROM mg g LEFT JOIN mo o USING (asset_id, d)),
qo AS (SELECT gvkey, datadate AS d, arg_max(coalesce(epspxq, 'nan'::DOUBLE), available_date) AS v0 FROM compustat_quarterly GROUP BY ALL),
qn AS (SELECT gvkey, d, {_VAL.format('v0')} AS v FROM qo),
qg AS (SELECT gvkey, last_day(CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 3 MONTH)) AS DATE)) AS d FROM qn GROUP BY gvkey),
qt AS (SELECT g.gvkey, g.d, sum(coalesce(o.v, 0)) OVER (PARTITION BY g.gvkey ORDER BY g.d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS t FROM qg g LEFT JOIN qn o USING (gvkey, d))
SELECT 'daily_ret' AS series_name, CAST(asset_id AS VARCHAR) AS entity_key, strftime(d, '%Y-%m-%d') AS period_end, CAST(7 AS BIGINT) AS window_len FROM tot WHERE t7 < -0.1500005
UNION ALL SELECT 'daily_ret', CAST(asset_id AS VARCHAR), strftime(d, '%Y-%m-%d'), 30 FROM tot WHERE t30 / 30 < -0.01000002
UNION ALL SELECT 'monthly_ret', CAST(asset_id AS VARCHAR), strftime(d, '%Y-%m-%d'), 12 FROM mt WHERE t < -0.6000005
UNION ALL SELECT 'quarterly_eps', gvkey, strftime(d, '%Y-%m-%d'), 4 FROM qt WHERE t < -6.005""",
    "p4_found": _P4,
    "p6_volume": _counter_sql("sum(volume) OVER (PARTITION BY asset_id, date_key ORDER BY t)"),
    "p6_resets": _counter_sql("sum(volume) OVER (PARTITION BY asset_id, date_key, part ORDER BY t)"),
    "p6_found": f"""WITH {_SRC},
occ AS (SELECT asset_id, date_key, m // 5 AS slot_no FROM rd UNION SELECT asset_id, date_key, 77 FROM minute_bars WHERE session_minute = 390 AND open > 0 AND NOT isnan(open))
SELECT c.asset_id, CAST(c.date_key AS BIGINT) AS date_key, CAST(c.slot_no AS BIGINT) AS slot_no, CAST(coalesce(max(r.m), -1) AS BIGINT) AS from_minute
FROM cells c ANTI JOIN occ o USING (asset_id, date_key, slot_no) LEFT JOIN rd r ON r.asset_id = c.asset_id AND r.date_key = c.date_key AND r.m < c.slot_no * 5 GROUP BY ALL""",
    "p6_prices": f"""WITH {_SRC},
b AS (SELECT asset_id, date_key, session_minute AS m, arg_max(close, (coalesce(loaded_at, TIMESTAMP '1900-01-01'), close)) AS p, arg_max(CASE WHEN open > 0 AND NOT isnan(open) THEN open END, coalesce(loaded_at, TIMESTAMP '1900-01-01')) AS o FROM minute_bars WHERE {_READ} GROUP BY ALL),
a AS (SELECT asset_id, date_key, arg_max(open, (coalesce(loaded_at, TIMESTAMP '1900-01-01'), open)) AS p FROM minute_bars WHERE session_minute = 390 AND open > 0 AND NOT isnan(open) GROUP BY ALL),
f AS (SELECT asset_id, date_key, arg_min(p, m) AS p0, first(o ORDER BY m) AS o0 FROM b GROUP BY ALL),
x AS (SELECT c.*, (SELECT arg_max(p, m) FROM b WHERE b.asset_id = c.asset_id AND b.date_key = c.date_key AND m // 5 = slot_no) AS own,
  (SELECT max(m) FROM b WHERE b.asset_id = c.asset_id AND b.date_key = c.date_key AND m < slot_no * 5) AS bm,
  (SELECT arg_max(p, m) FROM b WHERE b.asset_id = c.asset_id AND b.date_key = c.date_key AND m < slot_no * 5) AS bp FROM cells c)
SELECT x.asset_id, CAST(x.date_key AS BIGINT) AS date_key, CAST(slot_no AS BIGINT) AS slot_no,
  CASE WHEN slot_no = 77 AND a.p IS NOT NULL THEN a.p ELSE coalesce(own, bp, o0) END AS price,
  CASE WHEN slot_no = 77 AND a.p IS NOT NULL THEN 'auction' WHEN own IS NOT NULL THEN 'observed' WHEN bp IS NOT NULL THEN 'filled' ELSE 'leading' END AS state,
  CAST(coalesce(bm, -1) AS BIGINT) AS from_minute
FROM x LEFT JOIN a USING (asset_id, date_key) LEFT JOIN f USING (asset_id, date_key)""",
}
