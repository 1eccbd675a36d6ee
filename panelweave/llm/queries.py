"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.digest import certified_percentiles
from panelweave.llm.encoding import GARBLINGS, garbled_texts, planted, restored_texts
from panelweave.llm.leakage import leaked_passages
from panelweave.llm.nearest import nearest_in_series, nearest_times
from panelweave.llm.packing import pack_texts, sequence_texts
from panelweave.operators.cross_section import ranks
from panelweave.plans.market_problems import linked_quarters
from panelweave.session import table

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
FILING_DAYS, RATE_DAYS = 12, 3


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Month ends with the nearest filing of the same asset and the nearest day with a rate."""
    months = table(spark, root, "crsp_monthly").select("asset_id", F.col("date").alias("month_end")).where("asset_id is not null and month_end is not null").distinct()
    filing = nearest_times(months, linked_quarters(spark, root), "asset_id", "month_end", "available_date", dt.timedelta(FILING_DAYS))
    rates = table(spark, root, "dgs1mo").where("dgs1mo is not null and not isnan(dgs1mo)")
    rate = nearest_in_series(months, rates, "month_end", "observation_date", dt.timedelta(RATE_DAYS))
    day = lambda c, to: F.date_format(c, "yyyy-MM-dd").alias(to)
    out = lambda df, kind, c: df.select(F.lit(kind).alias("pair_kind"), "asset_id", day("month_end", "month_end"), day(c, "matched_date"))
    return out(filing, "filing", "available_date").unionByName(out(rate, "rate", "observation_date"))


def p2_bars(spark: SparkSession, root: str) -> DataFrame:
    """Each delivery of a day of crsp_daily with the delivery of a minute bar of the same asset nearest in time, at most two days away: times that never coincide."""
    left = table(spark, root, "crsp_daily").select("asset_id", F.col("loaded_at").alias("day_loaded"))
    right = table(spark, root, "minute_bars").select("asset_id", F.col("loaded_at").alias("bar_loaded"))
    return nearest_times(left, right, "asset_id", "day_loaded", "bar_loaded", dt.timedelta(2))


def _values(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "crsp_monthly").select("asset_id", "date", "exchange_code", "market_equity").distinct()


def p5_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of market_equity per exchange code, by date and (merged from the months) overall, with their certificate."""
    out = certified_percentiles(_values(spark, root), ["exchange_code"], ["date"], "market_equity", PROBS)
    return out.select(F.when(F.col("is_coarse"), "overall").otherwise("month").alias("scope"), "exchange_code", "date", "q", "n_values", "estimate", "rank_error", "error_bound", "certified")


def p5_certified(spark: SparkSession, root: str) -> DataFrame:
    """The groups of p5_percentiles, how many values they have, and whether every estimate is within its bound."""
    return p5_percentiles(spark, root).select("scope", "exchange_code", "date", "q", "n_values", "certified")


def p5_bracket(spark: SparkSession, root: str) -> DataFrame:
    """For each estimate the two values of the table that its error bound allows it to lie between, by exact ranks, and whether it does."""
    v = _values(spark, root).where("market_equity is not null and not isnan(market_equity) and abs(market_equity) < double('infinity')").select("exchange_code", "date", "market_equity")
    v = v.select(F.explode(F.array(F.lit("month"), F.lit("overall"))).alias("scope"), "exchange_code", "date", "market_equity")
    v = v.withColumns({"date": F.when(F.col("scope") == "month", F.col("date")), "k": F.to_json(F.struct("scope", "exchange_code", F.when(F.col("scope") == "month", F.col("date")).alias("d")))})
    e = p5_percentiles(spark, root).select("q", "estimate", "scope", "exchange_code", "date", F.to_json(F.struct("scope", "exchange_code", F.col("date").alias("d"))).alias("k"))
    at = ranks(v.select("k", "market_equity"), ["k"], "market_equity", []).join(e, "k")
    width = F.lit(0.01) * F.col("_n") + 0.5
    low, high = F.greatest(F.ceil(F.col("q") * F.col("_n") - width), F.lit(1)), F.least(F.floor(F.col("q") * F.col("_n") + width) + 1, F.col("_n"))
    pick = lambda r: F.max(F.when(F.col("_rank") == r, F.col("market_equity")))
    out = at.groupBy("scope", "exchange_code", "date", "q", "estimate").agg(pick(low).alias("least"), pick(high).alias("most"))
    return out.select("scope", "exchange_code", "date", "q", "least", "most", F.col("estimate").between(F.col("least"), F.col("most")).alias("inside"))


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    """Every text, or piece of one, and its place in a sequence of 2,048 tokens."""
    return pack_texts(table(spark, root, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """The texts read back from the token sequences that p7_packed lays out, and whether every sequence of theirs keeps to its length."""
    docs = table(spark, root, "documents")
    return sequence_texts(docs, pack_texts(docs, "doc_id", "text")).select("doc_id", F.md5("text").alias("text_md5"), "fits")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with at least twelve consecutive words of a benchmark item."""
    return leaked_passages(table(spark, root, "documents"), table(spark, root, "benchmark"), altered=0).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, root: str) -> DataFrame:
    """Exact phrase and proximity matches."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return leaked_passages(table(spark, root, "documents"), table(spark, root, "benchmark")).select("doc_id", "item_id", "kind", long("run_words"), long("shared_words"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with text that was read in the wrong encoding."""
    return garbled_texts(table(spark, root, "documents"))


def p9_restored(spark: SparkSession, root: str) -> DataFrame:
    """The garbled documents with their original text, as far as it can be had."""
    return restored_texts(table(spark, root, "documents"))


#: Texts that are certainly as they were written: besides ASCII only these letters, and no inline code.
PLAIN = "^[\\x00-_a-\\x7F" + "äöüßÄÖÜéèêàçñóúíáãõâôûîœ¿¡’“”–…«»ぁ-んァ-ヶ一-龠。、ー" + "]*$"


def p9_check(spark: SparkSession, root: str) -> DataFrame:
    """Every plain text with letters beyond ASCII, garbled in several ways and restored; the SQL has the texts as they were."""
    docs = table(spark, root, "documents")
    bad = planted(docs.where(F.col("text").rlike(PLAIN) & F.col("text").rlike("[^\\x00-\\x7F]")))
    out = restored_texts(bad.select(F.concat_ws(":", "garbling", "doc_id").alias("doc_id"), "text"), corpus=docs)
    return out.select(F.substring_index("doc_id", ":", 1).alias("garbling"), F.substring_index("doc_id", ":", -1).cast("long").alias("doc_id"), F.md5("restored").alias("text_md5"), "complete")


QUERIES = {
    "p2_found": p2_found,
    "p2_bars": p2_bars,
    "p5_percentiles": p5_percentiles,
    "p5_certified": p5_certified,
    "p5_bracket": p5_bracket,
    "p7_packed": p7_packed,
    "p7_roundtrip": p7_roundtrip,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
    "p9_check": p9_check,
}

_WORDS = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS ws FROM benchmark WHERE text IS NOT NULL)"""
_GROUPS = """WITH b AS (SELECT date, exchange_code, market_equity FROM (SELECT DISTINCT asset_id, date, exchange_code, market_equity FROM crsp_monthly) WHERE market_equity IS NOT NULL AND isfinite(market_equity)),
g AS (SELECT 'month' AS scope, exchange_code, date, market_equity FROM b UNION ALL SELECT 'overall', exchange_code, CAST(NULL AS DATE), market_equity FROM b)"""
_FAR = "DATE '2262-04-11'"
ORACLE = {
    "p2_found": f"""WITH linked AS (SELECT DISTINCT l.asset_id, c.available_date FROM compustat_quarterly c JOIN ccm_link l ON c.gvkey = l.gvkey AND c.datadate BETWEEN l.linkdt AND coalesce(l.linkenddt, {_FAR})),
m AS (SELECT DISTINCT asset_id, date FROM crsp_monthly),
f AS (SELECT m.asset_id, m.date, q.available_date AS d FROM m JOIN linked q ON q.asset_id = m.asset_id AND abs(date_diff('day', m.date, q.available_date)) <= {FILING_DAYS}),
r AS (SELECT m.asset_id, m.date, q.observation_date AS d FROM m JOIN dgs1mo q ON q.dgs1mo IS NOT NULL AND q.observation_date BETWEEN m.date - {RATE_DAYS} AND m.date + {RATE_DAYS}),
a AS (SELECT 'filing' AS pair_kind, * FROM f UNION ALL SELECT 'rate', * FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY pair_kind, asset_id, date ORDER BY abs(date_diff('day', date, d)), d) AS n FROM a)
SELECT pair_kind, asset_id, strftime(date, '%Y-%m-%d') AS month_end, strftime(d, '%Y-%m-%d') AS matched_date FROM k WHERE n = 1""",
    "p2_bars": """WITH l AS (SELECT DISTINCT asset_id, loaded_at AS t FROM crsp_daily WHERE loaded_at IS NOT NULL AND asset_id IS NOT NULL), r AS (SELECT DISTINCT asset_id, loaded_at AS t FROM minute_bars WHERE loaded_at IS NOT NULL AND asset_id IS NOT NULL),
a AS (SELECT l.asset_id, l.t, r.t AS u FROM l ASOF JOIN r ON l.asset_id = r.asset_id AND r.t <= l.t UNION ALL SELECT l.asset_id, l.t, r.t FROM l ASOF JOIN r ON l.asset_id = r.asset_id AND r.t >= l.t)
SELECT asset_id, t AS day_loaded, u AS bar_loaded FROM a WHERE abs(epoch_us(t) - epoch_us(u)) <= 2 * 86400000000 QUALIFY row_number() OVER (PARTITION BY asset_id, t ORDER BY abs(epoch_us(t) - epoch_us(u)), u) = 1""",
    "p5_certified": f"""{_GROUPS},
c AS (SELECT scope, exchange_code, date, count(*) AS n FROM g GROUP BY ALL)
SELECT scope, exchange_code, date, q, n AS n_values, TRUE AS certified FROM c, (SELECT CAST(unnest({PROBS}) AS DOUBLE) AS q)""",
    "p5_bracket": f"""{_GROUPS},
k AS (SELECT *, row_number() OVER (PARTITION BY scope, exchange_code, date ORDER BY market_equity) AS r, count(*) OVER (PARTITION BY scope, exchange_code, date) AS n FROM g),
w AS (SELECT *, CAST(0.01::DOUBLE * n + 0.5::DOUBLE AS DOUBLE) AS w FROM k, (SELECT CAST(unnest({PROBS}) AS DOUBLE) AS q))
SELECT scope, exchange_code, date, q, max(CASE WHEN r = greatest(ceil(q * n - w), 1) THEN market_equity END) AS least, max(CASE WHEN r = least(floor(q * n + w) + 1, n) THEN market_equity END) AS most, TRUE AS inside FROM w GROUP BY ALL""",
    "p7_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, TRUE AS fits FROM documents",
    "p8_found": f"""{_WORDS},
dg AS (SELECT doc_id, array_to_string(ws[k:k + 11], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 11)) AS k FROM w WHERE len(ws) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + 11], ' ') AS g FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 11)) AS k FROM i WHERE len(ws) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_passages": f"""{_WORDS},
dw AS (SELECT doc_id, ws[k] AS w, k - 1 AS pos FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS k FROM w)),
iw AS (SELECT item_id, ws[k] AS w, k - 1 AS ip FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws))) AS k FROM i WHERE len(ws) >= 12)),
h AS (SELECT doc_id, item_id, pos - ip AS o, ip FROM dw JOIN iw USING (w)),
f AS (SELECT doc_id, item_id, o, count(*) AS n FROM (SELECT *, ip - row_number() OVER (PARTITION BY doc_id, item_id, o ORDER BY ip) AS g FROM h) GROUP BY doc_id, item_id, o, g HAVING count(*) >= 12),
p AS (SELECT doc_id, item_id, max(n) AS run_words FROM f GROUP BY ALL),
c AS (SELECT DISTINCT doc_id, item_id, CAST(floor(o / 2.0) AS BIGINT) - b AS cell, ip FROM h, (VALUES (0), (1)) t(b)),
d AS (SELECT *, ip - lag(ip, 8) OVER (PARTITION BY doc_id, item_id, cell ORDER BY ip) AS span, count(*) OVER (PARTITION BY doc_id, item_id, cell) AS n FROM c),
x AS (SELECT doc_id, item_id, max(n) AS shared_words FROM d WHERE span < 12 GROUP BY ALL)
SELECT doc_id, item_id, CASE WHEN run_words IS NULL THEN 'proximity' ELSE 'phrase' END AS kind, coalesce(run_words, 0) AS run_words, shared_words FROM x LEFT JOIN p USING (doc_id, item_id)""",
    "p9_check": f"""SELECT garbling, doc_id, md5(text) AS text_md5, TRUE AS complete FROM documents, (VALUES {', '.join(f"('{g}')" for g in GARBLINGS)}) g(garbling)
WHERE regexp_matches(text, '{PLAIN}') AND regexp_matches(text, '[^\\x00-\\x7F]')""",
}
