"""Queries with their SQL, collected by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.operators.intervals import FAR_END

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query (spark, root) -> DataFrame, and the SQL that must give the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: Added before rounding on both sides, so that a value on a rounding border falls the same way in both.
NUDGE = 3.7e-11


def r(c: str | Column, digits: int = 8, name: str | None = None) -> Column:
    """Rounded for comparison, negative zero made plain."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col + F.lit(NUDGE), digits) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def rs(expr: str, digits: int = 8) -> str:
    return f"round(({expr}) + {NUDGE}::DOUBLE, {digits}) + 0.0"


def fin(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


# Building blocks of the SQL side, as common table expressions.
M = f"m AS (SELECT DISTINCT asset_id, date, company_id, first_trade_date, {', '.join(f'{fin(c)} AS {c}' for c in ('ret', 'retx', 'market_equity', 'exchange_code', 'dollar_volume', 'siccd', 'market_equity_security'))} FROM crsp_monthly WHERE ff_primary_share)"
_RAW = f"SELECT asset_id, CAST(date AS DATE) AS date, loaded_at, company_id, upper(trim(symbol)) AS symbol, {', '.join(f'{fin(c)} AS {c}' for c in ('ret', 'price', 'market_equity', 'volume'))}, exchange_code, first_trade_date FROM crsp_daily"
_LAST = ", ".join(f"{c} DESC NULLS LAST" for c in ("loaded_at", "company_id", "symbol", "ret", "price", "market_equity", "volume", "exchange_code", "first_trade_date"))
D = f"d AS (SELECT * EXCLUDE (k, price, loaded_at), abs(price) AS price FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, date ORDER BY {_LAST}) AS k FROM ({_RAW})) WHERE k = 1)"
L = f"l AS (SELECT DISTINCT gvkey, asset_id, linkdt, coalesce(linkenddt, DATE '{FAR_END}') AS linkenddt FROM ccm_link WHERE linktype IN ('LU', 'LC') AND linkprim IN ('P', 'C') AND linkdt <= coalesce(linkenddt, DATE '{FAR_END}'))"


def q_sql(cols: list[str]) -> str:
    """The SQL side of panels.quarters, for the columns given."""
    pick = ", ".join(f"{fin(c)} AS {c}" for c in cols)
    return f"q AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY gvkey, datadate ORDER BY available_date) AS k FROM (SELECT DISTINCT gvkey, datadate, available_date, fyear, fqtr, rdq, rdq_imputed, {pick} FROM compustat_quarterly)) WHERE k = 1)"
