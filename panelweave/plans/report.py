"""Reports of a factor: tables for storage, and a short text."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from panelweave.operators.factor import Backtest, Factor
from panelweave.operators.time_series import with_drawdown
from panelweave.session import materialize
from panelweave.sources.store import write_text


def report_tables(factor: Factor, exposure: DataFrame, backtest: Backtest) -> dict[str, DataFrame]:
    """Returns, drawdowns, turnover, IC, fit and summary of a factor; the simulation is computed once."""
    sim = materialize(backtest.simulate(factor))
    return {
        "returns": sim,
        "drawdown": with_drawdown(sim, ["portfolio"], "date", "ret").select("date", "portfolio", "wealth", "drawdown"),
        "turnover": backtest.turnover(factor),
        "ic": backtest.ic(exposure),
        "ic_summary": backtest.ic_summary(exposure),
        "fit": backtest.fit(exposure),
        "summary": backtest.summary(factor),
        "diagnostics": factor.diagnostics(),
    }


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header. The tables are small: dates x portfolios."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def _shown(x: object, per_cent: bool) -> str:
    if x is None or x != x:
        return ""
    if isinstance(x, float):
        return f"{x:.2%}" if per_cent else f"{x:.3f}"
    return str(x)


def markdown(df: DataFrame, per_cent: tuple[str, ...] = ("ann_return", "ann_vol", "max_drawdown", "hit_rate", "avg_turnover")) -> str:
    """A small table as text; missing values are blank."""
    rows = df.collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join("| " + " | ".join(_shown(r[c], c in per_cent) for c in df.columns) + " |\n" for r in rows)


def summary_text(title: str, facts: dict[str, object], sections: dict[str, DataFrame]) -> str:
    """A report as text: title, facts as a list, and each table under its heading."""
    parts = [f"# {title}", "\n".join(f"- {k}: {v}" for k, v in facts.items())]
    parts += [f"## {name}\n\n{markdown(df)}" for name, df in sections.items()]
    return "\n\n".join(p for p in parts if p) + "\n"


def write_summary(factor: Factor, exposure: DataFrame, backtest: Backtest, folder: str) -> str:
    """summary.md in folder: what the factor is, performance with turnover, by year, exposure's IC and its decay, holdings on the last date."""
    d = factor.diagnostics()
    last = d.orderBy(d["rebalance_date"].desc()).limit(1).select("rebalance_date")
    sections = {
        "Performance": backtest.summary(factor).orderBy("portfolio"),
        "Calendar years": backtest.by_year(factor).groupBy("year").pivot("portfolio").agg({"ret": "first"}).orderBy("year"),
        "Information coefficient": backtest.ic_summary(exposure),
        "Decay": backtest.ic_decay(exposure).orderBy("h"),
        "Holdings at the last rebalance": d.join(last, "rebalance_date").orderBy("portfolio"),
    }
    return write_text(exposure.sparkSession, f"{folder}/summary.md", summary_text(factor.name, factor.meta, sections))


def line_plot(df: DataFrame, x: str, ys: list[str], title: str, width: int = 720, height: int = 320) -> str:
    """A page with one line per column of a small table (dates x portfolios), as inline SVG; missing values break a line."""
    rows = df.select(x, *ys).orderBy(x).collect()
    values = [float(r[y]) for r in rows for y in ys if r[y] is not None and r[y] == r[y]]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    span = (high - low) or 1.0
    left, step = 50, (width - 60) / max(len(rows) - 1, 1)
    colours = ["#1b6ca8", "#c8553d", "#588157", "#7b5ea7", "#8d6e63", "#444444"]
    lines = []
    for k, y in enumerate(ys):
        pieces: list[list[str]] = [[]]
        for i, r in enumerate(rows):
            if r[y] is None or r[y] != r[y]:
                pieces.append([])
            else:
                pieces[-1].append(f"{left + i * step:.1f},{height - 30 - (float(r[y]) - low) / span * (height - 50):.1f}")
        colour = colours[k % len(colours)]
        lines += [f'<polyline fill="none" stroke="{colour}" points="{" ".join(p)}"/>' for p in pieces if p]
        lines.append(f'<text x="{left + 110 * k}" y="{height - 8}" fill="{colour}">{html.escape(y)}</text>')
    ends = f"{rows[0][x]} to {rows[-1][x]}" if rows else "no data"
    axis = f'<text x="2" y="24">{high:.3g}</text><text x="2" y="{height - 30}">{low:.3g}</text>'
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{ends}</p><svg width="{width}" height="{height}" font-size="12">{axis}{"".join(lines)}</svg>\n'


def write_plots(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Pages of wealth and of drawdown, a line per portfolio, from report_tables."""
    paths = []
    for column in ("wealth", "drawdown"):
        wide = tables["drawdown"].groupBy("date").pivot("portfolio").agg({column: "first"})
        page = line_plot(wide, "date", [c for c in wide.columns if c != "date"], column)
        paths.append(write_text(wide.sparkSession, f"{folder}/{column}.html", page))
    return paths
