"""Sources, rules, the factor template, options and allocation."""

import datetime as dt
import io
import zipfile

import numpy as np
import pandas as pd
import pytest

from panelweave.operators.allocation import RULES, Spectrum, inverse_wishart, positions, pricing_diagnostics, prior_scale, risk_parity, shrunk_correlation, spike_and_slab
from panelweave.operators.factor import Backtest, BucketFactor, Factor
from panelweave.operators.options import band_table, hedge_daily, levered_pairs, low_leverage_spread, roll_pairs, tradable, trades
from panelweave.operators.regression import rolling_residual
from panelweave.operators.rules import Missing, Neutralise, Outliers, Standardise, apply_rules
from panelweave.operators.time_series import along
from panelweave.plans.report import markdown, report_tables, write_csv
from panelweave.sources.readers import read_code_ranges, read_csv, read_factor_text, read_nested_zip
from panelweave.sources.store import data_root, load_factor, read_table, save_factor, write_table

RNG = np.random.default_rng(12)


def test_store(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(dt.date(2020, 1, 31), 1, 0.5), (dt.date(2020, 1, 31), 2, float("inf")), (dt.date(2020, 2, 29), 1, None)], "date date, asset_id int, exposure double")
    write_table(df, str(tmp_path), "t", ["asset_id"])
    assert read_table(spark, str(tmp_path), "t", ["date"]).count() == 3
    with pytest.raises(Exception):
        write_table(df, str(tmp_path), "t", overwrite=False)
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path), "none")
    e, meta = load_factor(spark, save_factor(df, str(tmp_path / "f"), {"name": "x"}, {"more": df}))
    assert e.count() == 1 and meta == {"name": "x"} and load_factor(spark, str(tmp_path / "f"), "more")[0].count() == 3
    monkeypatch.setenv("PANELWEAVE_DATA", "/x")
    assert data_root() == "/x" and data_root("/y") == "/y"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fmt,v,extra\nSTD,1.5,x\nSTD,oops,y\nINDL,2,z\n")
    rows = read_csv(spark, str(tmp_path / "a.csv"), "fmt string, v double", "fmt = 'STD'").collect()
    assert [r.v for r in rows] == [1.5, None]
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", "a,b\n1,2\n3,4\n")
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
    assert {tuple(r) for r in read_nested_zip(spark, str(tmp_path / "o.zip"), ["b", "c"]).collect()} == {("2", None), ("4", None)}
    (tmp_path / "f.txt").write_text("head\n,M,S\n202001, 1.00, -2.5\n202002,3,x\n2020,9,9\n")
    got = [tuple(r) for r in read_factor_text(spark, str(tmp_path / "f.txt"), ["m", "s"]).orderBy("date").collect()]
    assert got == [(dt.date(2020, 1, 31), 0.01, -0.025), (dt.date(2020, 2, 29), 0.03, None)]
    (tmp_path / "s.txt").write_text(" 1 Agric  Farming\n          0100-0199 Crops\n          0200-0299 Stock\n\n12 Food  Food\n          2000-2009 Meat\n")
    got = [(r.sic_low, r.industry) for r in read_code_ranges(spark, str(tmp_path / "s.txt"), 2).orderBy("line").collect()]
    assert got == [(100, "01_Agric"), (200, "01_Agric"), (2000, "12_Food")]
    with pytest.raises(ValueError):
        read_code_ranges(spark, str(tmp_path / "s.txt"), 49)


@pytest.fixture(scope="module")
def panel(spark):
    dates = [d.date() for d in pd.date_range("2018-01-31", periods=12, freq="ME")]
    rows = [(d, a, float(RNG.normal()), float(RNG.random() * 100), float(RNG.normal() / 20), int(a % 3)) for d in dates for a in range(40)]
    return spark.createDataFrame(rows, "date date, asset_id int, exposure double, market_equity double, ret double, industry int")


def test_rules(panel):
    out = apply_rules(panel, [Outliers(("exposure",)), Missing(("exposure",), "mean"), Standardise(("exposure",)), Neutralise("exposure", ("market_equity",), "industry")])
    d = out.toPandas()
    assert {"exposure_outlier", "exposure_was_missing", "exposure_z", "exposure_neutral"} <= set(d)
    assert np.allclose(d.groupby("date").exposure_z.mean(), 0, atol=1e-9) and np.allclose(d.groupby(["date", "industry"]).exposure_neutral.sum(), 0, atol=1e-8)
    assert Outliers(("exposure",), by=()).apply(panel).count() == 480
    with pytest.raises(ValueError):
        Missing(("exposure",), "ffill").apply(panel)


def test_factor_and_report(spark, panel, tmp_path):
    f = BucketFactor("x", buckets=5, min_count=5).build(panel)
    h = f.holdings.toPandas()
    legs = h[h.portfolio == "HL"].groupby(["rebalance_date", "leg"]).weight.sum().unstack()
    assert np.allclose(legs.long, 1) and np.allclose(legs.short, -1)
    assert np.allclose(h[h.portfolio != "HL"].groupby(["rebalance_date", "portfolio"]).weight.sum(), 1)
    with pytest.raises(ValueError):
        Factor("y", f.holdings.drop("leg"))
    with pytest.raises(TypeError):
        Backtest(panel.withColumn("date", panel["asset_id"]))
    b = Backtest(panel.select("date", "asset_id", "ret"))
    t = report_tables(f, panel.select("date", "asset_id", "exposure"), b)
    assert t["summary"].count() == 6 and t["ic"].count() == 11 and t["fit"].count() == 11
    write_csv({"summary": t["summary"]}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 6
    assert "| portfolio |" in markdown(t["summary"]).replace("|  |", "|")


def test_options(spark):
    fr = [dt.date(2024, 1, 19), dt.date(2024, 2, 16)]
    days = [d.date() for d in pd.bdate_range("2024-01-15", "2024-02-20")]
    prices = spark.createDataFrame([("T", d, 100.0 + i) for i, d in enumerate(days)], "ticker string, date date, spot double")
    rolls = {(r.entry_date, r.exit_date) for r in roll_pairs(prices).collect()}
    assert (dt.date(2024, 1, 22), fr[1]) in rolls
    rows = [("T", d, o, dt.date(2024, 3, 15), "C", 4.0 + o + 0.1 * i, 4.2 + o + 0.1 * i, 10, 100.0, 0.3 + 0.2 * o) for i, d in enumerate(days) for o in (0, 1)]
    q = spark.createDataFrame(rows, "ticker string, date date, optionid int, exdate date, cp_flag string, best_bid double, best_offer double, open_interest int, contract_size double, delta double")
    t = trades(tradable(q), prices, roll_pairs(prices)).where("entry_date = date'2024-01-22'")
    i, j = days.index(dt.date(2024, 1, 22)), days.index(fr[1])
    one = t.where("optionid = 0").first()
    assert one.dh_ret == pytest.approx((0.1 * (j - i) - 0.3 * (j - i)) / (4.1 + 0.1 * i)) and one.delta_band == "OTM"
    h = hedge_daily(t, tradable(q), prices).where("optionid = 0").first()
    assert h.dh_ret == pytest.approx(one.dh_ret) and h.n_daily_obs == j - i + 1
    assert band_table(t).count() == 2
    by, total = low_leverage_spread(t)
    g = by.first()
    assert total.first().ret == pytest.approx(g.low_ret / g.low_omega - g.high_ret / g.high_omega)
    x = spark.createDataFrame([(1, "a", 0.02), (1, "b", 0.03), (1, "c", 0.01), (2, "a", 0.02)], "date int, ticker string, excess double")
    got = {(r.date, r.pair): r.spread for r in levered_pairs(x, spark.createDataFrame([("p", "a", "b"), ("q", "c", "b")], "pair string, one_fold string, two_fold string")).collect()}
    assert got == pytest.approx({(1, "p"): 0.005, (1, "q"): -0.005, (1, "ALL"): 0.0}, abs=1e-12)


def test_allocation_kernels():
    m = np.array([[2, 0.4], [0.4, 1]])
    half = np.column_stack([Spectrum(m).filtered(e, -0.5) for e in np.eye(2)])
    assert np.allclose(half @ m @ half, np.eye(2)) and np.allclose(Spectrum(m).filtered(np.array([1.0, 2.0]), -1), np.linalg.solve(m, [1, 2]))
    flat = Spectrum(np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert np.allclose(flat.filtered(np.array([1.0, -1.0]), -1), 0) and np.allclose(flat.filtered(np.array([1.0, 1.0]), -1), 0.5)
    x = RNG.normal(size=(50, 4))
    s, emp = shrunk_correlation(x), np.cov(x, rowvar=False, ddof=0)
    assert 0 <= s[0, 1] / emp[0, 1] <= 1 and np.trace(s) == pytest.approx(np.trace(emp))
    assert np.allclose(shrunk_correlation(np.tile([[1.0], [-1.0]], (9, 3)) * [1, 1, 1])[0, 0], 1)
    got = positions(x, 12, 0.03)
    assert list(got) == list(RULES) and all(v.sum() == pytest.approx(1) for _, v in got.values()) and positions(np.zeros((50, 4)), 12, 0.03) == {}
    # closed forms: risk is the target's, and each rule is its own system of equations
    scale = x.std(axis=0, ddof=1)
    z = x / scale
    c, signal = shrunk_correlation(z), z[-12:].mean(axis=0)
    for rule, unit in {"equal_risk_signal": signal, "markowitz_clean": np.linalg.solve(c, signal), "markowitz_raw": np.linalg.solve(np.cov(z, rowvar=False), signal)}.items():
        w = unit / scale
        assert np.allclose(got[rule][0], w * 0.03 / np.sqrt(unit @ c @ unit))
    draws = np.mean([inverse_wishart(np.random.default_rng(i), 30, m * 30) for i in range(3000)], axis=0)
    assert np.allclose(draws, m * 30 / (30 - 2 - 1), rtol=0.05)


def test_risk_parity(spark):
    x = RNG.normal(0.004, 0.04, (90, 5))
    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), f"f{k}", float(x[i, k])) for i in range(90) for k in range(5)]
    returns, weights, risk = risk_parity(spark.createDataFrame(rows, "date date, factor string, ret double"), covariance_window=48)
    d = returns.toPandas()
    assert d.date.nunique() == 54 and d.date.min() == dt.date(2003, 1, 1)
    w = weights.toPandas().pivot_table(index=["strategy", "date"], columns="factor", values="weight")
    moved = w.loc["ARP"].diff().fillna(w.loc["ARP"].iloc[:1]).abs().sum(axis=1)
    got = d[d.strategy == "ARP"].set_index("date").turnover.sort_index()
    assert np.allclose(moved, got)
    assert np.allclose(risk.toPandas().groupby(["date", "strategy"]).risk_share.sum(), 1)


def test_spike_and_slab():
    rng = np.random.default_rng(5)
    f = np.column_stack([rng.normal(0.02, 0.04, 240), rng.normal(0.0, 0.04, 240)])
    r = np.outer(f[:, 0], rng.uniform(0.2, 2, 12)) + np.outer(f[:, 1], rng.uniform(-1, 1, 12)) + rng.normal(0, 0.02, (240, 12))
    psi = prior_scale(f, r, 0.05)
    rho = np.corrcoef(np.hstack([r, f]), rowvar=False)[:12, 12:]
    eta = 0.5 * ((rho - rho.mean(axis=0)) ** 2).sum() / 12
    top = r.mean(axis=0) @ np.linalg.solve(np.cov(r, rowvar=False), r.mean(axis=0))
    assert psi * eta / (1 + psi * eta) * top == pytest.approx(0.05**2)
    p = spike_and_slab(f, r, draws=1500, burn=300, psi=20.0)
    assert p.inclusion.shape == (1200, 2) and p.price.shape == (1200, 2) and p.sdf.mean() == pytest.approx(1) and np.isfinite(p.sdf).all()
    assert p.inclusion[:, 0].mean() > p.inclusion[:, 1].mean() and p.price[:, 0].mean() > 0.1
    d = pricing_diagnostics(r, p)
    assert d["pricing_error_reduction"] > 0.3 and 0 <= d["max_split_inclusion_difference"] <= 1 and d["mean_model_size"] == pytest.approx(p.inclusion.sum(axis=1).mean())
    for bad in ({"assets": r[:, :2]}, {"draws": 5, "burn": 5}, {"factors": f[:10], "assets": r[:10]}):
        with pytest.raises(ValueError):
            spike_and_slab(**{"factors": f, "assets": r, "draws": 10, "burn": 1, **bad})


def test_rolling_residual(spark):
    x = RNG.normal(size=(80, 2))
    y = 0.3 + x @ [1.0, -2.0] + RNG.normal(size=80) * 0.1
    y[[5, 30]] = np.nan
    rows = [(1, i, None if np.isnan(y[i]) else float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(80)]
    d = spark.createDataFrame(rows, "a int, t int, y double, u double, v double")
    got = rolling_residual(d, along("a", "t"), "y", ["u", "v"], 36, 24, "e").toPandas().sort_values("t").e.astype(float).to_numpy()
    for i in range(80):
        lo = max(0, i - 35)
        ok = np.isfinite(y[lo : i + 1])
        if np.isfinite(y[i]) and ok.sum() >= 24:
            z = np.column_stack([np.ones(ok.sum()), x[lo : i + 1][ok]])
            b = np.linalg.lstsq(z, y[lo : i + 1][ok], rcond=None)[0]
            assert got[i] == pytest.approx(y[i] - np.r_[1, x[i]] @ b)
        else:
            assert np.isnan(got[i])


def test_summary_plots_and_limits(spark, tmp_path):
    from panelweave.operators.cross_section import outlier_limits
    from panelweave.operators.factor import Backtest, BucketFactor
    from panelweave.plans.report import line_plot, report_tables, write_plots, write_summary

    rng = np.random.default_rng(2)
    months = [dt.date(2020 + k // 12, k % 12 + 1, 28) for k in range(30)]
    rows = [(m, a, float(rng.normal()), float(rng.normal(0.01, 0.05)), float(a + 1)) for m in months for a in range(20)]
    d = spark.createDataFrame(rows, "date date, asset_id int, exposure double, ret double, market_equity double")
    f = BucketFactor("noise", buckets=4, limits=None).build(d)
    b = Backtest(d.select("date", "asset_id", "ret"))
    text = open(write_summary(f, d, b, str(tmp_path)), encoding="utf-8").read()
    assert text.startswith("# noise") and text.count("## ") == 5 and "| HL |" in text and "| 2021 |" in text
    pages = [open(p, encoding="utf-8").read() for p in write_plots(report_tables(f, d, b), str(tmp_path))]
    assert len(pages) == 2 and all(p.count("<polyline") == 5 for p in pages)
    assert "<polyline" not in line_plot(d.limit(0), "date", ["ret"], "<empty>")
    x = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, float("nan"), None]], "v double")
    assert outlier_limits(x, "v", "boxplot") == pytest.approx((1.75 - 1.5 * 1.5, 3.25 + 1.5 * 1.5))
    assert outlier_limits(x.limit(0), "v", "std") == (float("-inf"), float("inf"))
    assert outlier_limits(x, "v", "quantile", lower=None, upper=None) == (1.0, 4.0)
