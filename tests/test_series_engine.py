"""Time series, engine, statistics and joins against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.functions.dates import session_minute, third_friday
from panelweave.functions.keys import assert_unique, join_unique, keep_last
from panelweave.operators.asof import asof_backward, code_of_range
from panelweave.operators.portfolio import forward_returns, holding_periods, simulate_drift, simulate_fixed, simulate_layers, turnover
from panelweave.operators.realized import moments_of_returns, tick_filter
from panelweave.operators.regression import series_ols
from panelweave.operators.statistics import information_coefficient, newey_west, performance
from panelweave.operators.time_series import along, long_rolling_corr, long_rolling_std, never_backwards, rolling_compound, strict_compound, trailing_year, year_to_quarter

RNG = np.random.default_rng(8)
DATES = [d.date() for d in pd.bdate_range("2020-01-01", periods=60)]
RET = pd.DataFrame(RNG.normal(0.0005, 0.02, (60, 12)), index=DATES, columns=range(12)).mask(RNG.random((60, 12)) < 0.05)


def long(spark, m):
    rows = [(d, int(a), None if np.isnan(v) else float(v)) for d, r in m.iterrows() for a, v in r.items()]
    return spark.createDataFrame(rows, "date date, asset_id int, ret double")


def book(spark, w):
    return spark.createDataFrame([(d, "p", int(a), float(v)) for d, r in w.iterrows() for a, v in r.items()], "rebalance_date date, portfolio string, asset_id int, weight double")


W = pd.DataFrame(RNG.random((3, 12)), index=[DATES[0], DATES[20], DATES[40]], columns=range(12)).pipe(lambda x: x.div(x.sum(axis=1), axis=0))


def test_holding_periods(spark):
    dates = spark.createDataFrame([(d,) for d in DATES[:10]], "date date")
    reb = spark.createDataFrame([(DATES[i],) for i in (0, 4, 7)], "rebalance_date date")
    got = {r.date: (r.rebalance_date, r.is_first) for r in holding_periods(reb, dates).collect()}
    assert DATES[0] not in got
    assert [DATES.index(got[d][0]) for d in DATES[1:10]] == [0, 0, 0, 0, 4, 4, 4, 7, 7]
    assert [d for d in DATES[:10] if d in got and got[d][1]] == [DATES[1], DATES[5], DATES[8]]


def test_fixed_weights(spark):
    got = {r.date: r for r in simulate_fixed(book(spark, W), long(spark, RET)).collect()}
    for i in range(1, 60):
        w = W.iloc[[k for k, d in enumerate(W.index) if d < DATES[i]][-1]]
        assert got[DATES[i]].ret == pytest.approx((w * RET.iloc[i].fillna(0)).sum()) and got[DATES[i]].n_assets == RET.iloc[i].notna().sum()


def test_drift_is_buy_and_hold_with_cost(spark):
    out, turn = simulate_drift(book(spark, W), long(spark, RET), 10.0)
    got = {r.date: r.ret for r in out.collect()}
    t = {r.rebalance_date: r for r in turn.collect()}
    prev = pd.Series(0.0, index=W.columns)
    for k, (d, w) in enumerate(W.iterrows()):
        lo, hi = DATES.index(d) + 1, DATES.index(W.index[k + 1]) + 1 if k < 2 else 60
        turned = (w - prev).abs().sum() / 2
        assert t[d].turnover == pytest.approx(turned)
        growth, nav = pd.Series(1.0, index=W.columns), 1.0
        for i in range(lo, hi):
            growth *= 1 + RET.iloc[i].fillna(0)
            now = 1 + (w * (growth - 1)).sum()
            assert got[DATES[i]] == pytest.approx(now / nav - 1 - (2 * turned * 10 / 1e4 if i == lo else 0))
            nav = now
        prev = w * growth / nav


def test_turnover_layers_forward(spark):
    got = {r.rebalance_date: r.turnover for r in turnover(book(spark, W)).collect()}
    assert got[W.index[0]] == pytest.approx(0.5) and got[W.index[2]] == pytest.approx((W.iloc[2] - W.iloc[1]).abs().sum() / 2)
    r = long(spark, RET).withColumn("b", F.col("asset_id") + 1.0)
    members = book(spark, W).where("asset_id < 4").drop("weight")
    lay = {x.date: x.ret for x in simulate_layers(members, r, "b").collect()}
    assert lay[DATES[5]] == pytest.approx((RET.iloc[5, :4].fillna(0) * [1, 2, 3, 4]).sum() / 10)
    fw = {(x.rebalance_date, x.asset_id): x.forward for x in forward_returns(book(spark, W), long(spark, RET)).collect()}
    assert fw[W.index[0], 3] == pytest.approx((1 + RET.iloc[1:21, 3]).prod() - 1)


def test_compounding(spark):
    d = spark.createDataFrame([(1, t, x) for t, x in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])] + [(2, t, x) for t, x in enumerate([0.1, -1.0, None, 0.2])], "a int, t int, ret double")
    w = along("a", "t")
    got = [r.v for r in d.select("a", "t", rolling_compound("ret", w, 2, 1, 2).alias("v")).orderBy("a", "t").collect()]
    assert got[:2] == [None, None] and got[2:5] == pytest.approx([1.1 * 1.2 - 1, 1.2 * 1.3 - 1, 1.3 * 1.4 - 1])
    got = [r.v for r in d.select("a", "t", strict_compound("ret", w, 2, 0).alias("v")).where("a = 2").orderBy("t").collect()]
    assert got == [None, -1.0, None, None]


def test_long_windows(spark):
    x = pd.DataFrame({"x": RNG.normal(size=300), "y": RNG.normal(size=300)}).mask(RNG.random((300, 2)) < 0.1)
    d = spark.createDataFrame([(1, i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x.to_numpy())], "a int, t int, x double, y double")
    got = long_rolling_corr(d, "a", "t", "x", "y", 40, 20, "c").toPandas().sort_values("t").c.astype(float)
    assert np.allclose(got, x.x.rolling(40, min_periods=20).corr(x.y), equal_nan=True)
    got = long_rolling_std(d, "a", "t", "x", 40, 20, "c").toPandas().sort_values("t").c.astype(float)
    assert np.allclose(got, x.x.rolling(40, min_periods=20).std(), equal_nan=True)


def test_quarters(spark):
    q = [("1", dt.date(2008, 12, 31), 2008, 4, 40.0), ("1", dt.date(2009, 3, 31), 2009, 1, 10.0), ("1", dt.date(2009, 6, 30), 2009, 2, 25.0), ("1", dt.date(2009, 9, 30), 2009, 3, 30.0), ("1", dt.date(2009, 12, 31), 2009, 4, 50.0)]
    d = year_to_quarter(spark.createDataFrame(q, "k string, d date, y int, q int, x double"), "k", "d", "y", "q", "x", "o")
    assert [r.o for r in d.orderBy("d").collect()] == [None, 10.0, 15.0, 5.0, 20.0]
    assert [r.s for r in trailing_year(d, "k", "d", "o", "s").orderBy("d").collect()] == [None, None, None, None, 50.0]
    p = spark.createDataFrame([(1, dt.date(2020, 5, 1), dt.date(2020, 3, 31)), (1, dt.date(2020, 7, 1), dt.date(2020, 6, 30)), (1, dt.date(2020, 8, 1), dt.date(2020, 3, 31))], "a int, k date, p date")
    assert never_backwards(p, "a", "k", "p").count() == 2


@pytest.mark.parametrize("span", [None, "year", "month"])
def test_asof(spark, span):
    left = pd.DataFrame({"k": RNG.integers(0, 4, 200), "t": pd.to_datetime("2020-01-01") + pd.to_timedelta(RNG.integers(0, 900, 200), "D"), "v": range(200)})
    right = pd.DataFrame({"k": RNG.integers(0, 3, 60), "t": pd.to_datetime("2020-01-01") + pd.to_timedelta(RNG.choice(900, 60, replace=False), "D"), "v": RNG.random(60)})
    to = lambda d, kind: spark.createDataFrame([(int(r.k), r.t.date(), kind(r.v)) for r in d.itertuples()], f"k int, t date, v {'int' if kind is int else 'double'}")
    got = asof_backward(to(left, int), to(right, float), ["k"], "t", "t", ["v"], span=span).toPandas().sort_values("v").v_right.astype(float)
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", suffixes=("", "_right")).sort_values("v").v_right
    assert np.allclose(got, want, equal_nan=True)


def test_statistics(spark):
    x = pd.DataFrame({"date": np.repeat(DATES[:20], 15), "s": RNG.normal(size=300).round(1), "f": RNG.normal(size=300)})
    d = spark.createDataFrame(x)
    for kind in ("pearson", "spearman"):
        got = {r.date: r.ic for r in information_coefficient(d, ["date"], "s", "f", kind).collect()}
        want = x.groupby("date").apply(lambda g: g.s.corr(g.f) if kind == "pearson" else g.s.rank().corr(g.f.rank()))
        assert np.allclose([got[k] for k in want.index], want)
    flat = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "date int, s double, f double")
    assert information_coefficient(flat, ["date"], "s", "f").first().ic is None


def test_newey_west(spark):
    e = RNG.normal(0, 0.05, 240)
    y = np.zeros(240)
    for i in range(240):
        y[i] = 0.01 + (0.4 * (y[i - 1] - 0.01) if i else 0) + e[i]
    r = newey_west(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "k int, t int, x double"), ["k"], "t", "x").first()
    u, lags = y - y.mean(), int(4 * (240 / 100) ** (2 / 9))
    v = (u @ u + 2 * sum((1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1))) / 240 / 240
    assert r.se == pytest.approx(np.sqrt(v)) and r.t == pytest.approx(y.mean() / np.sqrt(v))
    p = performance(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t int, x double"), ["k"], "t", "x").first()
    wealth = np.cumprod(1 + y)
    assert p.max_drawdown == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min()) and p.ann_vol == pytest.approx(y.std(ddof=1) * 12**0.5)


def test_keys(spark):
    d = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 2, 7.0), (2, None, 3.0)], "k int, o int, v double")
    assert {(r.k, r.v) for r in keep_last(d, ["k"], ["o"]).collect()} == {(1, 7.0), (2, 3.0)}
    with pytest.raises(ValueError):
        assert_unique(d, ["k"])
    with pytest.raises(ValueError):
        join_unique(d, d, ["k"])


def test_ticks_moments_codes_dates(spark):
    rows = [(1, t, 16.0 if t == 4 else 10.0, 10.0) for t in range(8)] + [(2, t, 10.0 if t < 4 else 20.0, 10.0) for t in range(8)]
    out = tick_filter(spark.createDataFrame(rows, "s int, t int, p double, ref double"), ["s"], "t", "p", "ref")
    assert {(r.s, r.t) for r in out.collect()} == {(s, t) for s, t, *_ in rows} - {(1, 4)}
    x = RNG.normal(size=50)
    m = moments_of_returns(spark.createDataFrame([(1, float(v)) for v in x], "s int, r double"), ["s"], "r", 5).first()
    assert m.rsk == pytest.approx(50**0.5 * (x**3).sum() / (x**2).sum() ** 1.5) and m.rkt == pytest.approx(50 * (x**4).sum() / (x**2).sum() ** 2)
    ranges = spark.createDataFrame([(0, 99, "a", 0), (50, 60, "b", 1)], "lo int, hi int, name string, o int")
    codes = code_of_range(spark.createDataFrame([(10.0,), (55.0,), (500.0,), (None,)], "c double"), ranges, "c", "lo", "hi", "name", "o")
    assert {(r.c, r.name) for r in codes.collect()} == {(10.0, "a"), (55.0, "b")}
    t = spark.createDataFrame([("2024-07-01 13:30:00",), ("2024-01-02 14:30:00",)], "t string").select(session_minute(F.to_timestamp("t")).alias("m"))
    assert [r.m for r in t.collect()] == [0, 0]
    assert spark.range(1).select(third_friday(F.lit("2024-03-05").cast("date")).alias("d")).first().d == dt.date(2024, 3, 15)


def test_hac_errors():
    x, e = RNG.normal(size=200), RNG.normal(size=200)
    y = 0.2 + 0.5 * x + np.convolve(e, [1, 0.6, 0.3], "same")
    fit = series_ols(y, x, lags=3)
    z = np.column_stack([np.ones(200), x])
    u = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    meat = sum((1 - abs(i - j) / 4) * u[i] * u[j] * np.outer(z[i], z[j]) for i in range(200) for j in range(max(0, i - 3), min(200, i + 4)))
    inv = np.linalg.inv(z.T @ z)
    assert np.allclose(fit["se"], np.sqrt(np.diag(inv @ meat @ inv)))
    plain = series_ols(y, x)
    assert np.allclose(plain["se"], np.sqrt(np.diag(inv) * (u @ u) / 198)) and np.allclose(plain["coef"], fit["coef"])


def test_spread_needs_both_sides(spark):
    from panelweave.operators.portfolio import assert_layers, layer_spread, next_period_returns, sorted_legs, spread

    w = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 1, 0.5), (1, 3, -1, 1.0), (2, 1, 1, 1.0), (3, 4, -1, 0.0), (3, 1, 1, 1.0)], "d int, asset_id int, side int, weight double")
    got = {(r.d, r.asset_id): r.weight for r in spread(w, ["d"], "side", "HL").collect()}
    assert got == {(1, 1): 0.5, (1, 2): 0.5, (1, 3): -1.0}
    c = spark.createDataFrame([(1, i, i % 5, float(i + 1)) for i in range(10)], "d int, asset_id int, code int, me double")
    legs = sorted_legs(c, ["d"], "code", [3, 4], [0], "me", "HL").collect()
    assert sum(r.weight for r in legs if r.leg == "long") == pytest.approx(1) and sum(r.weight for r in legs if r.leg == "short") == pytest.approx(-1) and len(legs) == 6
    with pytest.raises(ValueError):
        assert_layers(spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "rebalance_date int, portfolio string, asset_id int"))
    layers = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.3), (2, "a", 0.1)], "date int, portfolio string, ret double")
    assert {r.date: r.ret for r in layer_spread(layers, {"a": -1.0, "b": 1.0}, "s").collect()} == pytest.approx({1: 0.2, 2: 0.0})
    import datetime as dt

    days = [dt.date(2020, 1, n) for n in (1, 2, 3, 4)]
    rets = spark.createDataFrame([(d, 1, float(i)) for i, d in enumerate(days)], "date date, asset_id int, ret double")
    sig = spark.createDataFrame([(days[0],), (days[2],), (days[3],)], "rebalance_date date")
    assert {r.rebalance_date: r.forward for r in next_period_returns(sig, rets).collect()} == {days[0]: 1.0, days[2]: 3.0}


def test_newey_west_with_many_lags(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(0.1, 1, 90).cumsum() * 0.05
    for lags in (0, 36, 200):
        e = y - y.mean()
        v = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, min(lags, 89) + 1))
        r = newey_west(spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(y)] + [(0, 900, None)], "k int, t int, x double"), ["k"], "t", "x", lags).first()
        assert r.n == 90 and (r.se == pytest.approx(np.sqrt(v) / 90) if v > 0 else r.se is None)


def test_next_in_calendar_has_no_bounds(spark):
    import datetime as dt

    from panelweave.operators.asof import calendar, next_in_calendar

    d = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    cal = calendar(spark.createDataFrame([(d(0),), (d(1),), (d(900),)], "date date"), "date")
    e = spark.createDataFrame([(k, d(n)) for k, n in enumerate((-5000, -1, 0, 1, 2, 900, 901))] + [(9, None)], "k int, t date")
    assert {r.k: r.position for r in next_in_calendar(e, cal, "t", "date").collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2}
    assert {r.k: r.position for r in next_in_calendar(e, cal, "t", "date", strict=True).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
