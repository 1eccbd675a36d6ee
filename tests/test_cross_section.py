"""Cross-sectional operators against pandas and NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators.cross_section import average_ranks, bounds, bucket_codes, clip_outliers, cut, fill_missing, quantiles, ranks, size_buckets, zscore
from panelweave.operators.regression import group_ols, residuals, series_ols


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(4)
    d = pd.DataFrame({"g": rng.integers(0, 5, 800), "id": np.arange(800), "x": rng.standard_t(3, 800), "z": rng.normal(size=800) * 1e6, "c": rng.integers(0, 4, 800)})
    d["y"] = 0.5 * d.x - 2e-6 * d.z + 0.3 * d.c + rng.normal(size=800)
    d.loc[::10, "x"] = np.nan
    d.loc[:60, "x"] = d.x[:61].round(0)
    return d


def to_spark(spark, d):
    return spark.createDataFrame(d.astype(object).where(d.notna(), None), "g int, id int, x double, z double, c int, y double" + (", k int" if "k" in d else ""))


@pytest.mark.parametrize("n", [3, 7, 10, 11, 29, 57, 100, 271])
@pytest.mark.parametrize("k", [3, 5, 10])
def test_buckets_equal_qcut(spark, n, k):
    rng = np.random.default_rng(n * k)
    x = rng.normal(size=n)
    x[: n // 7] = x[: n // 7].round(0)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, id int, x double")
    got = [r.code for r in bucket_codes(df, ["g"], "x", k, ["id"]).orderBy("id").collect()]
    want = [None] * n if n < k else pd.qcut(pd.Series(x).rank(method="first"), k, labels=False).tolist()
    assert got == want


def test_ranks_split_by_value_equal_plain_ranks(spark, panel):
    df = to_spark(spark, panel)
    df = df.unionByName(spark.range(10_000, 10_400).selectExpr("*").withColumns({c: F.lit(None).cast(t) for c, t in df.dtypes if c != "id"}).withColumns({"g": F.lit(df.first().g), "x": F.lit(0.5)}).select(*[F.col(c).cast(t) for c, t in df.dtypes]))  # a run of equal values
    a = {r.id: (r["_rank"], r["_n"]) for r in ranks(df, ["g"], "x", ["id"], bounded=True).collect()}
    b = {r.id: (r["_rank"], r["_n"]) for r in ranks(df, ["g"], "x", ["id"]).collect()}
    assert a == b and len(a) == df.count()
    assert ranks(df.limit(0), ["g"], "x", ["id"]).count() == 0
    avg = lambda bounded: {r.id: r.k for r in average_ranks(df, ["g"], "x", "k", bounded=bounded).collect()}
    assert avg(True) == avg(False)


def test_quantiles_and_bounds(spark, panel):
    df = to_spark(spark, panel)
    for bounded in (True, False):
        got = quantiles(df, ["g"], "x", [0.05, 0.5], ["a", "b"], bounded=bounded).toPandas().set_index("g").sort_index()
        want = panel.groupby("g").x.quantile([0.05, 0.5]).unstack()
        assert np.allclose(got.to_numpy(), want.to_numpy())
    got = bounds(df, ["g"], "x", "mad").toPandas().set_index("g").sort_index()
    med = panel.groupby("g").x.median()
    mad = (panel.x - panel.g.map(med)).abs().groupby(panel.g).median() * 1.4826
    assert np.allclose(got.hi, med + 3.5 * mad) and np.allclose(got.lo, med - 3.5 * mad)
    same = bounds(df, ["g"], "x", "Median_MAD", bounded=False).toPandas().set_index("g").sort_index()
    assert np.allclose(got.hi, same.hi)


def test_no_scale_no_bound(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (None, 5.0)], "g int, x double")
    for m in ("std", "mad", "iqr"):
        rows = {r.g: r for r in bounds(df, ["g"], "x", m).collect()}
        assert rows[1].lo is None and rows[2].hi is None
    out = clip_outliers(df, ["g"], "x", "quantile")
    assert out.count() == 4 and out.where("g is null").first().x == 5.0


def test_zscore_and_average_ranks(spark, panel):
    got = zscore(to_spark(spark, panel), ["g"], "x", "zs").toPandas().sort_values("id").zs.astype(float)
    want = panel.groupby("g").x.transform(lambda s: (s - s.mean()) / s.std())
    assert np.allclose(got, want, equal_nan=True)
    got = average_ranks(to_spark(spark, panel), ["g"], "x", "rk", pct=True).toPandas().sort_values("id").rk.astype(float)
    assert np.allclose(got, panel.groupby("g").x.rank(pct=True), equal_nan=True)


def test_residuals_equal_dummy_regression(spark, panel):
    got = residuals(to_spark(spark, panel), ["g"], "y", ["x", "z"], "e", category="c").toPandas().sort_values("id").e.astype(float).to_numpy()
    for g, d in panel.dropna(subset=["x"]).groupby("g"):
        design = np.column_stack([d.x, d.z, pd.get_dummies(d.c).to_numpy(float)])
        e = d.y - design @ np.linalg.pinv(design, rcond=1e-13) @ d.y
        assert np.allclose(got[d.index], e, atol=1e-6)
    assert np.isnan(got[panel.x.isna()]).all()


def test_residuals_with_two_categories(spark, panel):
    d2 = panel.assign(k=panel.index % 3)
    got = residuals(to_spark(spark, d2), ["g"], "y", ["x", "z"], "e", category=["c", "k"]).toPandas().sort_values("id").e.astype(float).to_numpy()
    for g, d in d2.dropna(subset=["x"]).groupby("g"):
        design = np.column_stack([d.x, d.z, pd.get_dummies(d.c).to_numpy(float), pd.get_dummies(d.k).to_numpy(float)])
        e = d.y - design @ np.linalg.lstsq(design, d.y, rcond=None)[0]
        assert np.allclose(got[d.index], e, atol=1e-6)
    assert np.isnan(got[panel.x.isna()]).all()
    with pytest.raises(ValueError):
        residuals(to_spark(spark, d2), ["g"], "y", ["x"], "e", category="c", intercept=False)
    assert residuals(to_spark(spark, d2).limit(0), ["g"], "y", ["x"], "e", category=["c", "k"]).count() == 0


def test_group_ols_and_min_obs(spark, panel):
    f = group_ols(to_spark(spark, panel), ["g"], "y", ["x", "z"], min_obs=30).toPandas().set_index("g")
    for g, d in panel.dropna(subset=["x"]).groupby("g"):
        fit = series_ols(d.y.to_numpy(), d[["x", "z"]].to_numpy())
        assert np.allclose([f.alpha[g], f.beta_x[g], f.beta_z[g], f.r2[g]], [*fit["coef"], fit["r2"]], rtol=1e-6)
    assert group_ols(to_spark(spark, panel), ["g"], "y", ["x"], min_obs=10_000).count() == 0


def test_fill_methods(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, None), (1, 4, None), (1, 5, 5.0), (2, 1, None)], "a int, t int, x double")
    fill = lambda m, **k: [r.x for r in fill_missing(df, "x", m, **k).orderBy("a", "t").collect()]
    assert fill("ffill", by=["a"], order="t", limit=2) == [1.0, 1.0, 1.0, None, 5.0, None]
    assert fill("bfill", by=["a"], order="t", limit=1) == [1.0, None, None, 5.0, 5.0, None]
    assert fill("mean", by=["a"]) == [1.0, 3.0, 3.0, 3.0, 5.0, None]
    assert fill("median", by=["a"])[1] == 3.0 and fill("zero")[1] == 0.0 and fill("value", value=9.0)[5] == 9.0
    with pytest.raises(ValueError):
        fill_missing(df, "x", "ffill")


def test_size_buckets(spark):
    rows = [(1, 1, 1.0, 0.1), (2, 1, 2.0, 0.2), (3, 1, 3.0, 0.3), (4, 1, 4.0, 0.4), (5, 3, 1.5, 0.05), (6, 2, 9.0, 0.9), (7, 2, None, 0.9)]
    d = spark.createDataFrame([("d", *r) for r in rows], "rebalance_date string, asset_id int, exchange_code int, market_equity double, c double")
    got = {r.asset_id: r.group for r in size_buckets(d, ["rebalance_date"], "c").collect()}
    assert got[5] == "SL" and got[6] == "BH" and got[7] is None
    assert size_buckets(d.where("exchange_code <> 1 or asset_id = 1"), ["rebalance_date"], "c").count() == 0


def test_cut(spark):
    d = spark.createDataFrame([(0.0,), (0.2,), (0.5,), (1.0,), (1.1,), (None,)], "x double")
    assert [r.b for r in d.select(cut(F.col("x"), [0, 0.2, 0.6, 1.0], ["a", "b", "c"], include_lowest=True).alias("b")).collect()] == ["a", "a", "b", "c", None, None]
