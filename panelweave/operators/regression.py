"""Least squares per group: cross products are summed by Spark, only small systems are solved in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.cross_section import demean, with_group


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Coefficients of the normal equations, columns scaled to unit length, singular directions left out."""
    size = np.sqrt(np.clip(np.diagonal(xx, axis1=-2, axis2=-1), 0, None))
    size = np.where(size > 0, size, 1.0)
    scaled = xx / (size[..., :, None] * size[..., None, :])
    return (np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) @ (xy / size)[..., None])[..., 0] / size


def _products(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _coefficients(xx: pd.Series, xy: pd.Series) -> pd.Series:
    b = np.array(xy.to_list(), dtype=float)
    if not len(b):
        return pd.Series([], dtype=object)
    p = b.shape[1]
    flat = np.array(xx.to_list(), dtype=float)
    m = np.empty((len(b), p, p))
    for k, (i, j) in enumerate(_products(p)):
        m[:, i, j] = m[:, j, i] = flat[:, k]
    return pd.Series(list(solve(m, b)))


def group_ols(df: DataFrame, by: list[str], y: str, xs: list[str], intercept: bool = True, min_obs: int = 1) -> DataFrame:
    """(by..., n, beta_<x>..., alpha, r2) over the complete rows of each group with at least min_obs of them.

    The fit is on values less their group mean when there is an intercept, so r2 is centred then. alpha is null without.
    """
    full = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs])).select(*by, y, *xs)
    n = F.count(F.lit(1)).alias("n")
    means = full.groupBy(*by).agg(n, F.avg(y).alias("_y"), *[F.avg(x).alias(f"_x{i}") for i, x in enumerate(xs)]).where(F.col("n") >= min_obs)
    d = full.join(means, by)
    dev = [F.col(x) - F.col(f"_x{i}") if intercept else F.col(x) for i, x in enumerate(xs)]
    dy = F.col(y) - F.col("_y") if intercept else F.col(y)
    p = len(xs)
    sums = d.groupBy(*by).agg(
        F.array(*[F.sum(dev[i] * dev[j]) for i, j in _products(p)]).alias("_xx"), F.array(*[F.sum(v * dy) for v in dev]).alias("_xy"), F.sum(dy * dy).alias("_yy"), *[F.first(c).alias(c) for c in ["n", "_y", *[f"_x{i}" for i in range(p)]]]
    )
    fit = sums.withColumn("_b", _coefficients("_xx", "_xy"))
    explained = sum((F.col("_b")[i] * F.col("_xy")[i] for i in range(p)), F.lit(0.0))
    alpha = F.col("_y") - sum((F.col("_b")[i] * F.col(f"_x{i}") for i in range(p)), F.lit(0.0)) if intercept else F.lit(None).cast("double")
    return fit.select(*by, "n", *[F.col("_b")[i].alias(f"beta_{x}") for i, x in enumerate(xs)], alpha.alias("alpha"), F.try_divide(explained, F.when(F.col("_yy") > 0, F.col("_yy"))).alias("r2"))


def rolling_residual(df: DataFrame, w, y: str, xs: list[str], window: int, min_obs: int, out: str) -> DataFrame:  # noqa: ANN001
    """df with the current row's residual of a regression over the last `window` rows, itself included.

    Cross products are framed sums along w; each row's small system is solved in batches. Incomplete rows count as absent.
    """
    ok = F.lit(True)
    for c in [y, *xs]:
        ok &= F.col(c).isNotNull()
    f = w.rowsBetween(-(window - 1), 0)
    one = [F.when(ok, F.lit(1.0)), *[F.when(ok, F.col(x)) for x in xs]]
    p = len(one)
    d = df.withColumns({"_n": F.count(one[0]).over(f), "_xx": F.array(*[F.coalesce(F.sum(one[i] * one[j]).over(f), F.lit(0.0)) for i, j in _products(p)]), "_xy": F.array(*[F.coalesce(F.sum(v * F.col(y)).over(f), F.lit(0.0)) for v in one])})
    d = d.withColumn("_b", _coefficients("_xx", "_xy"))
    hat = F.col("_b")[0]
    for i, x in enumerate(xs):
        hat = hat + F.col("_b")[i + 1] * F.col(x)
    return d.withColumn(out, F.when(ok & (F.col("_n") >= min_obs), F.col(y) - hat)).drop("_n", "_xx", "_xy", "_b")


def residuals(df: DataFrame, by: list[str], y: str, xs: list[str], out: str, category: str | list[str] | tuple[str, ...] | None = None, min_obs: int = 20, intercept: bool = True) -> DataFrame:
    """df with the residual of y on xs (and, absorbed, on the categories) per group.

    Only complete rows of groups with at least min_obs of them have one; a null category is no complete row. One category is
    absorbed by its means. Several have no closed form: a group's rows, one cross-section, then go to one task, which projects
    y and xs off the indicators of all categories together.
    """
    cats = [category] if isinstance(category, str) else list(category or [])
    if cats and not intercept:
        raise ValueError("categories bring an intercept of their own")
    ok = F.lit(True)
    for c in [y, *xs, *cats]:
        ok &= F.col(c).isNotNull()
    if len(cats) > 1:
        return _absorbed(df, by, y, xs, out, cats, min_obs, ok)
    work = df.withColumns({"_ry": F.when(ok, F.col(y)), **{f"_d{i}": F.when(ok, F.col(x)) for i, x in enumerate(xs)}})
    ds = [f"_d{i}" for i in range(len(xs))]
    plain = intercept and not cats
    if cats:
        work = demean(work, [*by, *cats], ["_ry", *ds])
    fit = group_ols(work, by, "_ry", ds, intercept=plain, min_obs=min_obs) if xs else work.where("_ry is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.avg("_ry") if plain else F.lit(0.0)).alias("alpha")).where(F.col("n") >= min_obs)
    d = with_group(work, fit, by)
    hat: Column = F.coalesce("alpha", F.lit(0.0))
    for c in ds:
        hat = hat + F.col(f"beta_{c}") * F.col(c)
    res = F.when(F.col("n").isNotNull(), F.col("_ry") - hat)
    return d.withColumn(out, res).select(*df.columns, out)


def _absorbed(df: DataFrame, by: list[str], y: str, xs: list[str], out: str, cats: list[str], min_obs: int, ok: Column) -> DataFrame:
    kinds = dict(df.dtypes)
    keep = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out}` double, _whole boolean"

    def solve_one(pdf: pd.DataFrame) -> pd.DataFrame:
        res = np.full(len(pdf), np.nan)
        at = np.flatnonzero(pdf["_whole"].to_numpy())
        if len(at) >= max(min_obs, 1) and pdf[by].notna().to_numpy().all():
            full = pdf.iloc[at]
            indicators = np.column_stack([pd.get_dummies(full[c]).to_numpy(dtype=float) for c in cats])
            z = full[[y, *xs]].to_numpy(dtype=float)
            z = z - indicators @ np.linalg.lstsq(indicators, z, rcond=None)[0]
            yy, xx = z[:, 0], z[:, 1:]
            res[at] = yy - xx @ solve(xx.T @ xx, xx.T @ yy) if xs else yy
        return pdf[[*keep]].assign(**{out: pd.Series(res, index=pdf.index).astype("Float64").mask(np.isnan(res)), "_whole": pdf["_whole"]})

    return df.select(*keep, ok.alias("_whole")).groupBy(*by).applyInPandas(solve_one, schema).select(*keep, out)


def series_ols(y: np.ndarray, x: np.ndarray, lags: int | None = None) -> dict:
    """One series on its regressors (intercept first): coefficients, standard errors (classical, or HAC with `lags`), t, r2."""
    x = np.column_stack([np.ones(len(y)), x])
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    y, x = y[ok], x[ok]
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    if lags is None:
        v = inv * (e @ e) / max(len(y) - x.shape[1], 1)
    else:
        g = x * e[:, None]
        s = g.T @ g
        for k in range(1, lags + 1):
            c = g[k:].T @ g[:-k]
            s += (1 - k / (lags + 1)) * (c + c.T)
        v = inv @ s @ inv
    se = np.sqrt(np.diag(v))
    dev = y - y.mean()
    return {"coef": b, "se": se, "t": b / se, "r2": 1 - (e @ e) / (dev @ dev), "n": len(y)}
