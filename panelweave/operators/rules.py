"""Cleaning rules as data, applied in order to a panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.cross_section import METHODS, clip_outliers, fill_missing, zscore
from panelweave.operators.regression import residuals


@dataclass(frozen=True)
class Outliers:
    """Limits by 'quantile', 'std', 'mad' or 'iqr' (or another name of these); by=() takes one limit for the whole table."""

    columns: tuple[str, ...]
    method: str = "quantile"
    action: str = "winsorize"
    by: tuple[str, ...] = ("date",)
    lower: float | None = 0.01
    upper: float | None = 0.99
    n_std: float = 3.0
    n_mad: float = 3.5
    iqr_multiplier: float = 1.5

    def apply(self, df: DataFrame) -> DataFrame:
        by = list(self.by) or ["_all"]
        d = df if self.by else df.withColumn("_all", F.lit(0))
        method = METHODS.get(self.method.lower(), self.method.lower())
        scale = {"std": self.n_std, "mad": self.n_mad, "iqr": self.iqr_multiplier}.get(method)
        kw = {"lower": self.lower, "upper": self.upper, "scale": scale, "bounded": "date" in by}
        for c in self.columns:
            if c in d.columns:
                d = clip_outliers(d, by, c, method, self.action.lower(), **kw)
        return d.drop("_all")


@dataclass(frozen=True)
class Missing:
    """See fill_missing; carrying values needs by=(entity,) and an order, so that nothing passes from one asset to another."""

    columns: tuple[str, ...]
    method: str = "drop"
    by: tuple[str, ...] = ("date",)
    order: str = "date"
    value: float | None = None
    limit: int | None = None
    universe: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.method in ("ffill", "bfill") and "date" in self.by:
            raise ValueError("values are carried along an entity, not within a date")
        for c in self.columns:
            df = fill_missing(df, c, self.method, list(self.by), self.order, self.value, self.limit, self.universe, "date" in self.by)
        return df


@dataclass(frozen=True)
class Standardise:
    columns: tuple[str, ...]
    by: tuple[str, ...] = ("date",)
    suffix: str = "_z"
    overwrite: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            df = zscore(df, list(self.by), c, c if self.overwrite else f"{c}{self.suffix}")
        return df


@dataclass(frozen=True)
class Neutralise:
    y: str
    x: tuple[str, ...] = ()
    category: str | tuple[str, ...] | None = None
    by: tuple[str, ...] = ("date",)
    output: str | None = None
    min_obs: int = 20
    add_intercept: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        return residuals(df, list(self.by), self.y, list(self.x), self.output or f"{self.y}_neutral", self.category, self.min_obs, self.add_intercept)


def apply_rules(df: DataFrame, rules: list) -> DataFrame:
    for rule in rules:
        df = rule.apply(df)
    return df
