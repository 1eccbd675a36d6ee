"""A template for factors: universe, signal, groups, weights, checked holdings; and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.asof import calendar
from panelweave.operators.cross_section import bucket_codes, winsorize
from panelweave.operators.portfolio import forward_returns, holdings_diagnostics, leg_weights, simulate_drift, simulate_fixed, sorted_legs, spread, turnover
from panelweave.operators.statistics import fama_macbeth, ic_summary, information_coefficient, newey_west, performance, univariate_fit

HOLDING_COLUMNS = ["rebalance_date", "hold_start", "hold_end", "asset_id", "portfolio", "leg", "weight"]


@dataclass(frozen=True)
class Factor:
    """Holdings of a factor and what describes them."""

    name: str
    holdings: DataFrame
    meta: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        gone = [c for c in HOLDING_COLUMNS if c not in self.holdings.columns]
        if gone:
            raise ValueError(f"holdings lack {gone}")

    def diagnostics(self) -> DataFrame:
        return holdings_diagnostics(self.holdings, ["rebalance_date", "portfolio"])


@dataclass(frozen=True)
class BucketFactor:
    """Buckets of a signal per date, and the top against the bottom one. Subclasses may replace any step."""

    name: str
    buckets: int = 10
    weighting: str | None = "market_equity"
    top_is_long: bool = True
    min_count: int | None = None
    limits: tuple[float, float] | None = (0.01, 0.99)
    label: str = "D"
    long_codes: tuple[int, ...] | None = None
    short_codes: tuple[int, ...] | None = None

    def universe(self, panel: DataFrame) -> DataFrame:
        return panel.where("date is not null and asset_id is not null")

    def signal(self, universe: DataFrame) -> DataFrame:
        d = universe.where("exposure is not null")
        return winsorize(d, ["date"], "exposure", *self.limits) if self.limits else d

    def groups(self, signal: DataFrame) -> DataFrame:
        d = bucket_codes(signal, ["date"], "exposure", self.buckets, ["asset_id"], min_count=self.min_count).where("code is not null")
        return d.withColumn("portfolio", F.concat(F.lit(self.label), F.lpad((F.col("code") + 1).cast("string"), 2, "0")))

    def weights(self, grouped: DataFrame) -> DataFrame:
        w = leg_weights(grouped, ["date", "portfolio"], self.weighting)
        if self.long_codes is not None or self.short_codes is not None:  # legs of several buckets
            legs = sorted_legs(grouped, ["date"], "code", list(self.long_codes or ()), list(self.short_codes or ()), self.weighting, "HL")
            return w.withColumn("leg", F.lit("portfolio")).unionByName(legs)
        high, low = (1, -1) if self.top_is_long else (-1, 1)
        side = F.when(F.col("code") == self.buckets - 1, high).when(F.col("code") == 0, low)
        hl = spread(w.withColumn("side", side), ["date"], "side", "HL").withColumn("leg", F.when(F.col("side") > 0, "long").otherwise("short")).drop("side")
        return w.withColumn("leg", F.lit("portfolio")).unionByName(hl)

    def build(self, panel: DataFrame) -> Factor:
        w = self.weights(self.groups(self.signal(self.universe(panel))))
        h = w.select(F.col("date").alias("rebalance_date"), F.date_add("date", 1).alias("hold_start"), F.lit(None).cast("date").alias("hold_end"), "asset_id", "portfolio", "leg", "weight")
        return Factor(self.name, h, {"buckets": self.buckets, "weighting": self.weighting or "equal"})


@dataclass(frozen=True)
class Backtest:
    """Evaluation of a factor on returns (date, asset_id, ret)."""

    returns: DataFrame
    per_year: int = 12

    def __post_init__(self) -> None:
        kind = dict(self.returns.dtypes).get("date")
        if kind not in ("date", "timestamp"):
            raise TypeError("returns need a date column of a date type")

    def simulate(self, factor: Factor, drift: bool = False, cost_bps: float = 0.0) -> DataFrame:
        book = factor.holdings.select("rebalance_date", "portfolio", "asset_id", "weight")
        return simulate_drift(book, self.returns, cost_bps)[0] if drift else simulate_fixed(book, self.returns)

    def turnover(self, factor: Factor) -> DataFrame:
        return turnover(factor.holdings.select("rebalance_date", "portfolio", "asset_id", "weight"))

    def summary(self, factor: Factor) -> DataFrame:
        """Performance of each portfolio, with its average turnover."""
        t = self.turnover(factor).groupBy("portfolio").agg(F.avg("turnover").alias("avg_turnover"))
        return performance(self.simulate(factor), ["portfolio"], "date", "ret", self.per_year).join(t, "portfolio", "left")

    def _pairs(self, exposure: DataFrame) -> DataFrame:
        f = forward_returns(exposure.select(F.col("date").alias("rebalance_date")), self.returns)
        return exposure.join(f.withColumnRenamed("rebalance_date", "date"), ["date", "asset_id"])

    def ic(self, exposure: DataFrame, kind: str = "spearman") -> DataFrame:
        return information_coefficient(self._pairs(exposure), ["date"], "exposure", "forward", kind)

    def ic_summary(self, exposure: DataFrame, kind: str = "spearman") -> DataFrame:
        return ic_summary(self.ic(exposure, kind).withColumn("signal", F.lit("exposure")), ["signal"])

    def fit(self, exposure: DataFrame) -> DataFrame:
        return univariate_fit(self._pairs(exposure), ["date"], "exposure", "forward")

    def newey_west(self, factor: Factor, lags: int | None = None) -> DataFrame:
        """Mean return of each portfolio with its HAC error."""
        return newey_west(self.simulate(factor), ["portfolio"], "date", "ret", lags)

    def by_year(self, factor: Factor) -> DataFrame:
        """(portfolio, year, ret, n) of each portfolio."""
        g = self.simulate(factor).groupBy("portfolio", F.year("date").cast("long").alias("year"))
        return g.agg((F.product(F.col("ret") + 1) - 1).alias("ret"), F.count(F.lit(1)).alias("n"))

    def ic_decay(self, exposure: DataFrame, horizons: int = 6, kind: str = "pearson") -> DataFrame:
        """(h, mean_ic, n) of the exposure with the return h return dates later."""
        cal = F.broadcast(calendar(self.returns, "date"))  # one row per date
        s = exposure.where("exposure is not null").join(cal, "date").select("date", "asset_id", "exposure", "position", F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("h"))
        y = self.returns.where("ret is not null").join(cal, "date").select("asset_id", F.col("ret").alias("forward"), F.col("position").alias("_p"))
        j = s.withColumn("_p", F.col("position") + F.col("h")).join(y, ["asset_id", "_p"])
        ic = information_coefficient(j, ["date", "h"], "exposure", "forward", kind).where("ic is not null")
        return ic.groupBy(F.col("h").cast("long").alias("h")).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n"))

    def fama_macbeth(self, exposure: DataFrame, min_obs: int = 30) -> DataFrame:
        return fama_macbeth(self._pairs(exposure), "date", "forward", ["exposure"], min_obs)
