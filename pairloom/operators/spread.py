"""Hedge ratios, spreads and their dynamics; input rows are (ticker_a, ticker_b, date, a, b)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import stats
from pairloom.functions.windows import PAIR, full, ordered, trailing, zscore

PAIR_ROWS = "ticker_a string, ticker_b string, date date"


def ols(rows: DataFrame) -> DataFrame:
    """Adds hedge_ratio, intercept and spread = a - hedge_ratio * b; the intercept stays in the spread."""
    fit = rows.groupBy(*PAIR).agg(F.regr_slope("a", "b").alias("hedge_ratio"), F.regr_intercept("a", "b").alias("intercept"))
    return rows.join(fit, [*PAIR]).withColumn("spread", F.col("a") - F.col("hedge_ratio") * F.col("b"))


def rolling_ols(rows: DataFrame, window: int = 60) -> DataFrame:
    """hedge_ratio of the trailing rows; null until the window is full."""
    slope = full(F.regr_slope("a", "b"), F.col("a"), window, trailing(window, *PAIR))
    return rows.withColumn("hedge_ratio", slope).withColumn("spread", F.col("a") - F.col("hedge_ratio") * F.col("b"))


def kalman(rows: DataFrame, q: float = 1e-4, r: float = 1e-2) -> DataFrame:
    """Filtered hedge_ratio and intercept per date; spread is the residual after the update. One pair is one group of bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        slope, intercept, resid = stats.kalman_hedge(pdf.a.to_numpy(), pdf.b.to_numpy(), q, r)
        return pdf.assign(hedge_ratio=slope, intercept=intercept, spread=resid)[["ticker_a", "ticker_b", "date", "a", "b", "hedge_ratio", "intercept", "spread"]]

    return rows.select(*PAIR, "date", "a", "b").groupBy(*PAIR).applyInPandas(run, f"{PAIR_ROWS}, a double, b double, hedge_ratio double, intercept double, spread double")


def build(rows: DataFrame, method: str = "ols", window: int = 60, q: float = 1e-4, r: float = 1e-2) -> DataFrame:
    if method == "ols":
        return ols(rows)
    if method == "rolling_ols":
        return rolling_ols(rows, window)
    if method == "kalman":
        return kalman(rows, q, r)
    raise ValueError(f"unknown spread method {method!r}")


def with_zscore(spread: DataFrame, rows: int = 60) -> DataFrame:
    return spread.withColumn("zscore", zscore(F.col("spread"), rows, *PAIR))


def _steps(spread: DataFrame) -> DataFrame:
    before = F.lag("spread").over(ordered(*PAIR))
    return spread.filter(F.col("spread").isNotNull()).withColumn("x", before).withColumn("y", F.col("spread") - before)


def half_life(spread: DataFrame) -> DataFrame:
    """(ticker_a, ticker_b, half_life): -ln 2 / slope of the change on the level, infinite where it does not revert."""
    b = F.col("slope")
    fit = _steps(spread).groupBy(*PAIR).agg(F.regr_slope("y", "x").alias("slope"))
    return fit.select(*PAIR, F.when(b >= 0, F.lit(math.inf)).when(b < 0, -math.log(2) / b).alias("half_life"))


def ou(spread: DataFrame) -> DataFrame:
    """Ornstein-Uhlenbeck kappa, mu, sigma and half-life of the same regression."""
    fit = _steps(spread).groupBy(*PAIR).agg(
        F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_count("y", "x").alias("n")
    )
    kappa = -F.col("s")
    return fit.select(
        *PAIR, kappa.alias("kappa"), F.try_divide(F.col("i"), kappa).alias("mu"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("syy") - F.col("s") * F.col("sxy"), F.col("n") - 1))).alias("sigma"),
        F.when(kappa > 0, math.log(2) / kappa).otherwise(F.lit(math.inf)).alias("half_life"),
    )


def hurst(spread: DataFrame, longest: int = 100) -> DataFrame:
    """(ticker_a, ticker_b, hurst) by rescaled range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date").spread.dropna().to_numpy()
        return pd.DataFrame({"ticker_a": pdf.ticker_a[:1], "ticker_b": pdf.ticker_b[:1], "hurst": [stats.hurst(x, longest)]})

    return spread.select(*PAIR, "date", "spread").groupBy(*PAIR).applyInPandas(run, "ticker_a string, ticker_b string, hurst double")


def characterise(rows: DataFrame, method: str = "ols", lookback: int = 60) -> DataFrame:
    """One row a pair: last hedge ratio and z-score, Hurst exponent and OU parameters."""
    s = with_zscore(build(rows, method, lookback), lookback)
    last = s.groupBy(*PAIR).agg(F.max_by("hedge_ratio", "date").alias("hedge_ratio"), F.max_by("zscore", "date").alias("last_z"), F.stddev_samp("spread").alias("spread_std"))
    return last.join(hurst(s), [*PAIR]).join(ou(s), [*PAIR])


COINT = (
    "ticker_a string, ticker_b string, n long, eg_pvalue double, eg_stat double, adf_pvalue double, adf_stat double, kpss_pvalue double, "
    "johansen_trace_stat double, johansen_trace_crit_90 double, hedge_ratio double, half_life double, spread_mean double, spread_std double, is_cointegrated boolean"
)


def cointegration(rows: DataFrame, eg_p: float = 0.05, adf_p: float = 0.05, life: tuple[float, float] = (5, 60), least: int = 60) -> DataFrame:
    """The test battery, one row a pair; under ``least`` rows or on an error what is unknown is null and the pair does not pass."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        a, b = pdf.a.to_numpy(float), pdf.b.to_numpy(float)
        out: dict = {"ticker_a": pdf.ticker_a.iloc[0], "ticker_b": pdf.ticker_b.iloc[0], "n": len(a), "is_cointegrated": False}
        if len(a) >= least:
            try:
                out["eg_stat"], out["eg_pvalue"] = stats.engle_granger(a, b)
                beta = float(np.cov(a, b)[0, 1] / np.var(b, ddof=1))
                s = a - beta * b
                out |= {"hedge_ratio": beta, "spread_mean": float(s.mean()), "spread_std": float(s.std(ddof=1))}
                slope = float(np.cov(np.diff(s), s[:-1])[0, 1] / np.var(s[:-1], ddof=1))
                out["half_life"] = -math.log(2) / slope if slope < 0 else math.inf
                out["adf_stat"] = stats.adf(s)
                out["adf_pvalue"] = stats.mackinnon_p(out["adf_stat"])
                out["kpss_pvalue"] = stats.kpss(s)[1]
                out |= {"johansen_trace_stat": stats.johansen_trace(a, b), "johansen_trace_crit_90": stats.TRACE_90}
                out["is_cointegrated"] = bool(out["eg_pvalue"] <= eg_p and out["adf_pvalue"] <= adf_p and life[0] <= out["half_life"] <= life[1])
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError, FloatingPointError):
                pass
        names = [c.strip().split(" ")[0] for c in COINT.split(",")]
        return pd.DataFrame([{c: out.get(c) for c in names}], columns=names)

    return rows.select(*PAIR, "date", "a", "b").groupBy(*PAIR).applyInPandas(test, COINT)
