"""Benchmark strategies: each gives (strategy, date, net_return)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.windows import ordered, zscore
from pairloom.operators import metrics


def _daily(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", F.try_divide("close", F.lag("close").over(ordered("ticker"))) - 1)


def buy_and_hold(panel: DataFrame, ticker: str) -> DataFrame:
    """Returns between a ticker's priced days; the first day has none."""
    rows = _daily(panel.filter((F.col("ticker") == ticker) & F.col("close").isNotNull())).filter(F.col("ret").isNotNull())
    return rows.select(F.lit(f"buy_hold_{ticker}").alias("strategy"), "date", F.col("ret").alias("net_return"))


def month_ends(panel: DataFrame) -> DataFrame:
    """(ticker, month, close): last close of each calendar month, labelled by its last day."""
    return panel.filter(F.col("close").isNotNull()).groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))


def momentum(panel: DataFrame, top: int = 5, lookback: int = 12, skip: int = 2, days: int = 21) -> DataFrame:
    """Equal-weight month return of the ``top`` tickers by past return up to ``skip`` months ago.

    A month's return is spread over the days from its label to the next one, 1/``days`` each;
    days before the first label earn nothing.
    """
    w = Window.partitionBy("ticker").orderBy("month")
    m = month_ends(panel).withColumn("past", F.try_divide(F.lag("close", skip).over(w), F.lag("close", lookback).over(w)) - 1).withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)
    best = Window.partitionBy("month").orderBy(F.col("past").desc(), "ticker")
    picked = m.filter(F.col("past").isNotNull()).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= top)
    months = month_ends(panel).select("month").distinct().join(picked.groupBy("month").agg(F.avg("ret").alias("ret")), "month", "left")
    following = F.lead("month").over(Window.orderBy("month"))  # one row a month
    spans = months.select(F.col("month").alias("since"), following.alias("until"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    dates = panel.select("date").distinct()
    held = dates.join(F.broadcast(spans), (F.col("date") >= F.col("since")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))), "left")
    return held.select(F.lit("momentum").alias("strategy"), "date", (F.coalesce("ret", F.lit(0.0)) / days).alias("net_return"))


def reversion_states(z: np.ndarray, bound: float = 1.5) -> np.ndarray:
    """Long below -bound until z reaches 0, short above bound likewise; a missing z shows 0 and keeps the state."""
    out, state = np.zeros(len(z), np.int32), 0
    for i, x in enumerate(z):
        if np.isnan(x):
            continue
        if state == 0:
            state = 1 if x < -bound else -1 if x > bound else 0
        elif x * state > 0:
            state = 0
        out[i] = state
    return out


def mean_reversion(panel: DataFrame, ticker: str, rows: int = 20, bound: float = 1.5) -> DataFrame:
    """Bollinger reversal on one ticker; the day earns yesterday's position."""
    one = _daily(panel.filter(F.col("ticker") == ticker)).withColumn("z", zscore(F.col("close"), rows, "ticker"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        state = reversion_states(pdf.z.to_numpy(float), bound)
        ret = np.concatenate([[0], state[:-1]]) * pdf.ret.fillna(0).to_numpy(float)
        return pd.DataFrame({"strategy": "mean_reversion", "date": pdf.date, "net_return": ret})

    return one.select("ticker", "date", "ret", "z").groupBy("ticker").applyInPandas(run, "strategy string, date date, net_return double")


def balanced(panel: DataFrame, equity: str, bond: str, share: float = 0.6) -> DataFrame:
    """Weighted returns of the days on which both have one."""
    rows = _daily(panel.filter(F.col("ticker").isin(equity, bond))).filter(F.col("ret").isNotNull())
    e, b = (rows.filter(F.col("ticker") == t).select("date", F.col("ret").alias(c)) for t, c in ((equity, "e"), (bond, "b")))
    ret = share * F.col("e") + (1 - share) * F.col("b")
    return e.join(b, "date").select(F.lit("balanced_60_40").alias("strategy"), "date", ret.alias("net_return"))


def run_all(panel: DataFrame, equity: str, second: str, bond: str) -> DataFrame:
    parts = [buy_and_hold(panel, equity), buy_and_hold(panel, second), momentum(panel), mean_reversion(panel, equity), balanced(panel, equity, bond)]
    return reduce(DataFrame.unionByName, parts)


def comparison(returns: DataFrame, digits: int = 4) -> DataFrame:
    """Nine metrics of each strategy, rounded."""
    full = metrics.report(metrics.curve(returns, "strategy"), "strategy")
    names = ["total_return", "cagr", "annual_vol", "sharpe", "sortino", "calmar", "max_drawdown", "var_95", "omega"]
    return full.select("strategy", *[F.round(c, digits).alias(c) for c in names])
