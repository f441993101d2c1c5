"""Candidate pairs, correlation screens and clusters. A pair has ticker_a < ticker_b."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import stats
from pairloom.functions.windows import PAIR, full, ordered, trailing


def within_groups(members: DataFrame) -> DataFrame:
    """All pairs of tickers that share a group."""
    a, b = members.select("grp", F.col("ticker").alias("ticker_a")), members.select("grp", F.col("ticker").alias("ticker_b"))
    return a.join(b, "grp").filter("ticker_a < ticker_b").select(*PAIR).distinct()


def across(members: DataFrame) -> DataFrame:
    """All pairs of the universe's tickers: a listed universe, not observations, so the product is small."""
    t = members.select("ticker").distinct()
    return t.select(F.col("ticker").alias("ticker_a")).join(t.select(F.col("ticker").alias("ticker_b")), F.col("ticker_a") < F.col("ticker_b"))


def eligible(pairs: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Pairs of which both legs are listed; an absent or empty list restricts nothing."""
    if tickers is None or tickers.isEmpty():
        return pairs
    t = tickers.select("ticker").distinct()
    return pairs.join(t.withColumnRenamed("ticker", "ticker_a"), "ticker_a", "left_semi").join(t.withColumnRenamed("ticker", "ticker_b"), "ticker_b", "left_semi").select(*PAIR)


def legs(panel: DataFrame, pairs: DataFrame, column: str = "close") -> DataFrame:
    """(ticker_a, ticker_b, date, a, b) on common dates without nulls."""
    x = panel.select("ticker", "date", F.col(column).alias("x")).filter(F.col("x").isNotNull())
    a = pairs.select(*PAIR).join(x.select(F.col("ticker").alias("ticker_a"), "date", F.col("x").alias("a")), "ticker_a")
    return a.join(x.select(F.col("ticker").alias("ticker_b"), "date", F.col("x").alias("b")), ["ticker_b", "date"]).select(*PAIR, "date", "a", "b")


def ranked(pair_rows: DataFrame) -> DataFrame:
    """Average ranks of both legs within each pair's complete rows."""
    out = pair_rows
    for c in ("a", "b"):
        ties = Window.partitionBy(*PAIR, c)
        out = out.withColumn(f"r{c}", F.rank().over(Window.partitionBy(*PAIR).orderBy(c)) + (F.count("*").over(ties) - 1) / 2)
    return out


def correlation(pair_rows: DataFrame, method: str = "pearson") -> DataFrame:
    """(ticker_a, ticker_b, correlation, n)."""
    n = F.count("*").alias("n")
    if method == "pearson":
        return pair_rows.groupBy(*PAIR).agg(F.corr("a", "b").alias("correlation"), n)
    if method == "spearman":
        return ranked(pair_rows).groupBy(*PAIR).agg(F.corr("ra", "rb").alias("correlation"), n)
    if method != "kendall":
        raise ValueError(f"unknown method {method!r}")

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        t = stats.kendall_tau_b(pdf.a.to_numpy(), pdf.b.to_numpy())
        return pd.DataFrame({"ticker_a": pdf.ticker_a[:1], "ticker_b": pdf.ticker_b[:1], "correlation": [None if np.isnan(t) else t], "n": [len(pdf)]})

    return pair_rows.groupBy(*PAIR).applyInPandas(tau, "ticker_a string, ticker_b string, correlation double, n long")


def high(corr: DataFrame, floor: float = 0.70) -> DataFrame:
    """Pairs with |correlation| of at least ``floor``, strongest first; typed also when empty."""
    return corr.filter(F.abs("correlation") >= floor).orderBy(F.abs("correlation").desc(), *PAIR)


def with_pvalue(corr: DataFrame) -> DataFrame:
    """Adds the two-sided p of the t test with n - 2 degrees of freedom."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([stats.t_two_sided(x, int(k)) if x == x else None for x, k in zip(r, n)], dtype="float64")

    return corr.withColumn("pvalue", p("correlation", "n"))


def rolling(pair_rows: DataFrame, rows: int = 252, method: str = "pearson") -> DataFrame:
    """(ticker_a, ticker_b, date, corr) over trailing rows; "spearman" ranks the whole of leg b against raw a."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"no rolling {method!r}")
    if method == "spearman":
        pair_rows = ranked(pair_rows).withColumn("b", F.col("rb"))
    value = full(F.corr("a", "b"), F.col("a"), rows, trailing(rows, *PAIR))
    return pair_rows.withColumn("corr", value).filter(F.col("corr").isNotNull()).select(*PAIR, "date", "corr")


def stability(rolled: DataFrame, floor: float = 0.70) -> DataFrame:
    c = F.col("corr")
    return rolled.groupBy(*PAIR).agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"),
        F.avg((c > 0).cast("double")).alias("share_positive"), F.avg((F.abs(c) >= floor).cast("double")).alias("share_above"),
    )


def clusters(corr: DataFrame, k: int = 5) -> DataFrame:
    """(ticker, cluster): complete linkage on 1 - |r|, a missing r counts as 0. One group holds the listed universe's matrix."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.ticker_a, *pdf.ticker_b})
        at, d = {t: i for i, t in enumerate(names)}, np.ones((len(names), len(names)))
        for a, b, r in zip(pdf.ticker_a, pdf.ticker_b, pdf.correlation.fillna(0)):
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - abs(r)
        return pd.DataFrame({"ticker": names, "cluster": stats.complete_linkage(d, k)})

    return corr.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(link, "ticker string, cluster int")


def crossings(spread: DataFrame, column: str = "zscore") -> DataFrame:
    """(ticker_a, ticker_b, n_crossings): sign changes between successive non-null values."""
    rows = spread.filter(F.col(column).isNotNull())
    product = F.lag(column).over(ordered(*PAIR)) * F.col(column)
    return rows.withColumn("c", (product < 0).cast("int")).groupBy(*PAIR).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_crossings"))
