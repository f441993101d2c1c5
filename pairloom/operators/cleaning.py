"""Cleaning and scalar transforms of a long panel (ticker, date, close)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.windows import clean, full, ordered, so_far, trailing

AHEAD = (0, Window.unboundedFollowing)


def min_history(panel: DataFrame, rows: int = 252) -> DataFrame:
    """Tickers with at least ``rows`` closes."""
    enough = panel.groupBy("ticker").agg(F.count("close").alias("n")).filter(F.col("n") >= rows)
    return panel.join(enough, "ticker", "left_semi")


def fill_forward(panel: DataFrame) -> DataFrame:
    return panel.withColumn("close", F.last("close", True).over(so_far("ticker")))


def fill_backward(panel: DataFrame) -> DataFrame:
    return panel.withColumn("close", F.first("close", True).over(ordered("ticker").rowsBetween(*AHEAD)))


def fill_time(panel: DataFrame) -> DataFrame:
    """Linear in elapsed days inside gaps; a trailing gap takes the last value, a leading one stays null."""
    seen = F.when(F.col("close").isNotNull(), F.struct("date", "close"))
    both = panel.withColumn("p", F.last(seen, True).over(so_far("ticker"))).withColumn("q", F.first(seen, True).over(ordered("ticker").rowsBetween(*AHEAD)))
    share = F.datediff("date", "p.date") / F.datediff("q.date", "p.date")
    between = F.col("p.close") + (F.col("q.close") - F.col("p.close")) * share
    value = F.when(F.col("close").isNotNull(), F.col("close")).when(F.col("q").isNull(), F.col("p.close")).when(F.col("p").isNotNull(), between)
    return both.withColumn("close", value).drop("p", "q")


FILLS = {"ffill": fill_forward, "bfill": fill_backward, "interpolate": fill_time}


def drop_empty_dates(panel: DataFrame) -> DataFrame:
    """Without dates on which no ticker has a close."""
    return panel.join(panel.filter(F.col("close").isNotNull()).select("date").distinct(), "date", "left_semi")


def positive_repair(panel: DataFrame) -> DataFrame:
    """Closes that are not above zero become the last one that is."""
    return fill_forward(panel.withColumn("close", F.when(F.col("close") > 0, F.col("close"))))


def with_returns(panel: DataFrame) -> DataFrame:
    """Adds log_price, ret and log_ret; a ticker's first returns are null."""
    before = F.lag("close").over(ordered("ticker"))
    out = panel.withColumn("log_price", F.ln("close")).withColumn("ret", F.try_divide("close", before) - 1)
    return out.withColumn("log_ret", F.col("log_price") - F.lag("log_price").over(ordered("ticker")))


def winsorise(panel: DataFrame, q: float = 0.01, column: str = "ret") -> DataFrame:
    """Clips at each ticker's exact q and 1 - q quantiles."""
    bounds = panel.groupBy("ticker").agg(F.percentile(column, F.array(F.lit(q), F.lit(1 - q))).alias("b"))
    out = panel.join(bounds, "ticker")
    clipped = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("b")[0]), F.col("b")[1]))
    return out.withColumn(column, clipped).drop("b")


def preprocess(panel: DataFrame, rows: int = 252, fill: str = "ffill", q: float = 0.01) -> DataFrame:
    """The whole cleaning chain: panel(ticker, date, close, log_price, ret, log_ret)."""
    filled = drop_empty_dates(FILLS[fill](min_history(panel, rows)))
    return winsorise(with_returns(positive_repair(filled)), q)


def normalise(panel: DataFrame, column: str = "close") -> DataFrame:
    w = Window.partitionBy("ticker")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return panel.withColumn("norm", F.try_divide(F.col(column) - low, high - low))


def standardise(panel: DataFrame, column: str = "close") -> DataFrame:
    w = Window.partitionBy("ticker")
    return panel.withColumn("std", F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w)))


def rebase(panel: DataFrame, base: float = 100.0) -> DataFrame:
    return panel.withColumn("rebased", F.try_divide("close", F.first("close").over(so_far("ticker"))) * base)


def realised_vol(panel: DataFrame, rows: int = 21, periods: int | None = 252, column: str = "log_ret") -> DataFrame:
    x, scale = F.col(column), math.sqrt(periods) if periods else 1.0
    return panel.withColumn("vol", full(F.stddev_samp(x), x, rows, trailing(rows, "ticker")) * scale)


def beta(asset: DataFrame, market: DataFrame) -> DataFrame:
    """(ticker, beta): slope of each asset's returns on the market's, over common dates."""
    both = asset.select("ticker", "date", "ret").join(market.select("date", F.col("ret").alias("mkt")), "date").dropna()
    return both.groupBy("ticker").agg(F.regr_slope("ret", "mkt").alias("beta"))


def liquid(panel: DataFrame, min_price: float = 5.0, min_dollar_volume: float | None = 1e6) -> DataFrame:
    """(ticker, mean_close, mean_value) of tickers that pass both means; without a volume column only the price counts."""
    value = F.avg(F.col("close") * F.col("volume")) if "volume" in panel.columns else F.lit(None).cast("double")
    out = panel.groupBy("ticker").agg(F.avg("close").alias("mean_close"), value.alias("mean_value"))
    out = out.filter(F.col("mean_close") >= min_price)
    return out.filter(F.col("mean_value") >= min_dollar_volume) if "volume" in panel.columns and min_dollar_volume is not None else out


def finite(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: clean(F.col(c)) for c in columns})


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def describe(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"), F.max(column).alias("high")
    )
