"""Performance metrics of daily returns (date, net_return[, portfolio_value]).

A returns table may carry key columns (strategy, scenario, path); every metric is then per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.windows import full

RET = "net_return"


def _w(keys):
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date")


def _so_far(keys):
    return _w(keys).rowsBetween(Window.unboundedPreceding, 0)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, F.try_divide(top, bottom)).otherwise(0.0)


def curve(returns: DataFrame, *keys: str, start: float = 1.0) -> DataFrame:
    """Adds portfolio_value: start times the cumulative product."""
    return returns.withColumn("portfolio_value", start * F.product(1 + F.col(RET)).over(_so_far(keys)))


def drawdowns(returns: DataFrame, *keys: str) -> DataFrame:
    """Adds peak and drawdown of portfolio_value."""
    peak = F.max("portfolio_value").over(_so_far(keys))
    return returns.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col("portfolio_value") - F.col("peak"), F.col("peak")))


def report(returns: DataFrame, *keys: str, risk_free: float = 0.05, periods: int = 252) -> DataFrame:
    """All return, drawdown, ratio and tail metrics, one row a key."""
    r, daily = F.col(RET), risk_free / periods
    rows = drawdowns(returns.select(*keys, "date", RET, "portfolio_value"), *keys)
    tails = rows.groupBy(*keys).agg(F.percentile(RET, F.array(F.lit(0.05), F.lit(0.01))).alias("q"), F.min_by("date", F.struct("drawdown", "date")).alias("trough"), F.min_by("peak", F.struct("drawdown", "date")).alias("top"), F.count("*").alias("cnt"))
    joined = rows.crossJoin(F.broadcast(tails)) if not keys else rows.join(tails, [*keys])
    low = F.when(r < daily, r)
    a = joined.groupBy(*keys).agg(
        (F.product(1 + r) - 1).alias("total_return"), F.max("cnt").alias("n"), F.avg(r).alias("daily_mean"), F.stddev_samp(r).alias("daily_std"),
        F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))).alias("add"), F.count_if(F.col("drawdown") < 0).alias("drawdown_days"),
        F.stddev_samp(low).alias("down"), F.sum(F.when(r > daily, r - daily)).alias("gain"), F.sum(F.when(r < daily, daily - r)).alias("short"),
        F.max(F.col("q")[0]).alias("var_95"), F.max(F.col("q")[1]).alias("var_99"),
        F.avg(F.when(r <= F.col("q")[0], r)).alias("cvar_95"), F.avg(F.when(r <= F.col("q")[1], r)).alias("cvar_99"),
        F.max("trough").alias("trough"), F.min(F.when((F.col("date") >= F.col("trough")) & (F.col("portfolio_value") >= F.col("top")), F.col("date"))).alias("back"),
    )
    n, std = F.col("n"), F.col("daily_std")
    excess = F.col("daily_mean") - daily
    cagr = F.when(n > 0, F.pow(1 + F.col("total_return"), periods / n) - 1).otherwise(0.0)
    return a.select(
        *keys, "total_return", cagr.alias("cagr"), (std * math.sqrt(periods)).alias("annual_vol"), "daily_mean", "daily_std",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
        "best_day", "worst_day", "max_drawdown", F.coalesce("add", F.lit(0.0)).alias("avg_drawdown"), "drawdown_days",
        F.coalesce(F.datediff("back", "trough"), F.lit(-1)).alias("recovery_days"),
        ratio_or_zero(excess * math.sqrt(periods), std).alias("sharpe"),
        F.coalesce(ratio_or_zero(excess * math.sqrt(periods), F.col("down")), F.lit(0.0)).alias("sortino"),
        ratio_or_zero(cagr, F.abs("max_drawdown")).alias("calmar"),
        F.when(F.coalesce(F.col("short"), F.lit(0.0)) == 0, F.lit(math.inf)).otherwise(F.try_divide(F.coalesce(F.col("gain"), F.lit(0.0)), F.col("short"))).alias("omega"),
        "var_95", "cvar_95", "var_99", "cvar_99",
    )


def trades(profits: DataFrame, *keys: str) -> DataFrame:
    """(keys, trade_id, pnl, days, n): summed profit of each run of one non-zero position, n numbers them in order."""
    w = _w(keys)
    change = F.coalesce((F.col("position") != F.lag("position").over(w)).cast("int"), F.lit(1))
    runs = profits.withColumn("change", change).withColumn("trade_id", F.sum("change").over(_so_far(keys))).filter("position != 0")
    out = runs.groupBy(*keys, "trade_id").agg(F.sum("net_pnl").alias("pnl"), F.count("*").alias("days"))
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("trade_id")))


def longest_runs(each: DataFrame, *keys: str) -> DataFrame:
    """(keys, max_wins, max_losses) over trades in order."""
    win = F.col("pnl") > 0
    island = F.col("n") - F.row_number().over(Window.partitionBy(*keys, "win").orderBy("n"))
    runs = each.withColumn("win", win).withColumn("island", island).groupBy(*keys, "win", "island").agg(F.count("*").alias("len"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("win"), F.col("len"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(~F.col("win"), F.col("len"))), F.lit(0)).alias("max_losses"))


def trade_report(profits: DataFrame, *keys: str) -> DataFrame:
    """Nine trade metrics and the gross profit per key; all zero for a key without trades."""
    each = trades(profits, *keys)
    p, win = F.col("pnl"), F.col("pnl") > 0
    a = each.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.avg(win.cast("double")).alias("win_rate"), F.sum(F.when(win, p)).alias("won"), F.sum(F.when(~win, -p)).alias("lost"),
        F.avg(F.when(win, p)).alias("w"), F.avg(F.when(~win, p)).alias("l"), F.avg(p).alias("e"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    factor = F.when(zero(F.col("lost")) == 0, F.lit(math.inf)).otherwise(F.try_divide(zero(F.col("won")), F.col("lost")))
    full_ = a.join(longest_runs(each, *keys), [*keys]).select(*keys, "n_trades", "win_rate", factor.alias("profit_factor"), zero(F.col("w")).alias("avg_win"), zero(F.col("l")).alias("avg_loss"), zero(F.col("e")).alias("avg_trade_pnl"), zero(F.col("e")).alias("expectancy"), "max_wins", "max_losses", zero(F.col("won")).alias("gross_profit"))
    every = profits.select(*keys).distinct()
    out = every.join(full_, [*keys], "left")
    return out.fillna(0, subset=[c for c in full_.columns if c not in keys])


def rolling_sharpe(returns: DataFrame, *keys: str, rows: int = 63, risk_free: float = 0.05, periods: int = 252) -> DataFrame:
    w = _w(keys).rowsBetween(1 - rows, 0)
    r = F.col(RET)
    mean, std = full(F.avg(r), r, rows, w) - risk_free / periods, full(F.stddev_samp(r), r, rows, w)
    return returns.withColumn("rolling_sharpe", F.try_divide(mean, std) * math.sqrt(periods))


def rolling_volatility(returns: DataFrame, *keys: str, rows: int = 21, periods: int = 252) -> DataFrame:
    r = F.col(RET)
    return returns.withColumn("rolling_vol", full(F.stddev_samp(r), r, rows, _w(keys).rowsBetween(1 - rows, 0)) * math.sqrt(periods))


def risk_report(returns: DataFrame, *keys: str, risk_free: float = 0.05, periods: int = 252) -> DataFrame:
    """The risk manager's report: Calmar is mean return over drawdown here, and total return last over first."""
    full_ = report(returns, *keys, risk_free=risk_free, periods=periods)
    ends = returns.groupBy(*keys).agg(F.min_by("portfolio_value", "date").alias("first"), F.max_by("portfolio_value", "date").alias("last"))
    both = full_.join(ends, [*keys]) if keys else full_.crossJoin(ends)
    annual = F.col("daily_mean") * periods
    return both.select(*keys, "sharpe", "sortino", ratio_or_zero(annual, F.abs("max_drawdown")).alias("calmar"), "max_drawdown", annual.alias("annual_return"), "annual_vol", (F.try_divide("last", "first") - 1).alias("total_return"))
