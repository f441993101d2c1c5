"""Monte Carlo paths and stress scenarios of a daily return series (date, net_return)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators import metrics

SCALE = 1 << 31


def path_so_far():
    return Window.partitionBy("path_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)


def uniform(seed: int, *keys: str) -> Column:
    """A uniform of (0, 1) that depends on the keys alone, not on how rows are dealt."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(SCALE)) + 0.5) / SCALE


def normal(seed: int, *keys: str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 7919, *keys))


def grid(spark: SparkSession, paths: int, steps: int) -> DataFrame:
    """(path_id, step) for steps 1 to ``steps``."""
    return spark.range(paths).select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))


def with_start(paths: DataFrame, start: float) -> DataFrame:
    first = paths.filter("step = 1").select("path_id", F.lit(0).alias("step"), F.lit(float(start)).alias("value"))
    return paths.select("path_id", "step", "value").unionByName(first)


def gbm(returns: DataFrame, paths: int = 10_000, horizon: int = 252, start: float = 100_000.0, seed: int = 42, periods: int = 252) -> DataFrame:
    """(path_id, step, value) with drift and volatility of the returns; one aggregate row is joined to all steps."""
    fit = returns.agg((F.avg("net_return") * periods).alias("mu"), (F.stddev_samp("net_return") * math.sqrt(periods)).alias("sigma"))
    dt = 1 / periods
    inc = (F.col("mu") - F.col("sigma") ** 2 / 2) * dt + F.col("sigma") * math.sqrt(dt) * normal(seed, "path_id", "step")
    steps = grid(returns.sparkSession, paths, horizon).crossJoin(F.broadcast(fit)).withColumn("inc", inc)
    return with_start(steps.withColumn("value", start * F.exp(F.sum("inc").over(path_so_far()))), start)


def numbered(returns: DataFrame) -> DataFrame:
    """Adds pos from 0 by date; a single return history, not observations of many."""
    return returns.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def bootstrap(returns: DataFrame, paths: int = 10_000, horizon: int = 252, start: float = 100_000.0, seed: int = 42, block: int = 21) -> DataFrame:
    """Paths of history blocks whose starts are uniform in [0, n - block); a history of ``block`` rows or fewer is an error."""
    n = returns.count()
    if n <= block:
        raise ValueError(f"history of {n} rows is too short for blocks of {block}")
    history = numbered(returns).select("pos", "net_return")
    steps = grid(returns.sparkSession, paths, horizon).withColumn("k", F.floor((F.col("step") - 1) / block))
    pos = F.floor(uniform(seed, "path_id", "k") * (n - block)) + (F.col("step") - 1) % block
    drawn = steps.withColumn("pos", pos.cast("int")).join(F.broadcast(history), "pos")  # one row a day of history
    return with_start(drawn.withColumn("value", start * F.product(1 + F.col("net_return")).over(path_so_far())), start)


def simulate(returns: DataFrame, method: str = "bootstrap", **kw) -> DataFrame:
    return bootstrap(returns, **kw) if method == "bootstrap" else gbm(returns, **kw)


def terminal(paths: DataFrame, horizon: int, start: float, confidence: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    v = F.col("value")
    ret = v / start - 1
    end = paths.filter(F.col("step") == horizon).withColumn("ret", ret)
    levels = [x for c in confidence for x in (1 - c, c)]
    q = end.agg(F.percentile("value", F.array(*[F.lit(x) for x in levels])).alias("q"), F.percentile("ret", F.array(*[F.lit(x) for x in levels])).alias("qr"))
    rows = end.crossJoin(F.broadcast(q))
    out = [F.avg("value").alias("mean_terminal"), F.median("value").alias("median_terminal"), F.stddev_pop("value").alias("std_terminal"), F.avg("ret").alias("mean_return"), F.median("ret").alias("median_return"), F.avg((F.col("ret") > 0).cast("double")).alias("prob_profit")]
    out += [F.avg((F.col("ret") < -x / 100).cast("double")).alias(f"prob_loss_{x}") for x in (10, 20, 50)]
    for i, c in enumerate(confidence):
        n, low = round(c * 100), F.col("qr")[2 * i]
        out += [F.max(low).alias(f"var_{n}"), F.avg(F.when(F.col("ret") <= low, F.col("ret"))).alias(f"cvar_{n}"), F.max(F.col("q")[2 * i]).alias(f"pct_{100 - n}_terminal"), F.max(F.col("q")[2 * i + 1]).alias(f"pct_{n}_terminal")]
    return rows.agg(*out)


def path_drawdown(paths: DataFrame) -> DataFrame:
    """Mean, median, worst and 5 % quantile of the paths' maximum drawdowns."""
    peak = F.max("value").over(path_so_far())
    each = paths.withColumn("dd", F.try_divide(F.col("value") - peak, peak)).groupBy("path_id").agg(F.min("dd").alias("dd"))
    return each.agg(F.avg("dd").alias("mean_max_dd"), F.median("dd").alias("median_max_dd"), F.min("dd").alias("worst_dd"), F.percentile("dd", F.lit(0.05)).alias("pct_5_dd"))


def bands(paths: DataFrame, levels: tuple[int, ...] = (5, 10, 25, 50, 75, 90, 95)) -> DataFrame:
    q = paths.groupBy("step").agg(F.percentile("value", F.array(*[F.lit(p / 100) for p in levels])).alias("q"))
    return q.select("step", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(levels)])


def _shocked(returns: DataFrame, name: str, since: float, days: int, change) -> DataFrame:
    rows = numbered(returns)
    size = returns.agg(F.count("*").alias("n"), F.avg("net_return").alias("mean"), F.stddev_samp("net_return").alias("sd"))
    both = rows.crossJoin(F.broadcast(size)).withColumn("from", F.floor(F.col("n") * since))
    hit = (F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("from") + days)
    return both.select(F.lit(name).alias("scenario"), "date", F.when(hit, change(F.col("net_return"))).otherwise(F.col("net_return")).alias("net_return"))


def baseline(returns: DataFrame) -> DataFrame:
    return returns.select(F.lit("baseline").alias("scenario"), "date", "net_return")


def vol_shock(returns: DataFrame, factor: float = 3.0, days: int = 20, since: float = 0.5) -> DataFrame:
    return _shocked(returns, f"vol_shock_{factor:g}x", since, days, lambda r: r * factor)


def corr_breakdown(returns: DataFrame, days: int = 30, since: float = 0.6, seed: int = 99) -> DataFrame:
    return _shocked(returns, "corr_breakdown", since, days, lambda r: r - 2.5 * F.col("sd") + 0.5 * F.col("sd") * normal(seed, "pos"))


def liquidity(returns: DataFrame, days: int = 15, since: float = 0.7, spread: float = 0.005) -> DataFrame:
    return _shocked(returns, "liquidity_crisis", since, days, lambda r: r - 2 * spread)


def fat_tail(returns: DataFrame, events: int = 5, sigmas: float = 4.0, seed: int = 42) -> DataFrame:
    """``events`` distinct days, chosen by seed, move by plus or minus ``sigmas`` deviations."""
    days = numbered(returns).orderBy(uniform(seed, "pos"), "pos").limit(events).select("date", F.when(uniform(seed + 1, "pos") < 0.5, -1.0).otherwise(1.0).alias("sign"))
    sd = returns.agg(F.stddev_samp("net_return").alias("sd"))
    rows = returns.join(F.broadcast(days), "date", "left").crossJoin(F.broadcast(sd))
    return rows.select(F.lit("fat_tail").alias("scenario"), "date", (F.col("net_return") + F.coalesce(F.col("sign") * sigmas * F.col("sd"), F.lit(0.0))).alias("net_return"))


def bear(returns: DataFrame, days: int = 60, since: float = 0.5, strength: float = 0.5) -> DataFrame:
    return _shocked(returns, "bear_regime", since, days, lambda r: r - F.abs("mean") * strength)


def run_all(returns: DataFrame) -> DataFrame:
    """The seven scenarios."""
    return reduce(DataFrame.unionByName, [baseline(returns), vol_shock(returns), vol_shock(returns, 5.0, 10), corr_breakdown(returns), liquidity(returns), fat_tail(returns), bear(returns)])


def summary(scenarios: DataFrame) -> DataFrame:
    """(scenario, total_return, max_drawdown, sharpe)."""
    return metrics.report(metrics.curve(scenarios, "scenario"), "scenario").select("scenario", "total_return", "max_drawdown", "sharpe")


def formatted(table: DataFrame) -> DataFrame:
    """Shares as percent strings, the ratio with two digits."""
    return table.select("scenario", *[F.format_string("%.1f%%", F.col(c) * 100).alias(c) for c in ("total_return", "max_drawdown")], F.format_string("%.2f", "sharpe").alias("sharpe"))
