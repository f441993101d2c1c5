"""Signals, execution, sizing and risk controls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.config import SignalConfig, TradeConfig
from pairloom.functions.windows import PAIR, ordered, so_far
from pairloom.operators import spread as S

SIGNALS = f"{S.PAIR_ROWS}, signal int, position int, holding_days int, spread double, zscore double, hedge_ratio double"


def rules(z: np.ndarray, p: SignalConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signal, position and holding days of each z. A missing z shows a flat row but leaves the state as it was.

    With ``stop_mode`` "symmetric" the stop never binds before the exit, as the exit bound lies
    inside it; "adverse" stops a long below -stop and a short above stop.
    """
    signal, position, holding = (np.zeros(len(z), np.int32) for _ in range(3))
    state = held = 0
    for i, x in enumerate(z):
        if np.isnan(x):
            continue
        if state == 0:
            if abs(x) > p.entry:
                state, held = (1 if x < 0 else -1), 1
                signal[i] = state
        else:
            held += 1
            gain = x * state
            stopped = gain < -p.stop if p.stop_mode == "adverse" else gain > p.stop
            if gain > -p.exit or stopped or held >= p.max_holding:
                state = held = 0
        position[i], holding[i] = state, held
    return signal, position, holding


def signals(spread_rows: DataFrame, p: SignalConfig = SignalConfig()) -> DataFrame:
    """The state machine over rows with zscore; rows without one are left out at the end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        s, pos, held = rules(pdf.zscore.to_numpy(float), p)
        out = pdf.assign(signal=s, position=pos, holding_days=held)
        return out[out.zscore.notna()][["ticker_a", "ticker_b", "date", "signal", "position", "holding_days", "spread", "zscore", "hedge_ratio"]]

    return spread_rows.select(*PAIR, "date", "spread", "zscore", "hedge_ratio").groupBy(*PAIR).applyInPandas(run, SIGNALS)


def generate(price_rows: DataFrame, method: str = "ols", p: SignalConfig = SignalConfig(), log_prices: bool = True) -> DataFrame:
    rows = price_rows.select(*PAIR, "date", *[(F.ln(c) if log_prices else F.col(c)).alias(c) for c in ("a", "b")])
    return signals(S.with_zscore(S.build(rows, method, p.lookback, p.kalman_q, p.kalman_r), p.lookback), p)


def signal_summary(sig: DataFrame) -> DataFrame:
    pos = F.col("position")
    return sig.groupBy(*PAIR).agg(
        F.avg((pos == 1).cast("double")).alias("pct_long"), F.avg((pos == -1).cast("double")).alias("pct_short"), F.avg((pos == 0).cast("double")).alias("pct_flat"),
        F.count_if(F.col("signal") != 0).alias("n_entries"), F.coalesce(F.avg(F.when(pos != 0, F.col("holding_days"))), F.lit(0.0)).alias("avg_holding"),
    )


def pnl(sig: DataFrame, price_rows: DataFrame, p: TradeConfig = TradeConfig(), allocation: Column | float = 1.0) -> DataFrame:
    """Daily profit of each pair. The position of the same bar earns the bar's return unless ``lag_positions``.

    Costs are charged on one unit of shares for each change of position; the first row has none.
    """
    rows = sig.select(*PAIR, "date", "position", F.coalesce("hedge_ratio", F.lit(1.0)).alias("beta")).join(price_rows.select(*PAIR, "date", "a", "b"), [*PAIR, "date"])
    w = ordered(*PAIR)
    capital = F.lit(p.capital) * allocation
    held = F.lag("position").over(w) if p.lag_positions else F.col("position")
    ret_a, ret_b = (F.try_divide(c, F.lag(c).over(w)) - 1 for c in ("a", "b"))
    gross = F.coalesce(held * (ret_a - F.col("beta") * ret_b), F.lit(0.0))
    turn = F.abs(F.col("position") - F.lag("position").over(w))
    cost = F.coalesce(turn * (F.abs("a") + F.abs("beta") * F.abs("b")) * (p.commission + p.slippage), F.lit(0.0))
    out = rows.select(*PAIR, "date", "position", gross.alias("gross_return"), cost.alias("costs"), capital.alias("capital"))
    out = out.withColumn("gross_pnl", F.col("gross_return") * F.col("capital")).withColumn("net_pnl", F.col("gross_pnl") - F.col("costs"))
    out = out.withColumn("net_return", F.col("gross_return") - F.col("costs") / F.col("capital"))
    return out.withColumn("portfolio_value", F.col("capital") + F.sum("net_pnl").over(so_far(*PAIR)))


def portfolio(profits: DataFrame, method: str = "equal", p: TradeConfig = TradeConfig()) -> DataFrame:
    """(date, gross_return, net_return, portfolio_value, net_pnl, costs): weighted sums over the outer-aligned pairs.

    Equal weights, or inverse to each pair's volatility over the whole aligned calendar, where
    absent rows count as 0. The compounding window runs over one row a date.
    """
    keys = profits.groupBy(*PAIR).agg(F.count("*").alias("k"), F.sum("net_return").alias("s1"), F.sum(F.col("net_return") ** 2).alias("s2"))
    size = profits.agg(F.countDistinct("date").alias("days"), F.countDistinct(F.struct(*PAIR)).alias("pairs"))
    every = keys.crossJoin(F.broadcast(size))  # one row
    if method == "equal":
        raw = 1.0 / F.col("pairs")
    else:
        raw = 1.0 / (F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") ** 2 / F.col("days")) / (F.col("days") - 1))) + 1e-9)
    weights = every.select(*PAIR, raw.alias("w")).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1))))
    rows = profits.join(weights, [*PAIR])
    daily = rows.groupBy("date").agg(F.sum(F.col("w") * F.col("gross_return")).alias("gross_return"), F.sum(F.col("w") * F.col("net_return")).alias("net_return"))
    value = p.capital * F.product(1 + F.col("net_return")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("portfolio_value", value).withColumn("net_pnl", F.col("net_return") * p.capital).withColumn("costs", (F.col("gross_return") - F.col("net_return")) * p.capital)


def size_fixed(n: Column | int, capital: float, cap: float = 0.25) -> Column:
    return F.least(1.0 / (F.lit(n) if isinstance(n, int) else n), F.lit(cap)) * capital


def size_vol_target(vol: Column, capital: float, target: float = 0.01, cap: float = 0.25) -> Column:
    """Target over volatility, capped; without a usable volatility the fixed size for one pair."""
    return F.when(vol > 0, F.least(target / vol, F.lit(cap))).otherwise(min(1.0, cap)) * capital


def size_kelly(win_rate: Column, avg_win: Column, avg_loss: Column, capital: float, fraction: float = 0.5, cap: float = 0.25) -> Column:
    raw = F.greatest(F.try_divide(win_rate, F.abs(avg_loss)) - F.try_divide(1 - win_rate, avg_win), F.lit(0.0)) * fraction
    return F.coalesce(F.when((avg_win != 0) & (avg_loss != 0), F.least(raw, F.lit(cap))), F.lit(0.0)) * capital


def recent_vol(returns: DataFrame, rows: int = 21, *keys: str) -> DataFrame:
    last = returns.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))).filter(F.col("rn") <= rows)
    return last.groupBy(*keys).agg(F.stddev_samp("net_return").alias("vol"))


def drawdown(curve: DataFrame, *keys: str, value: str = "portfolio_value") -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(w)
    return curve.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col(value) - F.col("peak"), F.col("peak")))


def halt(curve: DataFrame, sig: DataFrame, limit: float = 0.20) -> DataFrame:
    """Positions and signals are zero from the first date on which the curve's drawdown exceeds the limit."""
    first = drawdown(curve).agg(F.min(F.when(F.col("drawdown") < -limit, F.col("date"))).alias("halt"))
    out = sig.crossJoin(F.broadcast(first))  # one row
    stop = F.coalesce(F.col("date") >= F.col("halt"), F.lit(False))
    return out.withColumns({c: F.when(stop, F.lit(0)).otherwise(F.col(c)) for c in ("position", "signal")}).drop("halt")


def stop_loss(sig: DataFrame, profits: DataFrame, limit: float = 0.05) -> DataFrame:
    """A pair's positions are zero from the first date on which its summed profit is below -limit of its capital."""
    total = profits.withColumn("total", F.sum("net_pnl").over(so_far(*PAIR)))
    first = total.groupBy(*PAIR).agg(F.min(F.when(F.col("total") < -limit * F.col("capital"), F.col("date"))).alias("halt"))
    out = sig.join(first, [*PAIR], "left")
    stop = F.coalesce(F.col("date") >= F.col("halt"), F.lit(False))
    return out.withColumns({c: F.when(stop, F.lit(0)).otherwise(F.col(c)) for c in ("position", "signal")}).drop("halt")


def backtest(panel: DataFrame, ranked_pairs: DataFrame, method: str = "kalman", weights: str = "equal", train_end: str | None = None, signal: SignalConfig = SignalConfig(), trade: TradeConfig = TradeConfig()) -> dict[str, DataFrame]:
    """Signals, profits and the portfolio of all pairs in one plan; dates after ``train_end`` only, if given."""
    from pairloom.operators.pairs import legs

    if train_end:
        panel = panel.filter(F.col("date") > F.lit(train_end).cast("date"))
    rows = legs(panel, ranked_pairs)
    sig = generate(rows, method, signal)
    n = ranked_pairs.count()
    profits = pnl(sig, rows, trade, 1.0 / max(n, 1))
    return {"signals": sig, "pnl": profits, "portfolio": portfolio(profits, weights, trade), "stopped": stop_loss(sig, profits)}
