"""Default parameters of the engine, as plain immutable values. Importing this creates nothing."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DataConfig:
    start: str = "2015-01-01"
    end: str = "2024-12-31"
    interval: str = "1d"
    min_history: int = 252
    winsor: float = 0.01
    fill: str = "ffill"
    min_price: float = 5.0
    min_dollar_volume: float = 1e6


@dataclass(frozen=True)
class PairConfig:
    corr_window: int = 252
    min_corr: float = 0.70
    eg_pvalue: float = 0.05
    adf_pvalue: float = 0.05
    hurst_max: float = 0.50
    half_life: tuple[float, float] = (5.0, 60.0)
    min_observations: int = 60
    top_n: int = 20


@dataclass(frozen=True)
class SignalConfig:
    entry: float = 2.0
    exit: float = 0.5
    stop: float = 3.5
    lookback: int = 60
    max_holding: int = 30
    stop_mode: str = "symmetric"  # "adverse" closes a position when the spread diverges further
    kalman_q: float = 1e-4
    kalman_r: float = 1e-2


@dataclass(frozen=True)
class TradeConfig:
    capital: float = 100_000.0
    commission: float = 0.001
    slippage: float = 0.0005
    risk_free: float = 0.05
    periods: int = 252
    lag_positions: bool = False


@dataclass(frozen=True)
class RiskConfig:
    target_vol: float = 0.01
    drawdown_limit: float = 0.20
    cap: float = 0.25
    kelly: float = 0.5
    pair_stop: float = 0.05
    vol_rows: int = 21


@dataclass(frozen=True)
class SimulationConfig:
    paths: int = 10_000
    horizon: int = 252
    block: int = 21
    confidence: tuple[float, ...] = (0.95, 0.99)
    seed: int = 42


@dataclass(frozen=True)
class Config:
    data: DataConfig = field(default_factory=DataConfig)
    pairs: PairConfig = field(default_factory=PairConfig)
    signals: SignalConfig = field(default_factory=SignalConfig)
    trade: TradeConfig = field(default_factory=TradeConfig)
    risk: RiskConfig = field(default_factory=RiskConfig)
    simulation: SimulationConfig = field(default_factory=SimulationConfig)
