"""Numerics against published values, closed forms and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.config import SignalConfig
from pairloom.functions import stats
from pairloom.operators.benchmarks import reversion_states
from pairloom.operators.trading import rules


def test_mackinnon_at_published_critical_values():
    assert stats.mackinnon_p(-2.86, 1) == pytest.approx(0.050, abs=0.002)
    assert stats.mackinnon_p(-3.34, 2) == pytest.approx(0.049, abs=0.002)
    assert stats.mackinnon_p(-30.0) == 0.0 and stats.mackinnon_p(5.0) == 1.0


def test_battery_tells_cointegrated_from_independent():
    rng = np.random.default_rng(42)
    common = np.cumsum(rng.normal(size=500))
    a, b = common + rng.normal(0, 0.5, 500), 1.5 * common + rng.normal(0, 0.5, 500)
    assert stats.engle_granger(a, b)[1] < 0.05
    assert stats.johansen_trace(a, b) > stats.TRACE_90
    assert stats.adf(a - b / 1.5) < -3 and stats.kpss(common)[1] <= 0.05
    assert stats.engle_granger(a, a)[0] == -math.inf


def test_adf_size_is_near_nominal():
    rng = np.random.default_rng(1)
    hits = sum(stats.mackinnon_p(stats.adf(np.cumsum(rng.normal(size=150)))) < 0.05 for _ in range(200))
    assert 2 <= hits <= 22


def test_kalman_equals_matrix_form():
    rng = np.random.default_rng(3)
    b = np.cumsum(rng.normal(size=60)) + 20
    a = 1.3 * b + 2 + rng.normal(size=60)
    slope, intercept, resid = stats.kalman_hedge(a, b)
    m, p = np.zeros(2), np.eye(2)
    for t in range(60):
        if t:
            p = p + 1e-4 * np.eye(2)
        h = np.array([b[t], 1.0])
        k = p @ h / (h @ p @ h + 1e-2)
        m, p = m + k * (a[t] - h @ m), p - np.outer(k, h @ p)
        assert np.allclose(m, [slope[t], intercept[t]], atol=1e-8)
    assert np.allclose(resid, a - slope * b - intercept)


def test_correlation_helpers():
    assert stats.kendall_tau_b(np.array([1, 2, 3.0]), np.array([1, 3, 2.0])) == pytest.approx(1 / 3)
    assert stats.t_two_sided(0.5, 20) == pytest.approx(0.0247, abs=2e-4)
    assert stats.t_two_sided(0.0, 20) == pytest.approx(1.0)
    assert stats.complete_linkage(np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]]), 2) == [0, 0, 1]


def test_hurst_of_short_series_is_one_half():
    assert stats.hurst(np.arange(3.0)) == 0.5
    assert stats.hurst(np.random.default_rng(0).normal(size=500)) == pytest.approx(0.55, abs=0.15)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.floats(-5, 5), st.just(math.nan)), max_size=60))
def test_state_machine_invariants(z):
    p = SignalConfig(max_holding=5)
    signal, position, holding = rules(np.array(z, float), p)
    assert set(position.tolist()) <= {-1, 0, 1} and (holding < p.max_holding).all()
    assert ((signal != 0) <= (position == signal)).all()
    assert all(position[i] == 0 for i, x in enumerate(z) if math.isnan(x))


def test_state_keeps_through_a_missing_z_and_thresholds_are_strict():
    z = np.array([-2.0, -2.1, math.nan, -1.0, -0.5, -0.4])
    signal, position, holding = rules(z, SignalConfig())
    assert signal.tolist() == [0, 1, 0, 0, 0, 0] and position.tolist() == [0, 1, 0, 1, 1, 0] and holding.tolist() == [0, 1, 0, 2, 3, 0]
    assert reversion_states(np.array([-1.6, -1.0, 0.1, 1.6])).tolist() == [1, 1, 0, -1]
