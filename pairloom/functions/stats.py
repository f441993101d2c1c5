"""Unit-root and cointegration statistics in numpy, from the published papers.

ADF: Said and Dickey 1984, lag by AIC; p-values: MacKinnon 1994. KPSS: Kwiatkowski et al. 1992
with the bandwidth of Hobijn et al. 1998. Trace statistic: Johansen 1991. Filter: Kalman 1960.
"""

from __future__ import annotations

import math

import numpy as np

# MacKinnon's response surfaces with a constant (branch point, range, small and large branch),
# for one and two series; KPSS critical values at 10, 5, 2.5 and 1 %; the 90 % trace value of two series.
MACKINNON = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
TRACE_90 = 13.4294


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def mackinnon_p(stat: float, series: int = 1) -> float:
    branch, low, high, small, large = MACKINNON[series]
    if math.isnan(stat):
        return math.nan
    if stat < low:
        return 0.0
    if stat > high:
        return 1.0
    return normal_cdf(sum(c * stat**k for k, c in enumerate(small if stat <= branch else large)))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, y - x @ beta, float(np.sum((y - x @ beta) ** 2))


def adf(y: np.ndarray, constant: bool = True) -> float:
    """The ADF t-statistic: lag chosen by AIC over one common sample, then refitted on its own."""
    y = np.asarray(y, float)
    n = len(y)
    extra = 1 if constant else 0
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - extra - 1)
    if most < 0:
        return math.nan
    dy = np.diff(y)

    def design(lags: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(drop, len(dy))
        cols = [y[rows]] + [dy[rows - k] for k in range(1, lags + 1)] + ([np.ones(len(rows))] if constant else [])
        return dy[rows], np.column_stack(cols)

    best, lags = math.inf, 0
    for k in range(most + 1):
        target, x = design(k, most)
        rss, m = _ols(target, x)[2], len(target)
        if rss <= 0:
            return -math.inf
        aic = m * math.log(rss / m) + 2 * x.shape[1]
        if aic < best:
            best, lags = aic, k
    target, x = design(lags, lags)
    beta, _, rss = _ols(target, x)
    free = len(target) - x.shape[1]
    if free <= 0:
        return math.nan
    se = math.sqrt(rss / free * np.linalg.pinv(x.T @ x)[0, 0])
    return float(beta[0] / se) if se > 0 else -math.inf


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    x = np.column_stack([b, np.ones(len(b))])
    beta, resid, rss = _ols(np.asarray(a, float), x)
    total = float(np.sum((a - np.mean(a)) ** 2))
    if total > 0 and rss / total < 1e-14:
        return -math.inf, 0.0
    stat = adf(resid, constant=False)
    return stat, mackinnon_p(stat, 2)


def kpss(y: np.ndarray) -> tuple[float, float]:
    e = np.asarray(y, float) - np.mean(y)
    n = len(e)
    pilot = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, pilot + 1):
        p = 2 * float(e[i:] @ e[:-i]) / n
        s0 += p
        s1 += i * p
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    variance = float(e @ e) / n
    for i in range(1, lags + 1):
        variance += 2 * (1 - i / (lags + 1)) * float(e[i:] @ e[:-i]) / n
    stat = float(np.sum(np.cumsum(e) ** 2)) / (n * n * variance)
    at, p = zip(*KPSS_TABLE)
    return stat, float(np.interp(stat, at, p))


def johansen_trace(a: np.ndarray, b: np.ndarray) -> float:
    """Trace statistic of rank 0 with a constant and one lagged difference."""
    x = np.column_stack([a, b]).astype(float)
    x = x - x.mean(axis=0)
    d = np.diff(x, axis=0)
    now, lagged, level = (v - v.mean(axis=0) for v in (d[1:], d[:-1], x[1:-1]))
    r0 = now - lagged @ np.linalg.lstsq(lagged, now, rcond=None)[0]
    rk = level - lagged @ np.linalg.lstsq(lagged, level, rcond=None)[0]
    t = len(r0)
    s00, s0k, skk = r0.T @ r0 / t, r0.T @ rk / t, rk.T @ rk / t
    values = np.linalg.eigvals(np.linalg.solve(skk, s0k.T) @ np.linalg.solve(s00, s0k))
    return float(-t * np.sum(np.log(1 - np.clip(values.real, 0, 1 - 1e-15))))


def kalman_hedge(a: np.ndarray, b: np.ndarray, q: float = 1e-4, r: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered slope and intercept of a = slope * b + intercept, and the residual after the update."""
    n = len(a)
    slope, intercept = np.empty(n), np.empty(n)
    m1 = m2 = p12 = 0.0
    p11 = p22 = 1.0
    for t in range(n):
        if t:
            p11 += q
            p22 += q
        x = b[t]
        h1, h2 = p11 * x + p12, p12 * x + p22
        s = h1 * x + h2 + r
        k1, k2, e = h1 / s, h2 / s, a[t] - m1 * x - m2
        m1 += k1 * e
        m2 += k2 * e
        p11, p12, p22 = p11 - k1 * h1, p12 - k1 * h2, p22 - k2 * h2
        slope[t], intercept[t] = m1, m2
    return slope, intercept, a - slope * b - intercept


def hurst(x: np.ndarray, longest: int = 100) -> float:
    """Rescaled-range exponent over non-overlapping chunks; 0.5 where fewer than two lags can be measured."""
    x = np.asarray(x, float)
    n, lags, means = len(x), [], []
    for lag in range(2, min(longest, n // 2)):
        k = len(range(0, n - lag, lag))
        c = x[: k * lag].reshape(k, lag)
        c = c[c.std(axis=1) > 1e-12]  # equal values may leave rounding noise
        if len(c):
            walk = np.cumsum(c - c.mean(axis=1, keepdims=True), axis=1)
            rs = np.mean((walk.max(axis=1) - walk.min(axis=1)) / c.std(axis=1))
            if rs > 0:
                lags.append(lag)
                means.append(rs)
    return float(np.polyfit(np.log(lags), np.log(means), 1)[0]) if len(lags) > 1 else 0.5


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    n = len(x)
    if n < 2:
        return math.nan
    i, j = np.triu_indices(n, 1)
    dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    known = math.sqrt(float(np.count_nonzero(dx)) * float(np.count_nonzero(dy)))
    return float(np.sum(dx * dy)) / known if known else math.nan


def t_two_sided(r: float, n: int) -> float:
    """Two-sided p of a correlation under the t distribution with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    free = n - 2
    return incomplete_beta(free / 2, 0.5, free / (free + r * r * free / (1 - r * r)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 300):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + up * d or 1e-300)
        c = 1 + up / c or 1e-300
        f *= c * d
        up = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + up * d or 1e-300)
        c = 1 + up / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def complete_linkage(distance: np.ndarray, k: int) -> list[int]:
    """Agglomerative clustering down to ``k`` clusters; labels in order of each cluster's first member."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > max(1, k):
        best = min(((max(distance[i, j] for i in g for j in h), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y))
        groups[best[1]] = sorted(groups[best[1]] + groups.pop(best[2]))
    label = {i: n for n, g in enumerate(sorted(groups)) for i in g}
    return [label[i] for i in range(len(distance))]
