"""Named SQL fragments for the DuckDB checks, put together by the names a statement uses."""

from __future__ import annotations

import re

_R60 = "OVER (PARTITION BY ticker_a, ticker_b ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_P = "PARTITION BY ticker_a, ticker_b"

CTES: dict[str, str] = {
    "ships": "SELECT n_name AS ticker, l_shipdate AS ts, l_extendedprice AS price, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "obs": "SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS date, CAST(sum(CAST(price AS DECIMAL(18, 4))) AS DOUBLE) AS px, CAST(sum(CAST(quantity AS DECIMAL(18, 4))) AS DOUBLE) AS volume FROM ships GROUP BY 1, 2",
    "weeks": "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 7 DAY)) AS d FROM obs)",
    "raw": "SELECT n.n_name AS ticker, w.date, floor(px / volume * 1000000 + 0.5) / 1000000 AS close, volume FROM nation n CROSS JOIN weeks w LEFT JOIN obs ON obs.ticker = n.n_name AND obs.date = w.date",
    "inc": "SELECT ticker, date, volume, coalesce(round(0.02 * (ln(close) - avg(ln(close)) OVER (PARTITION BY ticker)), 10), 0) AS step FROM raw",
    "prices": "SELECT ticker, date, round(100 * exp(sum(step) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) AS close, coalesce(volume, 0) AS volume FROM inc",
    "uni": "SELECT r_name AS grp, n_name AS ticker FROM nation JOIN region ON n_regionkey = r_regionkey",
    "pairs": "SELECT DISTINCT a.ticker AS ticker_a, b.ticker AS ticker_b FROM uni a JOIN uni b ON a.grp = b.grp AND a.ticker < b.ticker",
    "rets": "SELECT ticker, date, close, ln(close) AS log_price, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS log_ret FROM prices",
    "legs": "SELECT ticker_a, ticker_b, x.date, x.close AS a, y.close AS b FROM pairs JOIN prices x ON x.ticker = ticker_a JOIN prices y ON y.ticker = ticker_b AND y.date = x.date",
    "rlegs": "SELECT ticker_a, ticker_b, x.date, x.ret AS a, y.ret AS b FROM pairs JOIN rets x ON x.ticker = ticker_a JOIN rets y ON y.ticker = ticker_b AND y.date = x.date WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL",
    "llegs": "SELECT ticker_a, ticker_b, date, ln(a) AS a, ln(b) AS b FROM legs",
    "fit": "SELECT ticker_a, ticker_b, regr_slope(a, b) AS hedge_ratio, regr_intercept(a, b) AS intercept FROM llegs GROUP BY 1, 2",
    "spr": "SELECT ticker_a, ticker_b, date, a, b, hedge_ratio, intercept, a - hedge_ratio * b AS spread FROM llegs JOIN fit USING (ticker_a, ticker_b)",
    "zed": f"SELECT *, CASE WHEN count(spread) {_R60} = 60 THEN (spread - avg(spread) {_R60}) / nullif(stddev_samp(spread) {_R60}, 0) END AS zscore FROM spr",
    "rolls": f"SELECT ticker_a, ticker_b, date, CASE WHEN count(a) {_R60} = 60 THEN corr(a, b) {_R60} END AS corr FROM rlegs",
    "steps": f"SELECT ticker_a, ticker_b, lag(spread) OVER ({_P} ORDER BY date) AS x, spread - lag(spread) OVER ({_P} ORDER BY date) AS y FROM spr",
    "ouf": "SELECT ticker_a, ticker_b, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_count(y, x) AS n FROM steps GROUP BY 1, 2",
    "zr": f"SELECT *, row_number() OVER ({_P} ORDER BY date) AS rn FROM zed",
    "sm": """SELECT ticker_a, ticker_b, CAST(0 AS BIGINT) AS rn, 0 AS state, 0 AS held, 0 AS signal, 0 AS position, 0 AS holding_days FROM pairs
      UNION ALL
      SELECT t.ticker_a, t.ticker_b, z.rn,
        CASE WHEN z.zscore IS NULL THEN t.state WHEN t.state = 0 THEN CASE WHEN z.zscore < -2 THEN 1 WHEN z.zscore > 2 THEN -1 ELSE 0 END WHEN z.zscore * t.state > -0.5 OR t.held + 1 >= 30 THEN 0 ELSE t.state END,
        CASE WHEN z.zscore IS NULL THEN t.held WHEN t.state = 0 THEN CASE WHEN abs(z.zscore) > 2 THEN 1 ELSE 0 END WHEN z.zscore * t.state > -0.5 OR t.held + 1 >= 30 THEN 0 ELSE t.held + 1 END,
        CASE WHEN t.state = 0 AND z.zscore < -2 THEN 1 WHEN t.state = 0 AND z.zscore > 2 THEN -1 ELSE 0 END,
        CASE WHEN z.zscore IS NULL THEN 0 WHEN t.state = 0 THEN CASE WHEN z.zscore < -2 THEN 1 WHEN z.zscore > 2 THEN -1 ELSE 0 END WHEN z.zscore * t.state > -0.5 OR t.held + 1 >= 30 THEN 0 ELSE t.state END,
        CASE WHEN z.zscore IS NULL THEN 0 WHEN t.state = 0 THEN CASE WHEN abs(z.zscore) > 2 THEN 1 ELSE 0 END WHEN z.zscore * t.state > -0.5 OR t.held + 1 >= 30 THEN 0 ELSE t.held + 1 END
      FROM sm t JOIN zr z ON z.ticker_a = t.ticker_a AND z.ticker_b = t.ticker_b AND z.rn = t.rn + 1""",
    "sig": "SELECT z.ticker_a, z.ticker_b, z.date, s.signal, s.position, s.holding_days, z.spread, z.zscore, z.hedge_ratio FROM sm s JOIN zr z ON z.ticker_a = s.ticker_a AND z.ticker_b = s.ticker_b AND z.rn = s.rn WHERE z.zscore IS NOT NULL",
    "lr": f"SELECT ticker_a, ticker_b, date, a, b, row_number() OVER ({_P} ORDER BY date) AS rn FROM llegs",
    "kal": """SELECT ticker_a, ticker_b, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS m1, CAST(0 AS DOUBLE) AS m2, CAST(0.9999 AS DOUBLE) AS p11, CAST(0 AS DOUBLE) AS p12, CAST(0.9999 AS DOUBLE) AS p22 FROM pairs
      UNION ALL
      SELECT ticker_a, ticker_b, rn, m1 + h1 / s * e, m2 + h2 / s * e, q11 - h1 / s * h1, p12 - h1 / s * h2, q22 - h2 / s * h2
      FROM (SELECT *, h1 * b + h2 + 0.01 AS s, a - m1 * b - m2 AS e FROM (SELECT *, q11 * b + p12 AS h1, p12 * b + q22 AS h2 FROM (
        SELECT k.ticker_a, k.ticker_b, l.rn, l.a, l.b, k.m1, k.m2, k.p12, k.p11 + 0.0001 AS q11, k.p22 + 0.0001 AS q22
        FROM kal k JOIN lr l ON l.ticker_a = k.ticker_a AND l.ticker_b = k.ticker_b AND l.rn = k.rn + 1)))""",
    "pn0": f"""SELECT g.ticker_a, g.ticker_b, g.date, g.position, g.hedge_ratio AS beta, l.a, l.b, l.a / lag(l.a) OVER w - 1 AS ra, l.b / lag(l.b) OVER w - 1 AS rb, abs(g.position - lag(g.position) OVER w) AS turn
      FROM sig g JOIN legs l ON l.ticker_a = g.ticker_a AND l.ticker_b = g.ticker_b AND l.date = g.date WINDOW w AS (PARTITION BY g.ticker_a, g.ticker_b ORDER BY g.date)""",
    "pnl": """SELECT *, gross_return * 2000.0 AS gross_pnl, gross_return * 2000.0 - costs AS net_pnl, gross_return - costs / 2000.0 AS net_return FROM (
      SELECT ticker_a, ticker_b, date, position, coalesce(position * (ra - beta * rb), 0) AS gross_return, coalesce(turn * (abs(a) + abs(beta) * abs(b)) * 0.0015, 0) AS costs FROM pn0)""",
    "wts": """SELECT ticker_a, ticker_b, 1.0 / (SELECT count(*) FROM pairs) AS we, wi / sum(wi) OVER () AS wi FROM (
      SELECT ticker_a, ticker_b, 1.0 / (sqrt(greatest(0, (sum(net_return * net_return) - sum(net_return) * sum(net_return) / (SELECT count(DISTINCT date) FROM pnl)) / ((SELECT count(DISTINCT date) FROM pnl) - 1))) + 1e-9) AS wi FROM pnl GROUP BY 1, 2)""",
    "daily": "SELECT date, round(avg(ret), 10) AS net_return FROM rets WHERE ret IS NOT NULL GROUP BY 1",
    "curve": "SELECT date, net_return, 100000 * product(1 + net_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS portfolio_value FROM daily",
    "dd": "SELECT *, max(portfolio_value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, portfolio_value / max(portfolio_value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curve",
    "months": "SELECT ticker, last_day(date) AS month, arg_max(close, date) AS close FROM prices GROUP BY 1, 2",
    "mom": "SELECT month, avg(ret) AS ret FROM (SELECT month, ticker, ret, row_number() OVER (PARTITION BY month ORDER BY past DESC, ticker) AS rn FROM (SELECT ticker, month, close / lag(close) OVER w - 1 AS ret, lag(close, 2) OVER w / lag(close, 12) OVER w - 1 AS past FROM months WINDOW w AS (PARTITION BY ticker ORDER BY month)) WHERE past IS NOT NULL) WHERE rn <= 5 GROUP BY 1",
    "spans": "SELECT month AS since, lead(month) OVER (ORDER BY month) AS until, coalesce(ret, 0) AS ret FROM (SELECT DISTINCT month FROM months) LEFT JOIN mom USING (month)",
    "momd": "SELECT d.date, coalesce(ret, 0) / 21 AS net_return FROM (SELECT DISTINCT date FROM prices) d LEFT JOIN spans ON d.date >= since AND (until IS NULL OR d.date < until)",
    "bol": "SELECT date, ret, row_number() OVER (ORDER BY date) AS rn, CASE WHEN count(close) OVER w = 20 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z FROM rets WHERE ticker = 'NATION_0' WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "bsm": """SELECT CAST(0 AS BIGINT) AS rn, 0 AS state, 0 AS shown, CAST(NULL AS DATE) AS date, CAST(0 AS DOUBLE) AS ret, 0 AS held FROM (SELECT 1)
      UNION ALL
      SELECT b.rn, CASE WHEN b.z IS NULL THEN t.state WHEN t.state = 0 THEN CASE WHEN b.z < -1.5 THEN 1 WHEN b.z > 1.5 THEN -1 ELSE 0 END WHEN b.z * t.state > 0 THEN 0 ELSE t.state END,
        CASE WHEN b.z IS NULL THEN 0 WHEN t.state = 0 THEN CASE WHEN b.z < -1.5 THEN 1 WHEN b.z > 1.5 THEN -1 ELSE 0 END WHEN b.z * t.state > 0 THEN 0 ELSE t.state END, b.date, coalesce(b.ret, 0), t.shown
      FROM bsm t JOIN bol b ON b.rn = t.rn + 1""",
    "bench": """SELECT 'buy_hold_NATION_0' AS strategy, date, ret AS net_return FROM rets WHERE ticker = 'NATION_0' AND ret IS NOT NULL
      UNION ALL SELECT 'buy_hold_NATION_1', date, ret FROM rets WHERE ticker = 'NATION_1' AND ret IS NOT NULL UNION ALL SELECT 'momentum', date, net_return FROM momd
      UNION ALL SELECT 'mean_reversion', date, held * ret FROM bsm WHERE rn > 0
      UNION ALL SELECT 'balanced_60_40', e.date, 0.6 * e.ret + 0.4 * b.ret FROM rets e JOIN rets b ON e.date = b.date WHERE e.ticker = 'NATION_0' AND b.ticker = 'NATION_5' AND e.ret IS NOT NULL AND b.ret IS NOT NULL""",
    "lcg": "SELECT p AS path_id, s AS step, CAST((p * 7919 + s * 104729) % 65536 * 1103515245 + 12345 AS BIGINT) % 2147483648 / 2147483648.0 AS u FROM (SELECT unnest(generate_series(0, 199)) AS p) CROSS JOIN (SELECT unnest(generate_series(1, 63)) AS s)",
    "paths": "SELECT path_id, CAST(step AS INTEGER) AS step, 100000 * exp(sum(0.04 * (u - 0.5)) OVER (PARTITION BY path_id ORDER BY step ROWS UNBOUNDED PRECEDING)) AS value FROM lcg UNION ALL SELECT path_id, 0, 100000.0 FROM lcg WHERE step = 1",
    "nret": "SELECT date, net_return, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n, avg(net_return) OVER () AS mean FROM daily",
    "scen": """SELECT 'baseline' AS scenario, date, net_return FROM nret
      UNION ALL SELECT 'vol_shock_3x', date, CASE WHEN pos >= floor(n * 0.5) AND pos < floor(n * 0.5) + 20 THEN net_return * 3 ELSE net_return END FROM nret
      UNION ALL SELECT 'vol_shock_5x', date, CASE WHEN pos >= floor(n * 0.5) AND pos < floor(n * 0.5) + 10 THEN net_return * 5 ELSE net_return END FROM nret
      UNION ALL SELECT 'liquidity_crisis', date, CASE WHEN pos >= floor(n * 0.7) AND pos < floor(n * 0.7) + 15 THEN net_return - 0.01 ELSE net_return END FROM nret
      UNION ALL SELECT 'bear_regime', date, CASE WHEN pos >= floor(n * 0.5) AND pos < floor(n * 0.5) + 60 THEN net_return - abs(mean) * 0.5 ELSE net_return END FROM nret""",
    "toy": f"""SELECT ticker_a, ticker_b, date, a, b, rn, CASE (rn % 8) WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN -1 WHEN 6 THEN -1 ELSE 0 END AS position, (a / lag(a) OVER w - b / lag(b) OVER w) * 1000 AS d
      FROM (SELECT *, row_number() OVER ({_P} ORDER BY date) AS rn FROM legs) WINDOW w AS ({_P} ORDER BY date)""",
    "toyp": "SELECT ticker_a, ticker_b, date, CAST(position AS INTEGER) AS position, round(coalesce(position * d, 0), 6) AS net_pnl FROM toy",
    "trd": f"SELECT ticker_a, ticker_b, tid, sum(net_pnl) AS pnl, count(*) AS days, row_number() OVER ({_P} ORDER BY tid) AS n FROM (SELECT *, sum(chg) OVER ({_P} ORDER BY date ROWS UNBOUNDED PRECEDING) AS tid FROM (SELECT *, coalesce(CAST(position <> lag(position) OVER ({_P} ORDER BY date) AS INTEGER), 1) AS chg FROM toyp)) WHERE position <> 0 GROUP BY 1, 2, 3",
    "runs": f"SELECT ticker_a, ticker_b, win, count(*) AS len FROM (SELECT *, n - row_number() OVER (PARTITION BY ticker_a, ticker_b, win ORDER BY n) AS isl FROM (SELECT *, pnl > 0 AS win FROM trd)) GROUP BY ticker_a, ticker_b, win, isl",
}
_MATERIALIZED = {"zr", "lr", "sig", "prices", "pnl", "bol", "rets"}


def metrics_sql(source: str, key: str = "") -> str:
    """All return metrics of ``source`` (key, date, net_return, portfolio_value); the name of a CTE."""
    k, part, on = (f"{key}, ", f"PARTITION BY {key} ", f"USING ({key})") if key else ("", "", "ON true")
    g = f"GROUP BY {key}" if key else ""
    return f"""SELECT {k}total_return, CASE WHEN n > 0 THEN pow(1 + total_return, 252.0 / n) - 1 ELSE 0 END AS cagr, daily_std * sqrt(252) AS annual_vol, daily_mean, daily_std, skewness, kurtosis, best_day, worst_day,
      max_drawdown, coalesce(avg_drawdown, 0) AS avg_drawdown, drawdown_days, coalesce(date_diff('day', trough, back), -1) AS recovery_days,
      CASE WHEN daily_std <> 0 THEN (daily_mean - 0.05 / 252) / daily_std * sqrt(252) ELSE 0 END AS sharpe, coalesce(CASE WHEN down <> 0 THEN (daily_mean - 0.05 / 252) / down * sqrt(252) ELSE 0 END, 0) AS sortino,
      CASE WHEN max_drawdown <> 0 THEN (pow(1 + total_return, 252.0 / n) - 1) / abs(max_drawdown) ELSE 0 END AS calmar, CASE WHEN coalesce(short, 0) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE coalesce(gain, 0) / short END AS omega, var_95, cvar_95, var_99, cvar_99
    FROM (SELECT {k}product(1 + net_return) - 1 AS total_return, count(*) AS n, avg(net_return) AS daily_mean, stddev_samp(net_return) AS daily_std, skewness(net_return) AS skewness, kurtosis(net_return) AS kurtosis, max(net_return) AS best_day, min(net_return) AS worst_day,
      min(drawdown) AS max_drawdown, avg(drawdown) FILTER (drawdown < 0) AS avg_drawdown, count(*) FILTER (drawdown < 0) AS drawdown_days, max(trough) AS trough, min(date) FILTER (date >= trough AND portfolio_value >= top) AS back,
      stddev_samp(net_return) FILTER (net_return < 0.05 / 252) AS down, sum(net_return - 0.05 / 252) FILTER (net_return > 0.05 / 252) AS gain, sum(0.05 / 252 - net_return) FILTER (net_return < 0.05 / 252) AS short,
      max(v95) AS var_95, max(v99) AS var_99, avg(net_return) FILTER (net_return <= v95) AS cvar_95, avg(net_return) FILTER (net_return <= v99) AS cvar_99
    FROM (SELECT *, max(portfolio_value) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, (portfolio_value - max(portfolio_value) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING)) / max(portfolio_value) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS drawdown FROM {source}) x
    JOIN (SELECT {k}quantile_cont(net_return, 0.05) AS v95, quantile_cont(net_return, 0.01) AS v99, arg_min(date, drawdown) AS trough, arg_min(peak, drawdown) AS top FROM (SELECT *, (portfolio_value - max(portfolio_value) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING)) / max(portfolio_value) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS drawdown, max(portfolio_value) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {source}) {g}) t {on} {g})"""


CTES["benchc"] = "SELECT *, product(1 + net_return) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS portfolio_value FROM bench"
CTES["scenc"] = "SELECT *, product(1 + net_return) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING) AS portfolio_value FROM scen"
CTES["perf"] = metrics_sql("curve")
CTES["benchm"] = metrics_sql("benchc", "strategy")
CTES["scenm"] = metrics_sql("scenc", "scenario")


def _used(text: str) -> set[str]:
    found: set[str] = set()
    todo = [text]
    while todo:
        for name in set(re.findall(r"[a-z_0-9]+", todo.pop())) & CTES.keys() - found:
            if re.search(rf"(?:FROM|JOIN)\s+{name}\b", text) or any(re.search(rf"(?:FROM|JOIN)\s+{name}\b", CTES[f]) for f in found):
                found.add(name)
                todo.append(CTES[name])
    return found


def statement(body: str) -> str:
    """The statement with the fragments it needs, each before its users."""
    used = _used(body)
    parts = [f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({CTES[n]})" for n in CTES if n in used]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def rounded(source: str, keys: str, floats: str, digits: int = 6) -> str:
    """Keys as they are, then rounded doubles."""
    cols = [keys] if keys else []
    cols += [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats.split()]
    return statement(f"SELECT {', '.join(cols)} FROM {source}")
