"""Every registered query of the engine, beside the DuckDB statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.config import Config
from pairloom.functions.windows import PAIR, ordered
from pairloom.operators import benchmarks as B
from pairloom.operators import cleaning as C
from pairloom.operators import metrics as M
from pairloom.operators import pairs as P
from pairloom.operators import ranking as R
from pairloom.operators import simulation as X
from pairloom.operators import spread as S
from pairloom.operators import trading as T
from pairloom.plans.sqltext import rounded, statement
from pairloom.sources import panel as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EQUITY, SECOND, BOND = "NATION_0", "NATION_1", "NATION_5"
K = "ticker_a, ticker_b"
CFG = Config()


def query(name: str, sql: str | None = None, digits: int = 6):
    """Registers a query; its doubles are rounded like the check's."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def legs(s, d, column="close"):
    return P.legs(src.index_panel(s, d), P.within_groups(src.universe(s, d)), column)


def log_legs(s, d):
    return legs(s, d).withColumns({"a": F.ln("a"), "b": F.ln("b")})


def return_legs(s, d):
    return P.legs(C.with_returns(src.index_panel(s, d)), P.within_groups(src.universe(s, d)), "ret")


def zscored(s, d):
    return S.with_zscore(S.ols(log_legs(s, d)))


def rets(s, d):
    return C.with_returns(src.index_panel(s, d))


def daily(s, d):
    """One equal-weight return a week: the series that metrics and simulations run on."""
    return rets(s, d).filter("ret IS NOT NULL").groupBy("date").agg(F.round(F.avg("ret"), 10).alias("net_return"))


def curve(s, d):
    return M.curve(daily(s, d), start=100_000.0)


def toy_positions(s, d):
    """Positions of a fixed cycle on real prices, for operators that take given positions."""
    w = ordered(*PAIR)
    n = F.row_number().over(w) % 8
    pos = F.when(n.isin(1, 2, 3), 1).when(n.isin(5, 6), -1).otherwise(0)
    change = (F.col("a") / F.lag("a").over(w) - F.col("b") / F.lag("b").over(w)) * 1000
    rows = legs(s, d).withColumn("position", pos).withColumn("d", change)
    return rows.select(*PAIR, "date", "position", F.round(F.coalesce(F.col("position") * F.col("d"), F.lit(0.0)), 6).alias("net_pnl"))


def toy_paths(s):
    """Paths of an integer generator, the same in any engine."""
    u = (F.expr("(path_id * 7919 + step * 104729) % 65536 * 1103515245 + 12345") % F.lit(2147483648)) / 2147483648.0
    return X.with_start(X.grid(s, 200, 63).withColumn("value", 100_000 * F.exp(F.sum(0.04 * (u - 0.5)).over(X.path_so_far()))), 100_000.0)


# Panels and sources
query("panel_index", rounded("prices", "ticker, date", "close volume"))(src.index_panel)
query("panel_raw_levels", rounded("raw", "ticker, date", "close volume"))(src.raw_levels)
query("panel_events", "SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, round(avg(value), 6) AS close FROM events GROUP BY 1, 2")(src.event_panel)
query("universe_groups", statement("SELECT grp, ticker FROM uni"))(src.universe)
query("universe_tickers", statement("SELECT DISTINCT ticker FROM uni ORDER BY ticker"))(lambda s, d: src.universe(s, d).select("ticker").distinct().orderBy("ticker"))


@query("group_of", statement("SELECT t.ticker, min(grp) AS grp FROM (SELECT ticker FROM uni UNION ALL SELECT 'NOWHERE') t LEFT JOIN uni u USING (ticker) GROUP BY 1"))
def _(s, d):
    u = src.universe(s, d)
    return src.group_of(u, u.select("ticker").union(s.range(1).select(F.lit("NOWHERE"))))


query("ohlcv_bars", statement("SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS date, arg_min(u, (ts, u)) AS open, max(u) AS high, min(u) AS low, arg_max(u, (ts, u)) AS close, round(sum(quantity), 6) AS volume FROM (SELECT *, floor(price / quantity * 1000000 + 0.5) / 1000000 AS u FROM ships) GROUP BY 1, 2"))(src.ohlcv)
query("ohlcv_one", statement("SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS date, arg_min(u, (ts, u)) AS open, max(u) AS high, min(u) AS low, arg_max(u, (ts, u)) AS close, round(sum(quantity), 6) AS volume FROM (SELECT *, floor(price / quantity * 1000000 + 0.5) / 1000000 AS u FROM ships) WHERE ticker = 'NATION_0' GROUP BY 1, 2"))(lambda s, d: src.ohlcv(s, d, [EQUITY]))
query("fetch_range", statement("SELECT ticker, date, close FROM prices WHERE ticker IN ('NATION_0', 'NATION_1') AND date >= DATE '1994-01-01' AND date < DATE '1996-01-01'"))(lambda s, d: src.fetch(src.index_panel(s, d), [EQUITY, SECOND], "1994-01-01", "1996-01-01"))


@query("json_daily_bars", statement("SELECT ticker, date, close AS open, close AS high, close AS low, close, close AS adj_close, round(volume, 6) AS volume FROM prices"))
def _(s, d):
    p = src.index_panel(s, d)
    c = F.col("close").cast("string")
    bar = F.struct(c.alias("1. open"), c.alias("2. high"), c.alias("3. low"), c.alias("4. close"), c.alias("5. adjusted close"), F.col("volume").cast("string").alias("6. volume"))
    docs = p.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), bar))).alias("series"))
    return src.parse_daily_json(docs.select(F.to_json(F.struct(F.struct(F.col("ticker").alias("symbol")).alias("meta"), "series")).alias("body")))


# Cleaning
_LOCF = "last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
_NOCB = "first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
query("clean_min_history", statement("SELECT ticker, date, close, volume FROM raw WHERE ticker IN (SELECT ticker FROM raw GROUP BY 1 HAVING count(close) >= 252)"))(lambda s, d: C.min_history(src.raw_levels(s, d)))
query("fill_forward", statement(f"SELECT ticker, date, {_LOCF} AS close FROM raw"))(lambda s, d: C.fill_forward(src.raw_levels(s, d)).select("ticker", "date", "close"))
query("fill_backward", statement(f"SELECT ticker, date, {_NOCB} AS close FROM raw"))(lambda s, d: C.fill_backward(src.raw_levels(s, d)).select("ticker", "date", "close"))
query("fill_time_interp", statement(f"""SELECT ticker, date, round(CASE WHEN close IS NOT NULL THEN close WHEN qd IS NULL THEN pc WHEN pd IS NOT NULL THEN pc + (qc - pc) * (date_diff('day', pd, date) / CAST(date_diff('day', pd, qd) AS DOUBLE)) END, 6) AS close
  FROM (SELECT *, {_LOCF} AS pc, {_NOCB} AS qc, {_LOCF.replace('(close', '(seen')} AS pd, {_NOCB.replace('(close', '(seen')} AS qd FROM (SELECT *, CASE WHEN close IS NOT NULL THEN date END AS seen FROM raw))"""))(lambda s, d: C.fill_time(src.raw_levels(s, d)).select("ticker", "date", "close"))
query("drop_empty_dates", statement("SELECT ticker, date, close FROM raw WHERE ticker <> 'X' AND date IN (SELECT date FROM raw WHERE close IS NOT NULL)"))(lambda s, d: C.drop_empty_dates(src.raw_levels(s, d)).select("ticker", "date", "close"))
query("positive_repair", "SELECT event_type AS ticker, date, round(last_value(c IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY date, event_id ROWS UNBOUNDED PRECEDING), 6) AS close, event_id FROM (SELECT event_type, ts AS date, event_id, CASE WHEN value > 30 THEN value - 30 END AS c FROM events)")(
    lambda s, d: src.table(s, d, "events").select(F.col("event_type").alias("ticker"), F.col("ts").alias("date"), (F.col("value") - 30).alias("close"), "event_id")
    .withColumn("close", F.last(F.when(F.col("close") > 0, F.col("close")), True).over(Window.partitionBy("ticker").orderBy("date", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
)
query("positive_repair_panel", statement("SELECT ticker, date, last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM (SELECT ticker, date, CASE WHEN close - 900 > 0 THEN round(close - 900, 6) END AS c FROM raw)"))(
    lambda s, d: C.positive_repair(src.raw_levels(s, d).select("ticker", "date", F.round(F.col("close") - 900, 6).alias("close")))
)
query("returns_simple", rounded("rets", "ticker, date", "ret"))(lambda s, d: rets(s, d).select("ticker", "date", "ret"))
query("returns_log", rounded("rets", "ticker, date", "log_price log_ret"))(lambda s, d: rets(s, d).select("ticker", "date", "log_price", "log_ret"))
query("returns_winsorised", statement("SELECT ticker, date, round(least(greatest(ret, lo), hi), 6) + 0.0 AS ret FROM rets JOIN (SELECT ticker, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM rets GROUP BY 1) USING (ticker) WHERE ret IS NOT NULL"))(
    lambda s, d: C.winsorise(rets(s, d)).select("ticker", "date", "ret").filter("ret IS NOT NULL")
)
query("preprocess_bundle", statement(f"""SELECT ticker, date, round(close, 6) AS close, round(ln(close), 6) AS log_price, round(ret, 6) + 0.0 AS ret FROM (
  SELECT f.ticker, date, close, least(greatest(r, lo), hi) AS ret FROM (SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM (SELECT ticker, date, {_LOCF} AS close FROM raw)) f
  JOIN (SELECT ticker, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM (SELECT ticker, date, {_LOCF} AS close FROM raw)) GROUP BY 1) b ON b.ticker = f.ticker WHERE r IS NOT NULL)"""))(
    lambda s, d: C.preprocess(src.raw_levels(s, d), rows=50).select("ticker", "date", "close", "log_price", "ret").filter("ret IS NOT NULL")
)
query("normalise_minmax", statement("SELECT ticker, date, round((close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0), 6) + 0.0 AS norm FROM prices WINDOW w AS (PARTITION BY ticker)"))(lambda s, d: C.normalise(src.index_panel(s, d)).select("ticker", "date", "norm"))
query("standardise", statement("SELECT ticker, date, round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 5) + 0.0 AS std FROM prices WINDOW w AS (PARTITION BY ticker)"), 5)(lambda s, d: C.standardise(src.index_panel(s, d)).select("ticker", "date", "std"))
query("rebase", statement("SELECT ticker, date, round(close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) * 100, 6) AS rebased FROM prices"))(lambda s, d: C.rebase(src.index_panel(s, d)).select("ticker", "date", "rebased"))
query("rolling_vol", statement("SELECT ticker, date, round(CASE WHEN count(log_ret) OVER w = 21 THEN stddev_samp(log_ret) OVER w * sqrt(252) END, 6) AS vol FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"))(lambda s, d: C.realised_vol(rets(s, d)).select("ticker", "date", "vol"))
query("align_inner", statement("SELECT x.date, x.close AS a, y.close AS b, z.close AS c FROM raw x JOIN raw y USING (date) JOIN raw z USING (date) WHERE x.ticker = 'NATION_0' AND y.ticker = 'NATION_1' AND z.ticker = 'NATION_5' AND x.close IS NOT NULL AND y.close IS NOT NULL AND z.close IS NOT NULL"))(
    lambda s, d: src.align(*[src.raw_levels(s, d).filter(F.col("ticker") == t).select("date", F.col("close").alias(c)) for t, c in ((EQUITY, "a"), (SECOND, "b"), (BOND, "c"))])
)
query("beta", statement("SELECT x.ticker, round(regr_slope(x.ret, m.ret), 6) + 0.0 AS beta FROM rets x JOIN rets m USING (date) WHERE m.ticker = 'NATION_0' AND x.ret IS NOT NULL AND m.ret IS NOT NULL GROUP BY 1"))(lambda s, d: C.beta(rets(s, d), rets(s, d).filter(F.col("ticker") == EQUITY)))
query("liquidity_filter", statement("SELECT ticker, round(avg(close), 6) AS mean_close, round(avg(close * volume), 4) AS mean_value FROM prices GROUP BY 1 HAVING avg(close) >= 5 AND avg(close * volume) >= 1000"))(
    lambda s, d: C.liquid(src.index_panel(s, d), 5.0, 1000.0).withColumn("mean_value", F.round("mean_value", 4))
)

# Pairs and correlation
query("pairs_in_group", statement("SELECT ticker_a, ticker_b FROM pairs"))(lambda s, d: P.within_groups(src.universe(s, d)))
query("pairs_cross", statement("SELECT a.ticker AS ticker_a, b.ticker AS ticker_b FROM uni a JOIN uni b ON a.ticker < b.ticker"))(lambda s, d: P.across(src.universe(s, d)))
query("pairs_eligible", statement("SELECT ticker_a, ticker_b FROM pairs WHERE ticker_a IN (SELECT ticker FROM raw GROUP BY 1 HAVING count(close) >= 252) AND ticker_b IN (SELECT ticker FROM raw GROUP BY 1 HAVING count(close) >= 252)"))(
    lambda s, d: P.eligible(P.within_groups(src.universe(s, d)), C.min_history(src.raw_levels(s, d)).select("ticker").distinct())
)
query("corr_pearson", statement(f"SELECT {K}, round(corr(a, b), 6) + 0.0 AS correlation, count(*) AS n FROM rlegs GROUP BY 1, 2"))(lambda s, d: P.correlation(return_legs(s, d)))
_RANKS = f"SELECT {K}, rank() OVER (PARTITION BY {K} ORDER BY a) + (count(*) OVER (PARTITION BY {K}, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {K} ORDER BY b) + (count(*) OVER (PARTITION BY {K}, b) - 1) / 2.0 AS rb FROM rlegs"
query("corr_spearman", statement(f"SELECT {K}, round(corr(ra, rb), 6) + 0.0 AS correlation, count(*) AS n FROM ({_RANKS}) GROUP BY 1, 2"))(lambda s, d: P.correlation(return_legs(s, d), "spearman"))
query("corr_kendall", statement(f"""SELECT x.ticker_a, x.ticker_b, round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(CAST(sum(CAST(x.a <> y.a AS INTEGER)) AS DOUBLE) * CAST(sum(CAST(x.b <> y.b AS INTEGER)) AS DOUBLE)), 6) + 0.0 AS correlation, max(n) AS n
  FROM rlegs x JOIN rlegs y ON x.ticker_a = y.ticker_a AND x.ticker_b = y.ticker_b AND x.date < y.date JOIN (SELECT {K}, count(*) AS n FROM rlegs GROUP BY 1, 2) c ON c.ticker_a = x.ticker_a AND c.ticker_b = x.ticker_b GROUP BY 1, 2"""))(lambda s, d: P.correlation(return_legs(s, d), "kendall"))
query("corr_high_pairs", statement(f"SELECT {K}, round(c, 6) + 0.0 AS correlation, n FROM (SELECT {K}, corr(a, b) AS c, count(*) AS n FROM rlegs GROUP BY 1, 2) WHERE abs(c) >= 0.05"))(lambda s, d: P.high(P.correlation(return_legs(s, d)), 0.05))
query("corr_pvalues")(lambda s, d: P.with_pvalue(P.correlation(return_legs(s, d))))
query("corr_spearman_pvalues")(lambda s, d: P.with_pvalue(P.correlation(return_legs(s, d), "spearman")))
query("corr_clusters")(lambda s, d: P.clusters(P.correlation(P.legs(rets(s, d), P.across(src.universe(s, d)), "ret"))))
query("rolling_corr", statement("SELECT ticker_a, ticker_b, date, round(corr, 5) + 0.0 AS corr FROM rolls WHERE corr IS NOT NULL AND ticker_a = 'NATION_0'"), 5)(lambda s, d: P.rolling(return_legs(s, d).filter(F.col("ticker_a") == EQUITY), 60))
query("rolling_corr_matrix", statement("SELECT ticker_a, ticker_b, date, round(corr, 5) + 0.0 AS corr FROM rolls WHERE corr IS NOT NULL"), 5)(lambda s, d: P.rolling(return_legs(s, d), 60))
query("rolling_corr_spearman", statement(f"SELECT {K}, date, round(c, 5) + 0.0 AS corr FROM (SELECT {K}, date, count(*) OVER w AS n, corr(a, rb) OVER w AS c FROM (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY b) + (count(*) OVER (PARTITION BY {K}, b) - 1) / 2.0 AS rb FROM rlegs) WINDOW w AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE n = 60"), 5)(lambda s, d: P.rolling(return_legs(s, d), 60, "spearman"))
query("corr_stability", statement(f"SELECT {K}, round(avg(corr), 6) + 0.0 AS mean, round(stddev_samp(corr), 6) AS std, round(min(corr), 6) + 0.0 AS low, round(max(corr), 6) + 0.0 AS high, round(avg(CAST(corr > 0 AS DOUBLE)), 6) AS share_positive, round(avg(CAST(abs(corr) >= 0.2 AS DOUBLE)), 6) AS share_above FROM rolls WHERE corr IS NOT NULL GROUP BY 1, 2"))(lambda s, d: P.stability(P.rolling(return_legs(s, d), 60), 0.2))

# The same over every pair of tickers
_ALL = "(SELECT x.ticker AS ticker_a, y.ticker AS ticker_b, x.date, x.ret AS a, y.ret AS b FROM rets x JOIN rets y ON x.date = y.date AND x.ticker < y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)"


def all_legs(s, d):
    return P.legs(rets(s, d), P.across(src.universe(s, d)), "ret")


query("corr_matrix", statement(f"SELECT {K}, round(corr(a, b), 6) + 0.0 AS correlation, count(*) AS n FROM {_ALL} GROUP BY 1, 2"))(lambda s, d: P.correlation(all_legs(s, d)))
query("corr_matrix_spearman", statement(f"SELECT {K}, round(corr(ra, rb), 6) + 0.0 AS correlation, count(*) AS n FROM ({_RANKS.replace('FROM rlegs', 'FROM ' + _ALL)}) GROUP BY 1, 2"))(lambda s, d: P.correlation(all_legs(s, d), "spearman"))
query("corr_matrix_high", statement(f"SELECT {K}, round(c, 6) + 0.0 AS correlation, n FROM (SELECT {K}, corr(a, b) AS c, count(*) AS n FROM {_ALL} GROUP BY 1, 2) WHERE abs(c) >= 0.05"))(lambda s, d: P.high(P.correlation(all_legs(s, d)), 0.05))
query("rolling_corr_all", statement(f"SELECT {K}, date, round(c, 5) + 0.0 AS corr FROM (SELECT {K}, date, count(*) OVER w AS n, corr(a, b) OVER w AS c FROM {_ALL} WINDOW w AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE n = 60"), 5)(lambda s, d: P.rolling(all_legs(s, d), 60))

# Spreads
query("ols_spread", rounded("spr", f"{K}, date", "hedge_ratio intercept spread"))(lambda s, d: S.ols(log_legs(s, d)).select(*PAIR, "date", "hedge_ratio", "intercept", "spread"))
query("rolling_ols_spread", statement(f"SELECT {K}, date, round(h, 5) + 0.0 AS hedge_ratio, round(a - h * b, 4) + 0.0 AS spread FROM (SELECT *, CASE WHEN count(a) OVER w = 60 THEN regr_slope(a, b) OVER w END AS h FROM llegs WINDOW w AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE h IS NOT NULL"), 5)(
    lambda s, d: S.rolling_ols(log_legs(s, d)).filter("hedge_ratio IS NOT NULL").select(*PAIR, "date", "hedge_ratio", F.round("spread", 4).alias("spread"))
)
query("spread_zscore", rounded("zed", f"{K}, date", "zscore", 5), 5)(lambda s, d: zscored(s, d).select(*PAIR, "date", "zscore"))
query("half_life", statement(f"SELECT {K}, round(CASE WHEN s >= 0 THEN CAST('Infinity' AS DOUBLE) ELSE -ln(2) / s END, 4) AS half_life FROM ouf"), 4)(lambda s, d: S.half_life(S.ols(log_legs(s, d))))
query("half_life_screen", statement(f"SELECT {K}, round(-ln(2) / s, 4) AS half_life FROM ouf WHERE s < 0 AND -ln(2) / s BETWEEN 5 AND 60"), 4)(lambda s, d: S.half_life(S.ols(log_legs(s, d))).filter(F.col("half_life").between(5, 60)))
query("ou_params", statement(f"SELECT {K}, round(-s, 6) AS kappa, round(i / nullif(-s, 0), 5) + 0.0 AS mu, round(sqrt(greatest(0, (syy - s * sxy) / (n - 1))), 6) AS sigma, round(CASE WHEN s < 0 THEN -ln(2) / s ELSE CAST('Infinity' AS DOUBLE) END, 4) AS half_life FROM ouf"))(
    lambda s, d: S.ou(S.ols(log_legs(s, d))).withColumns({"mu": F.round("mu", 5), "half_life": F.round("half_life", 4)})
)
query("hurst", statement(f"""SELECT {K}, round(regr_slope(ln(rs), ln(lag)), 5) AS hurst FROM (SELECT {K}, lag, avg(rs) AS rs FROM (
  SELECT {K}, lag, chunk, (max(walk) - min(walk)) / max(sd) AS rs FROM (SELECT {K}, lag, chunk, sd, sum(spread - m) OVER (PARTITION BY {K}, lag, chunk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS walk FROM (
    SELECT {K}, lag, pos // lag AS chunk, pos, spread, avg(spread) OVER (PARTITION BY {K}, lag, pos // lag) AS m, stddev_pop(spread) OVER (PARTITION BY {K}, lag, pos // lag) AS sd, n
    FROM (SELECT {K}, spread, row_number() OVER (PARTITION BY {K} ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY {K}) AS n FROM spr) CROSS JOIN (SELECT unnest(generate_series(2, 99)) AS lag)
    WHERE lag < n // 2 AND pos < ((n - lag + lag - 1) // lag) * lag) WHERE sd > 1e-12) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2""".replace("GROUP BY 1, 2, 3, 4)", "GROUP BY ticker_a, ticker_b, lag, chunk)").replace("GROUP BY 1, 2, 3)", "GROUP BY ticker_a, ticker_b, lag)")), 5)(lambda s, d: S.hurst(S.ols(log_legs(s, d))))
query("zero_crossings", statement(f"SELECT {K}, CAST(coalesce(sum(CAST(p * zscore < 0 AS INTEGER)), 0) AS BIGINT) AS n_crossings FROM (SELECT *, lag(zscore) OVER (PARTITION BY {K} ORDER BY date) AS p FROM zed WHERE zscore IS NOT NULL) GROUP BY 1, 2"))(lambda s, d: P.crossings(zscored(s, d)))
query("kalman_spread", statement(f"SELECT k.ticker_a, k.ticker_b, l.date, round(m1, 5) + 0.0 AS hedge_ratio, round(m2, 5) + 0.0 AS intercept, round(l.a - m1 * l.b - m2, 5) + 0.0 AS spread FROM kal k JOIN lr l ON l.ticker_a = k.ticker_a AND l.ticker_b = k.ticker_b AND l.rn = k.rn"), 5)(
    lambda s, d: S.kalman(log_legs(s, d)).select(*PAIR, "date", "hedge_ratio", "intercept", "spread")
)
query("characterise")(lambda s, d: S.characterise(log_legs(s, d)))
query("coint_battery")(lambda s, d: S.cointegration(log_legs(s, d)))
query("coint_by_pvalue")(lambda s, d: S.cointegration(log_legs(s, d)).orderBy("eg_pvalue", *PAIR))

# Signals, execution, risk
query("signals_state_machine", statement(f"SELECT {K}, date, CAST(signal AS INTEGER) AS signal, CAST(position AS INTEGER) AS position, CAST(holding_days AS INTEGER) AS holding_days, round(spread, 5) + 0.0 AS spread, round(zscore, 5) + 0.0 AS zscore, round(hedge_ratio, 5) + 0.0 AS hedge_ratio FROM sig"), 5)(lambda s, d: T.generate(legs(s, d)))
query("signals_kalman")(lambda s, d: T.generate(legs(s, d), "kalman"))
query("signals_summary", statement(f"SELECT {K}, round(avg(CAST(position = 1 AS DOUBLE)), 6) AS pct_long, round(avg(CAST(position = -1 AS DOUBLE)), 6) AS pct_short, round(avg(CAST(position = 0 AS DOUBLE)), 6) AS pct_flat, count(*) FILTER (signal <> 0) AS n_entries, round(coalesce(avg(holding_days) FILTER (position <> 0), 0), 6) AS avg_holding FROM sig GROUP BY 1, 2"))(lambda s, d: T.signal_summary(T.generate(legs(s, d))))


def profits(s, d):
    return T.pnl(T.generate(legs(s, d)), legs(s, d), CFG.trade, 1.0 / 50)


query("pair_pnl", statement(f"SELECT {K}, date, CAST(position AS INTEGER) AS position, round(gross_return, 6) + 0.0 AS gross_return, round(costs, 6) AS costs, round(net_pnl, 4) + 0.0 AS net_pnl, round(2000 + sum(net_pnl) OVER (PARTITION BY {K} ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS portfolio_value FROM pnl"))(
    lambda s, d: profits(s, d).select(*PAIR, "date", "position", "gross_return", "costs", F.round("net_pnl", 4).alias("net_pnl"), F.round("portfolio_value", 4).alias("portfolio_value"))
)
_FOLIO = "SELECT date, round(g, 6) + 0.0 AS gross_return, round(n, 6) + 0.0 AS net_return, round(100000 * product(1 + n) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 3) AS portfolio_value FROM (SELECT date, sum({w} * gross_return) AS g, sum({w} * net_return) AS n FROM pnl JOIN wts USING (ticker_a, ticker_b) GROUP BY 1)"


def folio(s, d, method):
    return T.portfolio(profits(s, d), method).select("date", "gross_return", "net_return", F.round("portfolio_value", 3).alias("portfolio_value"))


query("portfolio_equal", statement(_FOLIO.format(w="we")))(lambda s, d: folio(s, d, "equal"))
query("portfolio_inverse_vol", statement(_FOLIO.format(w="wi")))(lambda s, d: folio(s, d, "inverse_vol"))
query("size_fixed", statement(f"SELECT {K}, least(1.0 / 50, 0.25) * 100000.0 AS size FROM pairs"))(lambda s, d: P.within_groups(src.universe(s, d)).withColumn("size", T.size_fixed(50, 100_000.0)))
query("size_vol_target", statement("SELECT ticker, round(CASE WHEN vol > 0 THEN least(0.01 / vol, 0.25) ELSE 0.25 END * 100000, 4) AS size FROM (SELECT ticker, stddev_samp(ret) AS vol FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM rets) WHERE rn <= 21 GROUP BY 1)"), 4)(
    lambda s, d: T.recent_vol(rets(s, d).withColumn("net_return", F.col("ret")), 21, "ticker").select("ticker", T.size_vol_target(F.col("vol"), 100_000.0).alias("size"))
)
query("size_kelly", statement(f"SELECT {K}, round(coalesce(CASE WHEN w <> 0 AND l <> 0 THEN least(greatest(p / abs(l) - (1 - p) / w, 0) * 0.5, 0.25) END, 0) * 100000, 4) AS size FROM (SELECT {K}, avg(CAST(pnl > 0 AS DOUBLE)) AS p, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS w, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS l FROM trd GROUP BY 1, 2)"), 4)(
    lambda s, d: M.trade_report(toy_positions(s, d), *PAIR).select(*PAIR, T.size_kelly(F.col("win_rate"), F.col("avg_win"), F.col("avg_loss"), 100_000.0).alias("size"))
)
query("drawdown_halt", statement(f"SELECT {K}, date, CASE WHEN date >= halt THEN 0 ELSE position END AS position FROM toyp CROSS JOIN (SELECT min(date) FILTER (drawdown < -0.02) AS halt FROM dd)"))(
    lambda s, d: T.halt(curve(s, d), toy_positions(s, d).withColumn("signal", F.col("position")), 0.02).select(*PAIR, "date", "position")
)
query("pair_stop_loss", statement(f"SELECT ticker_a, ticker_b, date, CASE WHEN date >= halt THEN 0 ELSE position END AS position FROM toyp LEFT JOIN (SELECT {K}, min(date) FILTER (t < -100) AS halt FROM (SELECT *, sum(net_pnl) OVER (PARTITION BY {K} ORDER BY date ROWS UNBOUNDED PRECEDING) AS t FROM toyp) GROUP BY 1, 2) USING (ticker_a, ticker_b)"))(
    lambda s, d: T.stop_loss(toy_positions(s, d).withColumn("signal", F.col("position")), toy_positions(s, d).withColumn("capital", F.lit(2000.0)), 0.05).select(*PAIR, "date", "position")
)

# Metrics
PERF = "total_return cagr annual_vol daily_mean daily_std skewness kurtosis best_day worst_day max_drawdown avg_drawdown sharpe sortino calmar omega var_95 cvar_95 var_99 cvar_99"
query("perf_report", rounded("perf", "drawdown_days, recovery_days", PERF, 5), 5)(lambda s, d: M.report(curve(s, d)).withColumn("recovery_days", F.col("recovery_days").cast("long")))
query("trade_metrics", statement(f"""SELECT {K}, n_trades, round(win_rate, 6) AS win_rate, round(CASE WHEN lost = 0 THEN CAST('Infinity' AS DOUBLE) ELSE won / lost END, 4) AS profit_factor, round(w, 4) AS avg_win, round(l, 4) + 0.0 AS avg_loss, round(e, 4) + 0.0 AS avg_trade_pnl, round(e, 4) + 0.0 AS expectancy, max_wins, max_losses, round(won, 4) AS gross_profit
  FROM (SELECT {K}, count(*) AS n_trades, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won, coalesce(sum(-pnl) FILTER (pnl <= 0), 0) AS lost, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS w, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS l, avg(pnl) AS e FROM trd GROUP BY 1, 2)
  JOIN (SELECT {K}, coalesce(max(len) FILTER (win), 0) AS max_wins, coalesce(max(len) FILTER (NOT win), 0) AS max_losses FROM runs GROUP BY 1, 2) USING (ticker_a, ticker_b)"""))(
    lambda s, d: M.trade_report(toy_positions(s, d), *PAIR).withColumns({c: F.round(c, 4) for c in ("profit_factor", "avg_win", "avg_loss", "avg_trade_pnl", "expectancy", "gross_profit")})
)
query("rolling_sharpe", statement("SELECT date, round(CASE WHEN count(net_return) OVER w = 63 THEN (avg(net_return) OVER w - 0.05 / 252) / nullif(stddev_samp(net_return) OVER w, 0) * sqrt(252) END, 5) + 0.0 AS rolling_sharpe FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"), 5)(lambda s, d: M.rolling_sharpe(daily(s, d)).select("date", "rolling_sharpe"))
query("rolling_volatility", statement("SELECT date, round(CASE WHEN count(net_return) OVER w = 21 THEN stddev_samp(net_return) OVER w * sqrt(252) END, 6) AS rolling_vol FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"))(lambda s, d: M.rolling_volatility(daily(s, d)).select("date", "rolling_vol"))
query("drawdown_series", rounded("dd", "date", "portfolio_value peak drawdown", 5), 5)(lambda s, d: T.drawdown(curve(s, d)).select("date", "portfolio_value", "peak", "drawdown"))
query("risk_report", statement("SELECT round(sharpe, 5) + 0.0 AS sharpe, round(sortino, 5) + 0.0 AS sortino, round(CASE WHEN max_drawdown <> 0 THEN daily_mean * 252 / abs(max_drawdown) ELSE 0 END, 5) + 0.0 AS calmar, round(max_drawdown, 5) + 0.0 AS max_drawdown, round(daily_mean * 252, 5) + 0.0 AS annual_return, round(annual_vol, 5) AS annual_vol, round(t, 5) + 0.0 AS total_return FROM perf CROSS JOIN (SELECT arg_max(portfolio_value, date) / arg_min(portfolio_value, date) - 1 AS t FROM curve)"), 5)(lambda s, d: M.risk_report(curve(s, d)))

# Benchmarks
query("bench_buy_hold", statement("SELECT strategy, date, round(net_return, 6) + 0.0 AS net_return FROM bench WHERE strategy = 'buy_hold_NATION_0'"))(lambda s, d: B.buy_and_hold(src.index_panel(s, d), EQUITY))
query("bench_momentum", statement("SELECT 'momentum' AS strategy, date, round(net_return, 6) + 0.0 AS net_return FROM momd"))(lambda s, d: B.momentum(src.index_panel(s, d)))
query("bench_mean_reversion", statement("SELECT strategy, date, round(net_return, 6) + 0.0 AS net_return FROM bench WHERE strategy = 'mean_reversion'"))(lambda s, d: B.mean_reversion(src.index_panel(s, d), EQUITY))
query("bench_60_40", statement("SELECT strategy, date, round(net_return, 6) + 0.0 AS net_return FROM bench WHERE strategy = 'balanced_60_40'"))(lambda s, d: B.balanced(src.index_panel(s, d), EQUITY, BOND))
query("bench_table", rounded("benchm", "strategy", "total_return cagr annual_vol sharpe sortino calmar max_drawdown var_95 omega", 4), 4)(lambda s, d: B.comparison(B.run_all(src.index_panel(s, d), EQUITY, SECOND, BOND)))

# Features, learning, ranking
_SHARE = "round(avg(CAST(abs(corr) >= 0.7 AS DOUBLE)), 5) AS rolling_corr_pct_above_07"
query("pair_features", statement(f"""SELECT * FROM (SELECT {K}, count(*) AS days_of_data, round(stddev_samp(a) / nullif(stddev_samp(b), 0), 5) AS vol_ratio, round(avg(exp(a - b)), 5) AS price_ratio_mean, round(stddev_samp(exp(a - b)), 5) AS price_ratio_std, round(stddev_samp(zscore), 5) AS zscore_std FROM zed GROUP BY 1, 2)
  JOIN (SELECT {K}, CAST(coalesce(sum(CAST(p * zscore < 0 AS INTEGER)), 0) AS BIGINT) AS n_crossings FROM (SELECT *, lag(zscore) OVER (PARTITION BY {K} ORDER BY date) AS p FROM zed WHERE zscore IS NOT NULL) GROUP BY 1, 2) USING (ticker_a, ticker_b)
  JOIN (SELECT {K}, round(-s, 5) + 0.0 AS ou_kappa, round(sqrt(greatest(0, (syy - s * sxy) / (n - 1))), 5) AS ou_sigma FROM ouf) USING (ticker_a, ticker_b)
  JOIN (SELECT {K}, round(avg(corr), 5) + 0.0 AS rolling_corr_mean, round(stddev_samp(corr), 5) AS rolling_corr_std, {_SHARE} FROM lroll GROUP BY 1, 2) USING (ticker_a, ticker_b)""".replace("FROM lroll", f"FROM (SELECT {K}, CASE WHEN count(a) OVER w = 60 THEN corr(a, b) OVER w END AS corr FROM llegs WINDOW w AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE corr IS NOT NULL")), 5)(
    lambda s, d: R.extras(log_legs(s, d))
)
query("half_life_norm", statement(f"SELECT {K}, round((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER () + 1e-9), 5) + 0.0 AS half_life_norm FROM (SELECT {K}, CASE WHEN s < 0 THEN -ln(2) / s END AS h FROM ouf)"), 5)(lambda s, d: R.half_life_norm(S.half_life(S.ols(log_legs(s, d)))).select(*PAIR, "half_life_norm"))


def table(s, d):
    rows = log_legs(s, d)
    return R.features(S.cointegration(rows, 0.3, 0.3, (2, 200)), rows)


query("feature_table")(table)
query("feature_matrix")(lambda s, d: R.feature_matrix(table(s, d)))


def learned(s, d):
    m = R.feature_matrix(table(s, d)).cache()
    return R.pipeline().fit(m), m


query("ml_scores")(lambda s, d: R.score(learned(s, d)[0], table(s, d), R.FEATURES))
query("ml_search_scores")(lambda s, d: R.score(R.search(R.feature_matrix(table(s, d)).cache(), R.FEATURES), table(s, d), R.FEATURES))
query("ml_cv")(lambda s, d: R.cross_validate(R.feature_matrix(table(s, d)), R.FEATURES))
query("ml_importance")(lambda s, d: R.importance(learned(s, d)[0], R.FEATURES, s))
query("lstm_sequences", statement(f"SELECT {K}, date, CAST(n AS INTEGER) AS steps, round(total, 5) + 0.0 AS total, label FROM (SELECT {K}, date, count(*) OVER w AS n, sum(CAST(CAST(zscore AS FLOAT) AS DOUBLE)) OVER w AS total, CAST(spread > 0 AS INTEGER) AS label FROM zed WHERE zscore IS NOT NULL WINDOW w AS (PARTITION BY {K} ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE n = 10"), 5)(
    lambda s, d: R.sequences(zscored(s, d).filter("zscore IS NOT NULL").withColumn("label", (F.col("spread") > 0).cast("int")).withColumn("zr", F.col("zscore")), ["zscore"], 10).select(
        *PAIR, "date", F.size("sequence").alias("steps"), F.aggregate("sequence", F.lit(0.0), lambda t, x: t + x[0].cast("double")).alias("total"), "label")
    .withColumn("total", F.round("total", 5))
)
_RANKIN = f"SELECT {K}, round(abs(corr(a, b)), 6) AS eg_pvalue FROM rlegs GROUP BY 1, 2"


def rank_input(s, d):
    """Stand-in p-values that SQL can compute, for the ranking alone."""
    c = P.correlation(return_legs(s, d)).select(*PAIR, F.round(F.abs("correlation"), 6).alias("eg_pvalue"))
    h = S.half_life(S.ols(log_legs(s, d))).withColumn("half_life", F.round("half_life", 4))
    return c.join(h, [*PAIR]).withColumn("adf_pvalue", F.col("eg_pvalue") * 0.5).withColumn("is_cointegrated", F.col("eg_pvalue") <= 0.08)


_STAT = f"""SELECT {K}, eg_pvalue, half_life, 0.4 * (1 - CASE WHEN max(eg_pvalue) OVER () = min(eg_pvalue) OVER () THEN 0 ELSE (eg_pvalue - min(eg_pvalue) OVER ()) / (max(eg_pvalue) OVER () - min(eg_pvalue) OVER ()) END)
  + 0.3 * (1 - CASE WHEN max(adf) OVER () = min(adf) OVER () THEN 0 ELSE (adf - min(adf) OVER ()) / (max(adf) OVER () - min(adf) OVER ()) END) + 0.3 * least(greatest(1 - abs(half_life - 32.5) / 32.5, 0), 1) AS stat_score
  FROM (SELECT {K}, eg_pvalue, eg_pvalue * 0.5 AS adf, round(CASE WHEN s >= 0 THEN CAST('Infinity' AS DOUBLE) ELSE -ln(2) / s END, 4) AS half_life FROM ({_RANKIN}) JOIN ouf USING (ticker_a, ticker_b)) WHERE eg_pvalue <= 0.08 AND half_life BETWEEN 5 AND 60"""
query("stat_score", statement(f"SELECT {K}, round(stat_score, 9) AS stat_score FROM ({_STAT})"), 9)(lambda s, d: R.stat_score(rank_input(s, d).filter(F.col("is_cointegrated") & F.col("half_life").between(5, 60))).select(*PAIR, "stat_score"))
query("rank_pairs", statement(f"SELECT {K}, round(stat_score, 9) AS stat_score, 0.5 AS ml_score, round(0.5 * stat_score + 0.25, 9) AS composite FROM ({_STAT}) ORDER BY round(0.5 * stat_score + 0.25, 9) DESC, ticker_a, ticker_b LIMIT 10").replace("0.5 AS ml_score", "CAST(0.5 AS DOUBLE) AS ml_score"), 9)(lambda s, d: R.rank(rank_input(s, d), top=10).select(*PAIR, "stat_score", "ml_score", "composite"))

# Simulation
SIM = CFG.simulation


def simulated(s, d, method):
    """All paths and steps of the default simulation."""
    more = {"block": SIM.block} if method == "bootstrap" else {}
    return X.simulate(daily(s, d), method, paths=SIM.paths, horizon=SIM.horizon, start=CFG.trade.capital, seed=SIM.seed, **more)


for _method in ("gbm", "bootstrap"):
    query(f"mc_{_method}")(lambda s, d, m=_method: simulated(s, d, m))
    query(f"mc_{_method}_terminal")(lambda s, d, m=_method: X.terminal(simulated(s, d, m), SIM.horizon, CFG.trade.capital, SIM.confidence))
    query(f"mc_{_method}_drawdown")(lambda s, d, m=_method: X.path_drawdown(simulated(s, d, m)))
    query(f"mc_{_method}_bands")(lambda s, d, m=_method: X.bands(simulated(s, d, m)))
# The same operators over paths that SQL can make too
query("mc_terminal", statement("""SELECT round(avg(value), 3) AS mean_terminal, round(median(value), 3) AS median_terminal, round(stddev_pop(value), 3) AS std_terminal, round(avg(r), 3) AS mean_return, round(median(r), 3) AS median_return, round(avg(CAST(r > 0 AS DOUBLE)), 3) AS prob_profit,
  round(avg(CAST(r < -0.1 AS DOUBLE)), 3) AS prob_loss_10, round(avg(CAST(r < -0.2 AS DOUBLE)), 3) AS prob_loss_20, round(avg(CAST(r < -0.5 AS DOUBLE)), 3) AS prob_loss_50, round(max(a), 3) AS var_95, round(avg(r) FILTER (r <= a), 3) AS cvar_95, round(max(c), 3) AS pct_5_terminal, round(max(d), 3) AS pct_95_terminal,
  round(max(b), 3) AS var_99, round(avg(r) FILTER (r <= b), 3) AS cvar_99, round(max(e), 3) AS pct_1_terminal, round(max(f), 3) AS pct_99_terminal
  FROM (SELECT value, value / 100000 - 1 AS r FROM paths WHERE step = 63) CROSS JOIN (SELECT quantile_cont(value / 100000 - 1, 0.05) AS a, quantile_cont(value / 100000 - 1, 0.01) AS b, quantile_cont(value, 0.05) AS c, quantile_cont(value, 0.95) AS d, quantile_cont(value, 0.01) AS e, quantile_cont(value, 0.99) AS f FROM paths WHERE step = 63)"""), 3)(lambda s, d: X.terminal(toy_paths(s), 63, 100_000.0))
query("mc_drawdown", statement("SELECT round(avg(m), 5) AS mean_max_dd, round(median(m), 5) AS median_max_dd, round(min(m), 5) AS worst_dd, round(quantile_cont(m, 0.05), 5) AS pct_5_dd FROM (SELECT path_id, min(dd) AS m FROM (SELECT path_id, value / max(value) OVER (PARTITION BY path_id ORDER BY step ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM paths) GROUP BY 1)"), 5)(lambda s, d: X.path_drawdown(toy_paths(s)))
query("mc_bands", statement("SELECT step, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 3) AS p{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + " FROM paths GROUP BY 1"), 3)(lambda s, d: X.bands(toy_paths(s)))
for _name, _make in {"baseline": X.baseline, "vol_shock": X.vol_shock, "liquidity": X.liquidity, "bear": X.bear}.items():
    _label = {"baseline": "baseline", "vol_shock": "vol_shock_3x", "liquidity": "liquidity_crisis", "bear": "bear_regime"}[_name]
    query(f"scenario_{_name}", statement(f"SELECT scenario, date, round(net_return, 8) + 0.0 AS net_return FROM scen WHERE scenario = '{_label}'"), 8)(lambda s, d, f=_make: f(daily(s, d)))
query("scenario_corr_breakdown")(lambda s, d: X.corr_breakdown(daily(s, d)))
query("scenario_fat_tail")(lambda s, d: X.fat_tail(daily(s, d)))
query("scenario_table", rounded("scenm", "scenario", "total_return max_drawdown sharpe", 5), 5)(lambda s, d: X.summary(X.run_all(daily(s, d)).filter(~F.col("scenario").isin("corr_breakdown", "fat_tail"))))
query("scenario_text", statement("SELECT scenario, printf('%.1f%%', round(total_return * 100, 9)) AS total_return, printf('%.1f%%', round(max_drawdown * 100, 9)) AS max_drawdown, printf('%.2f', round(sharpe, 9)) AS sharpe FROM scenm"))(
    lambda s, d: X.formatted(X.summary(X.run_all(daily(s, d)).filter(~F.col("scenario").isin("corr_breakdown", "fat_tail"))))
)
query("scenario_table_all")(lambda s, d: X.summary(X.run_all(daily(s, d))))
query("scenario_text_all")(lambda s, d: X.formatted(X.summary(X.run_all(daily(s, d)))))

# Walk-forward, backtest, dashboard tables
query("walk_forward", statement("SELECT ticker, date, close FROM prices WHERE date > DATE '1996-01-01'"))(lambda s, d: src.index_panel(s, d).filter(F.col("date") > F.lit("1996-01-01").cast("date")).select("ticker", "date", "close"))
query("backtest_kalman")(lambda s, d: T.backtest(src.index_panel(s, d), P.within_groups(src.universe(s, d)))["portfolio"])
_HIST = "SELECT CAST(least(floor((value - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM paths CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM paths WHERE step = 63) WHERE step = 63 GROUP BY 1"


@query("dash_histogram", statement(_HIST))
def _(s, d):
    end = toy_paths(s).filter("step = 63")
    b = end.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100), F.lit(99)).cast("int")
    return end.crossJoin(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


query("dash_sector_counts", statement("SELECT grp, count(*) AS n FROM uni GROUP BY 1"))(lambda s, d: src.universe(s, d).groupBy("grp").agg(F.count("*").alias("n")))
query("dash_summary_stats", statement("SELECT ticker, count(close) AS n, round(avg(close), 5) AS mean, round(stddev_samp(close), 5) AS std, round(min(close), 5) AS low, round(max(close), 5) AS high FROM prices GROUP BY 1"), 5)(lambda s, d: C.describe(src.index_panel(s, d), "close", "ticker"))
query("dash_pass_rate", statement("SELECT count(*) AS tested, count(*) FILTER (s < 0 AND -ln(2) / s BETWEEN 5 AND 60) AS passed, round(avg(CAST(s < 0 AND -ln(2) / s BETWEEN 5 AND 60 AS DOUBLE)), 6) AS rate FROM ouf"))(
    lambda s, d: S.half_life(S.ols(log_legs(s, d))).agg(F.count("*").alias("tested"), F.count_if(F.col("half_life").between(5, 60)).alias("passed"), F.avg(F.col("half_life").between(5, 60).cast("double")).alias("rate"))
)
query("dash_scatter", statement(f"SELECT {K}, round(-ln(2) / s, 4) AS half_life, round(c, 5) + 0.0 AS correlation FROM ouf JOIN (SELECT {K}, corr(a, b) AS c FROM rlegs GROUP BY 1, 2) USING (ticker_a, ticker_b) WHERE s < 0 AND -ln(2) / s BETWEEN 0 AND 120"), 5)(
    lambda s, d: S.half_life(S.ols(log_legs(s, d))).filter(F.col("half_life").between(0, 120)).withColumn("half_life", F.round("half_life", 4)).join(P.correlation(return_legs(s, d)).select(*PAIR, "correlation"), [*PAIR])
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-group pairs, spreads, signals, profits and the equal-weight portfolio's Sharpe ratio and drawdown."""
    days = T.portfolio(profits(spark, sf_dir)).select("date", "net_return", "portfolio_value")
    return M.report(days).select("total_return", "sharpe", "max_drawdown", "annual_vol")
