"""Queries against DuckDB over the smallest tables, and edge cases of the operators."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHECKED = ["panel_index", "fill_time_interp", "returns_winsorised", "corr_spearman", "hurst", "kalman_spread", "signals_state_machine", "portfolio_equal", "perf_report", "trade_metrics", "bench_table", "mc_terminal", "rank_pairs"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert x == y or isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-5)


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_metrics_of_a_flat_series(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import metrics

    flat = spark.range(30).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(0.0).alias("net_return"))
    r = metrics.report(metrics.curve(flat, start=100.0)).first()
    assert r.sharpe == 0 and r.max_drawdown == 0 and r.recovery_days == 0 and r.calmar == 0


def test_empty_inputs_stay_typed(spark):
    from pairloom.operators import pairs, spread

    rows = spark.createDataFrame([], "ticker_a string, ticker_b string, date date, a double, b double")
    assert pairs.high(pairs.correlation(rows)).columns == ["ticker_a", "ticker_b", "correlation", "n"]
    assert spread.cointegration(rows).count() == 0 and spread.half_life(spread.ols(rows)).count() == 0


def test_short_or_constant_pairs_do_not_pass(spark):
    import datetime as dt

    from pairloom.operators import spread

    day = dt.date(2020, 1, 1)
    rows = [("x", "y", day + dt.timedelta(i), float(i % 7), float(i % 5)) for i in range(59)] + [("x", "z", day + dt.timedelta(i), 1.0, 1.0) for i in range(60)]
    got = {r.ticker_b: r for r in spread.cointegration(spark.createDataFrame(rows, "ticker_a string, ticker_b string, date date, a double, b double")).collect()}
    assert got["y"].n == 59 and got["y"].eg_pvalue is None and not got["y"].is_cointegrated and not got["z"].is_cointegrated


def test_bootstrap_needs_history(spark):
    from pairloom.operators import simulation

    short = spark.createDataFrame([], "date date, net_return double")
    with pytest.raises(ValueError):
        simulation.bootstrap(short, 10, 10)


def test_scenario_tables_have_all_seven_rows(spark):
    q = __spark_entry__.queries()
    every = {r.scenario: r for r in q["scenario_table_all"](spark, SF).collect()}
    assert set(every) == {"baseline", "vol_shock_3x", "vol_shock_5x", "corr_breakdown", "liquidity_crisis", "fat_tail", "bear_regime"}
    assert every["corr_breakdown"].total_return < every["baseline"].total_return and every["fat_tail"] != every["baseline"]
    text = {r.scenario: r for r in q["scenario_text_all"](spark, SF).collect()}
    assert {k: f"{v.total_return * 100:.1f}%" for k, v in every.items()} == {k: v.total_return for k, v in text.items()}
    assert {r.scenario: r.sharpe for r in q["scenario_table"](spark, SF).collect()} == {k: pytest.approx(every[k].sharpe, abs=1e-5) for k in every if k not in ("corr_breakdown", "fat_tail")}


@pytest.mark.parametrize("method", ["gbm", "bootstrap"])
def test_simulations_have_all_paths_and_steps(spark, method):
    from pyspark.sql import functions as F

    q = __spark_entry__.queries()
    r = q[f"mc_{method}"](spark, SF).agg(F.count("*").alias("n"), F.countDistinct("path_id").alias("paths"), F.max("step").alias("last"), F.avg(F.when(F.col("step") == 252, F.col("value"))).alias("mean")).first()
    assert (r.n, r.paths, r["last"]) == (10_000 * 253, 10_000, 252)
    assert q[f"mc_{method}_terminal"](spark, SF).first().mean_terminal == pytest.approx(r["mean"], rel=1e-6)
    assert q[f"mc_{method}_bands"](spark, SF).count() == 253
    assert -1 <= q[f"mc_{method}_drawdown"](spark, SF).first().worst_dd < 0


def test_ml_queries_learn_with_the_defaults(spark, monkeypatch):
    from pairloom.plans import catalog

    given = []

    class Model:
        def fit(self, m):
            return "model"

    monkeypatch.setattr(catalog, "table", lambda s, d: spark.range(1))
    monkeypatch.setattr(catalog.R, "feature_matrix", lambda t: t)
    monkeypatch.setattr(catalog.R, "pipeline", lambda *a, **k: given.append(("pipeline", a, k)) or Model())
    for name in ("score", "importance", "cross_validate", "search"):
        monkeypatch.setattr(catalog.R, name, lambda *a, n=name, **k: given.append((n, a[0] if isinstance(a[0], str) else None, a[2:] if n == "cross_validate" else (), k)) or ("best" if n == "search" else spark.range(1)))
    for name in ("ml_scores", "ml_importance", "ml_cv", "ml_search_scores"):
        catalog.QUERIES[name](spark, SF)
    learn = ("pipeline", (), {})
    assert given == [learn, ("score", "model", (), {}), learn, ("importance", "model", (), {}), ("cross_validate", None, (), {}), ("search", None, (), {}), ("score", "best", (), {})]


def days(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "ticker string, d string, close double").withColumn("date", F.to_date("d")).drop("d")


def test_benchmarks_start_with_the_first_return(spark):
    from pairloom.operators import benchmarks

    p = days(spark, [("E", "2020-01-01", 100.0), ("E", "2020-01-02", 110.0), ("E", "2020-01-03", None), ("E", "2020-01-06", 99.0), ("B", "2020-01-01", 50.0), ("B", "2020-01-02", 55.0), ("B", "2020-01-03", 55.0), ("B", "2020-01-06", 55.0)])
    held = sorted((str(r.date), round(r.net_return, 9)) for r in benchmarks.buy_and_hold(p, "E").collect())
    assert held == [("2020-01-02", 0.1), ("2020-01-06", -0.1)]
    mixed = sorted((str(r.date), round(r.net_return, 9)) for r in benchmarks.balanced(p, "E", "B").collect())
    assert mixed == [("2020-01-02", 0.1)]  # 0.6 * 0.1 + 0.4 * 0.1; the other days lack an equity return


def test_a_missing_term_leaves_no_statistical_score(spark):
    from pairloom.operators import ranking

    rows = [("a", "b", 0.0, 0.0, 32.5), ("a", "c", 0.1, 0.2, 32.5), ("a", "d", None, 0.1, 32.5), ("a", "e", 0.1, 0.1, None), ("a", "f", 0.1, 0.2, 100.0)]
    df = spark.createDataFrame(rows, "ticker_a string, ticker_b string, eg_pvalue double, adf_pvalue double, half_life double")
    got = {r.ticker_b: round(r.stat_score, 9) for r in ranking.stat_score(df).collect()}
    assert got == {"b": 1.0, "c": 0.3, "d": 0.0, "e": 0.0, "f": 0.0}


def test_trades_of_a_hand_made_series(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import metrics

    rows = [(1, 0, 5.0), (2, 1, 3.0), (3, 1, -1.0), (4, -1, -4.0), (5, 0, 9.0), (6, 1, 6.0)]
    df = spark.createDataFrame(rows, "n int, position int, net_pnl double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n"))).withColumn("k", F.lit("x"))
    r = metrics.trade_report(df, "k").first()
    assert (r.n_trades, round(r.win_rate, 6), r.profit_factor, r.avg_win, r.avg_loss, round(r.avg_trade_pnl, 6), r.max_wins, r.max_losses) == (3, 0.666667, 2.0, 4.0, -4.0, 1.333333, 1, 1)
    assert r.avg_trade_pnl == r.expectancy


def test_fetching_nothing_is_an_error(spark):
    from pairloom.sources import panel

    with pytest.raises(ValueError):
        panel.fetch(days(spark, [("E", "2020-01-01", 1.0)]), ["NOBODY"])
