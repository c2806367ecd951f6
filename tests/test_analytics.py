"""Hand-checked fixtures and properties of the daily-series operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import ma_windows
from tidemark.operators import arima, correlation, cycles, forecast, returns, risk
from tidemark.sources import feeds, snapshots, synthetic, tables
from tidemark.streaming.bars import daily_last_stream

D0 = dt.date(2024, 1, 1)
BARS = "symbol string, day date, price double, volume double, market_cap double"


def bars(spark, prices, symbol="X", start=D0):
    rows = [(symbol, start + dt.timedelta(days=i), None if p is None else float(p), 1.0, 1.0) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, BARS)


def test_five_prices(spark):
    b = bars(spark, [100, 110, 99, 108.9, 108.9])
    r = risk.risk_profile(b).first()
    want = {"annual_volatility": 1.8291619210264944, "var_95": 0.085, "var_99": 0.097, "cvar_95": 0.1, "max_drawdown": -0.1, "sharpe": 4.966755482697603, "sortino": 9.50019580147719}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, rel=1e-9), k
    assert r.regime == "Unknown"
    assert [round(x.drawdown, 9) for x in risk.drawdown_series(b).orderBy("day").collect()] == [0, 0, -0.1, -0.01, -0.01]
    assert risk.risk_table(b).first().var_95 == "8.50%"


@pytest.mark.parametrize("prices", [[], [5.0], [5.0, 5.0], [5.0] * 40, [0.0, 0.0, 1.0], [None, None, 3.0, 4.0]])
def test_edges_do_not_raise(spark, prices):
    b = bars(spark, prices)
    known = b.where("price is not null")
    for df in (risk.risk_profile(b), returns.densified(b), returns.price_matrix(b), cycles.phase_series(known), cycles.current_phase(known), forecast.naive_backtest(b), forecast.random_walk_forecast(b), forecast.forecast(b), forecast.forecast_path(b)):
        df.collect()


def test_flat_series(spark):
    r = risk.risk_profile(bars(spark, [7.0] * 45)).first()
    assert r.annual_volatility == 0 and r.sharpe is None and r.max_drawdown == 0 and r.var_95 == 0


def test_scale_invariance_and_isolation(spark):
    rng = np.random.default_rng(1)
    p = np.exp(np.cumsum(rng.normal(0, 0.03, 120))) * 50
    both = bars(spark, p, "A").union(bars(spark, p * 7, "B"))
    a, b = sorted(risk.risk_profile(both).collect())
    for k in ("annual_volatility", "var_95", "cvar_95", "max_drawdown"):
        assert a[k] == pytest.approx(b[k], rel=1e-9)
    assert a.cvar_95 >= a.var_95 and -1 <= a.max_drawdown <= 0
    alone = risk.risk_profile(bars(spark, p, "A")).first()
    assert alone == a
    phases = cycles.phase_series(both).select("symbol", "day", "phase")
    assert phases.where("symbol = 'A'").drop("symbol").exceptAll(phases.where("symbol = 'B'").drop("symbol")).count() == 0


def test_rsi(spark):
    got = [r.rsi for r in cycles.rsi(bars(spark, [1, 2, 1, 3, 2, 4, 3, 5, 4, 6, 5, 7, 6, 8, 7, 9])).orderBy("day").collect()]
    assert got[:14] == [None] * 14
    assert got[14:] == pytest.approx([73.91834408593743, 76.70975948580826])
    assert {r.rsi for r in cycles.rsi(bars(spark, range(1, 31))).where("rsi is not null").collect()} == {100.0}
    assert {r.rsi for r in cycles.rsi(bars(spark, [3] * 30)).where("rsi is not null").collect()} == {50.0}


def test_rsi_over_blocks_equals_recursion(spark):
    p = 100 + np.cumsum(np.random.default_rng(2).normal(0, 1, 2500))
    d = np.diff(p)
    s = pd.DataFrame({"g": np.clip(d, 0, None), "l": np.clip(-d, 0, None)}).ewm(alpha=1 / 14, adjust=False).mean()
    want = 100 - 100 / (1 + s.g / s.l)
    got = [r.rsi for r in cycles.rsi(bars(spark, p)).orderBy("day").collect()][14:]
    assert got == pytest.approx(want.to_list()[13:], rel=1e-9)


@pytest.mark.parametrize("n,pair,labelled", [(30, (5, 20), 11), (90, (7, 30), 61), (180, (15, 60), 121), (270, (22, 90), 181), (299, (24, 99), 201), (300, (50, 200), 101), (365, (50, 200), 166)])
def test_window_ladder(spark, n, pair, labelled):
    assert ma_windows(n) == pair
    rows = cycles.phase_series(bars(spark, 100 + np.sin(np.arange(n))))
    assert rows.where("phase <> 'Undetermined'").count() == labelled


def test_phase_rules(spark):
    cases = [
        (110, 105, 100, 55, -0.05, "Markup (Bull)"), (110, 105, 100, 54.9, -0.09, "Distribution"), (110, 105, 100, 54.9, -0.10, "Transition"), (110, 105, 100, 49, -0.31, "Accumulation"),
        (90, 95, 100, 45, -0.26, "Markdown (Bear)"), (90, 95, 100, 46, -0.26, "Accumulation"), (90, 95, 100, 46, -0.25, "Markdown (Bear)"), (98, 95, 100, 49, -0.31, "Accumulation"),
        (98, 95, 100, 56, -0.05, "Distribution"), (98, 95, 100, 55, -0.05, "Transition"), (98, 95, None, 55, -0.05, "Undetermined"),
    ]
    rows = spark.createDataFrame([tuple(None if x is None else float(x) for x in c[:5]) + (c[5],) for c in cases], "p double, s double, l double, r double, d double, want string")
    got = rows.withColumn("got", cycles.phase(*(F.col(c) for c in "pslrd"))).collect()
    assert [r.got for r in got] == [r.want for r in got]
    strict = rows.withColumn("got", cycles.phase(*(F.col(c) for c in "pslrd"), strict_sideways=True)).collect()
    assert strict[3].got == "Transition"


def returns_of(spark, columns):
    rows = [(a, D0 + dt.timedelta(days=i), None if v is None else float(v)) for a, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "asset string, day date, ret double")


def test_correlation_and_beta(spark):
    r = returns_of(spark, {"x": [0.01, -0.02, 0.03, -0.04, 0.05, 0], "b": [0.02, -0.01, 0.02, -0.03, 0.04, 0.01], "flat": [0.0] * 6})
    m = {(c.asset_a, c.asset_b): c["corr"] for c in correlation.correlation_matrix(r).collect()}
    assert m["x", "b"] == pytest.approx(0.9725455826494158) and m["x", "x"] == pytest.approx(1) and m["x", "b"] == pytest.approx(m["b", "x"])
    assert m["flat", "x"] is None
    s = {(c.asset_a, c.asset_b): c["corr"] for c in correlation.correlation_matrix(r, "spearman").collect()}
    assert s["x", "b"] == pytest.approx(0.9856107606091624)
    assert {c.asset: c.beta for c in correlation.beta(r, "b").collect()}["x"] == pytest.approx(1.281081081081081)
    split = correlation.regime_correlation(r, "b", ["x", "nope"]).orderBy("asset").collect()
    assert [(c.asset, c.calm, c.stressed, c.calm_days, c.stressed_days) for c in split] == [("nope", None, None, 0, 0), ("x", None, None, 0, 0)]
    with pytest.raises(ValueError):
        correlation.correlation_matrix(r, "kendall")


def test_alignment_spans_weekends_and_rates_are_differenced(spark):
    days = [dt.date(2024, 1, 4) + dt.timedelta(days=i) for i in range(6)]  # Thursday to Tuesday
    crypto = spark.createDataFrame([("C", d, 100.0 + 10 * i, 1.0, 1.0) for i, d in enumerate(days)], BARS)
    trading = [d for d in days if d.weekday() < 5]
    macro = spark.createDataFrame([("Y", d, v, True) for d, v in zip(trading, [4.0, 4.1, 4.2, 4.2])], "asset string, day date, level double, is_rate boolean")
    got = {(r.asset, r.day): r.ret for r in returns.aligned_returns(crypto, macro).collect()}
    assert len(got) == 6
    assert got["Y", trading[1]] == pytest.approx(0.10) and got["C", trading[2]] == pytest.approx(140 / 110 - 1)


@pytest.mark.parametrize("dead,last,assets", [(0, 0, 11), (1, 0, 10), (2, 0, 9), (1, 10, 10), (5, 0, 6)])
def test_dead_feeds_cost_columns_not_days(spark, dead, last, assets):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(11):
        for i in range(251):
            alive = k >= dead or i >= 251 - last
            rows.append((f"a{k}", D0 + dt.timedelta(days=i), float(100 + rng.normal()) if alive else None, False))
    levels = spark.createDataFrame(rows, "asset string, day date, level double, is_rate boolean")
    full = returns.complete_cases(returns.drop_empty_days(returns.mixed_returns(levels)))
    assert (full.select("asset").distinct().count(), full.select("day").distinct().count()) == (assets, 250)


def test_forecast_metrics(spark):
    rows = spark.createDataFrame([(100.0, 99.0), (102.0, 100.0), (101.0, 102.0)], "a double, p double")
    r = rows.agg(*forecast.errors("a", "p")).first()
    assert (r.rmse, r.mae, r.mape) == pytest.approx((math.sqrt(2), 4 / 3, 1.3169611078754937))
    assert forecast.prepared(bars(spark, range(1, 366))).first().n_test == 54
    assert forecast.prepared(bars(spark, range(1, 51))).first().n_test == 10


def test_arma_recovers_parameters():
    rng = np.random.default_rng(4)
    e = rng.normal(0, 1, 4000)
    y = np.zeros(4000)
    for i in range(1, 4000):
        y[i] = 0.6 * y[i - 1] + e[i]
    assert arima.fit(y, 1, 0)[0][0] == pytest.approx(0.6, abs=0.05)
    z = e.copy()
    z[1:] += 0.5 * e[:-1]
    assert arima.fit(z, 0, 1)[1][0] == pytest.approx(0.5, abs=0.05)
    mean, var = arima.project(y, np.zeros(0), np.zeros(0), 2.0, 5)
    assert mean.tolist() == [0] * 5 and var.tolist() == [2, 4, 6, 8, 10]
    _, var = arima.project(y, *arima.fit(y, 1, 1)[:3], 10)
    assert (np.diff(var) > 0).all()


def test_exact_likelihood_equals_dense_gaussian():
    y, phi, theta = np.random.default_rng(5).normal(0, 1, 12), np.array([0.5, -0.2]), np.array([0.4])
    psi = [1.0]
    for j in range(1, 400):
        psi.append((theta[j - 1] if j <= len(theta) else 0) + sum(phi[k] * psi[j - 1 - k] for k in range(min(2, j))))
    psi = np.array(psi)
    cov = np.array([[psi[: 400 - abs(i - j)] @ psi[abs(i - j) :] for j in range(12)] for i in range(12)])
    q = y @ np.linalg.solve(cov, y)
    want = -0.5 * (12 * (math.log(2 * math.pi * q / 12) + 1) + np.linalg.slogdet(cov)[1])
    assert arima.log_likelihood(y, phi, theta)[0] == pytest.approx(want, abs=1e-6)


def simplex(f, x, steps=400):
    """Nelder-Mead, a slow reference for the fits."""
    pts = sorted(((f(p), tuple(p)) for p in [x, *(x + 0.4 * e for e in np.eye(len(x)))]))
    for _ in range(steps):
        mid = np.mean([p for _, p in pts[:-1]], axis=0)
        at = lambda k: (f(q := mid + k * (np.array(pts[-1][1]) - mid)), tuple(q))  # noqa: E731, B023
        new = at(-1)
        if new < pts[0]:
            new = min(new, at(-2))
        elif new >= pts[-2]:
            new = min(new, at(0.5), at(-0.5))
        if new < pts[-1]:
            pts[-1] = new
        else:
            best = np.array(pts[0][1])
            pts = [pts[0], *((f(q := best + 0.5 * (np.array(p) - best)), tuple(q)) for _, p in pts[1:])]
        pts.sort()
    return pts[0][0]


@pytest.mark.parametrize("phi, theta", [((), ()), ((0.5,), ()), ((), (0.7,)), ((0.5, -0.3), (0.2,)), ((0.3,), (-0.9, 0.1)), ((1.2, -0.4), (0.5, 0.3)), ((), (-0.99999,))])
def test_filtered_likelihood_equals_the_recursion_and_its_gradient_the_differences(phi, theta):
    y, phi, theta = np.random.default_rng(7).normal(0, 1, 150), np.array(phi), np.array(theta)
    f = arima._Likelihood(y, len(phi), len(theta))
    value, slope, variance = f.at(phi, theta)
    assert (value, variance) == pytest.approx(arima.log_likelihood(y, phi, theta), abs=1e-6)
    c = np.concatenate((phi, theta))
    for k, step in enumerate(1e-6 * np.eye(len(c))):
        up, down = (f.at((c + s)[: len(phi)], (c + s)[len(phi) :])[0] for s in (step, -step))
        assert slope[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("seed", range(3))
def test_fits_reach_a_simplex_over_the_recursion(seed):
    r = np.random.default_rng(seed)
    e = r.normal(0, 0.02, 161)
    y = e[1:] - (0.9, 0.3, -0.5)[seed] * e[:-1]
    for p in range(3):
        for q in range(3):
            cost = lambda raw: -arima.log_likelihood(y / np.std(y), arima._stable(np.clip(raw[:p], -6, 6)), -arima._stable(np.clip(raw[p:], -6, 6)))[0]  # noqa: E731, B023
            least = simplex(cost, np.full(p + q, 0.1)) if p + q else cost(np.zeros(0))
            within = 1e-3 if p + q < 3 else 2  # the likelihood of more coefficients has several peaks
            assert arima.fit(y, p, q)[3] <= 2 * least + 2 * len(y) * math.log(np.std(y)) + 2 * (p + q + 1) + within


def test_starting_values_are_of_the_series():
    r = np.random.default_rng(9)
    e = r.normal(0, 1, 3001)
    y = np.zeros(3001)
    for i in range(1, 3001):
        y[i] = 0.5 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    raw = arima._regression(y, 1, 1)
    assert (arima._stable(raw[:1])[0], -arima._stable(raw[1:])[0]) == pytest.approx((0.5, 0.4), abs=0.06)
    for c in ([0.3], [0.5, -0.3], [1.2, -0.4]):
        assert arima._stable(arima._partial(np.array(c))).tolist() == pytest.approx(c)
    assert arima._partial(np.array([1.2])) is None and arima._regression(y[:8], 2, 2) is None


def test_a_forecast_reads_its_bars_once_and_days_are_filled_in_one_pass(spark, tmp_path):
    bars(spark, [1.0, 2.0, 3.0]).write.parquet(f"{tmp_path}/b")
    stored = spark.read.parquet(f"{tmp_path}/b")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    for df, n in ((returns.densified(stored), 1), (forecast.naive_backtest(stored), 1), (forecast.random_walk_forecast(stored), 1), (forecast.backtest(stored), 1), (forecast.forecast_path(stored), 1), (forecast.forecast(stored), 2)):
        assert scans(df) == n


def test_days_are_filled_up_to_the_next_price(spark):
    import datetime

    at = lambda d: datetime.date(2024, 2, d)
    rows = [("A", at(1), 1.0), ("A", at(4), 2.0), ("A", at(4), 3.0), ("A", at(6), None), ("A", at(7), 4.0), ("B", at(2), None), ("C", at(2), 5.0)]
    got = returns.densified(spark.createDataFrame(rows, "symbol string, day date, price double")).collect()
    assert sorted((r.symbol, r.day.day, r.price) for r in got if r.day != at(4) and r.day.day not in (5, 6)) == [("A", 1, 1.0), ("A", 2, 1.0), ("A", 3, 1.0), ("A", 7, 4.0), ("C", 2, 5.0)]
    assert sorted(r.price for r in got if r.day == at(4)) == [2.0, 3.0] and {r.day.day for r in got} == {1, 2, 3, 4, 5, 6, 7}


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocked_correlations_equal_pairs_of_columns(spark, blocks):
    import datetime

    import pandas as pd

    r = np.random.default_rng(11)
    x = 1e3 + np.cumsum(r.normal(0, 1, (90, 7)), axis=0)  # far from zero
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 5], x[:, 6] = 0.1, np.where(np.arange(90) < 30, 5.0, np.nan)
    x[60:, 4] = np.nan
    names = list("abcdefg")
    days = [datetime.date(1969, 11, 20) + datetime.timedelta(days=35 * i) for i in range(90)]  # several blocks of days, some before 1970
    rows = [(n, d, n in "fb", None if np.isnan(v) else float(v)) for j, n in enumerate(names) for d, v in zip(days, x[:, j])]
    df = spark.createDataFrame(rows, "asset string, day date, is_macro boolean, ret double")
    want = pd.DataFrame(x, columns=names).corr(min_periods=1)
    got = {(g.asset_a, g.asset_b): g.corr for g in correlation.correlation_matrix(df, blocks=blocks).collect()}
    assert len(got) == 49
    for (a, b), c in got.items():
        assert (c is None) == bool("f" in (a, b) or "g" in (a, b)) and (c is None or c == pytest.approx(want[a][b], abs=1e-9)), (a, b)
    block = {(g.asset_a, g.asset_b): g.corr for g in correlation.macro_block(df, blocks=blocks).collect()}
    assert set(block) == {(a, b) for a in "acdeg" for b in "fb"} and block["a", "b"] == pytest.approx(got["a", "b"], abs=0.00501)
    both = correlation.macro_block(df, ["a", "b", "nowhere"], ["b", "c"], blocks=blocks)
    assert {(g.asset_a, g.asset_b) for g in both.collect()} == {(a, b) for a in "ab" for b in "bc"}
    assert correlation.correlation_matrix(df.where("false")).count() == 0
    plan = correlation.correlation_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_random_walk_has_no_skill(spark):
    b = bars(spark, np.exp(np.cumsum(np.random.default_rng(6).normal(0, 0.02, 120))) * 10)
    head = forecast.forecast(b).first()
    assert (head.p is not None) and head.d == 1 and head.verdict
    path = forecast.forecast_path(b).orderBy("day").collect()
    assert len(path) == 30 and all(r.lower < r.point < r.upper for r in path)
    width = [math.log(r.upper / r.lower) for r in path]
    assert all(x < y for x, y in zip(width, width[1:]))


def test_ticks_and_stream(spark, tmp_path):
    t = lambda h, m=0, d=1: dt.datetime(2024, 1, d, h, m)
    rows = [("X", t(1), 1, 5.0), ("X", t(9), 2, 7.0), ("X", t(9), 3, 8.0), ("X", t(10), 4, None), ("X", t(3, d=2), 5, 9.0), ("X", t(3, d=9), 6, 1.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, id long, price double")
    got = {(r.day.day): r.price for r in tables.daily_last(ticks).collect()}
    assert got == {1: 8.0, 2: 9.0, 9: 1.0}
    ticks.write.parquet(str(tmp_path / "in"))
    stream = daily_last_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r.day.day: r.price for r in spark.sql("select * from bars_out").collect()} == {1: 8.0, 2: 9.0}


def test_payloads(spark):
    ms = lambda d, h=0: int(dt.datetime(2024, 1, d, h, tzinfo=dt.timezone.utc).timestamp() * 1000)
    chart = spark.createDataFrame([("BTC", [[float(ms(1)), 1.0], [float(ms(1, 5)), 2.0], [float(ms(2)), 3.0]], [[float(ms(1)), 10.0], [float(ms(2)), 20.0]], [[float(ms(1)), 100.0]])], feeds.CHART)
    assert [(r.day.day, r.price, r.volume, r.market_cap) for r in feeds.chart_bars(chart).collect()] == [(1, 2.0, 10.0, 100.0)]
    mood = spark.createDataFrame([([(str(ms(3) // 1000), "55", "Neutral"), ("x", "1", "y")],)], feeds.FEAR_GREED)
    assert [(r.day.day, r.fng_value, r.fng_label) for r in feeds.sentiment(mood).collect()] == [(3, 55.0, "Neutral")]
    chain = spark.createDataFrame([("tx_count", [(ms(1) // 1000, 5.0), (ms(2) // 1000, 6.0)]), ("active_addresses", [(ms(1) // 1000, 7.0)])], feeds.CHAIN)
    assert [(r.day.day, r.tx_count, r.active_addresses) for r in feeds.onchain(chain).collect()] == [(1, 5.0, 7.0)]
    closes = spark.createDataFrame([("^T", D0, 1.0), ("^T", D0 + dt.timedelta(days=1), float("nan")), ("^S", D0 + dt.timedelta(days=1), 9.0)], "ticker string, day date, level double")
    names = spark.createDataFrame([("^T", "Ten", True), ("^S", "Stocks", False)], "ticker string, asset string, is_rate boolean")
    assert {(r.asset, r.day.day, r.level) for r in feeds.macro_levels(closes, names).collect()} == {("Ten", 1, 1.0), ("Ten", 2, 1.0), ("Stocks", 2, 9.0)}


def test_client_retries_and_throttles():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = [(429, {"Retry-After": "100"}, ""), OSError("down"), (200, {}, "ok")]

    def get(url, params, headers):
        calls.append(headers)
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    client = feeds.Client(get, clock=lambda: now[0], sleep=sleep, api_key="k")
    assert client.fetch("u") == "ok" and slept[0] == 30.0 and 6.0 in slept
    assert calls[0] == {"x-cg-demo-api-key": "k"}
    answers[:] = [(500, {}, "")]
    with pytest.raises(RuntimeError):
        client.fetch("u")
    answers[:] = [OSError("down")] * 4
    with pytest.raises(OSError):
        client.fetch("u")


def test_provenance_and_snapshots(spark, tmp_path):
    good, bad = (lambda: bars(spark, [1, 2])), (lambda: (_ for _ in ()).throw(OSError("no network")))
    source = lambda df: df.first().source
    live, sample, sim = feeds.with_fallback(good, good), feeds.with_fallback(bad, good), feeds.with_fallback(good, good, simulated=True)
    assert [source(x) for x in (live, sample, sim)] == ["live", "sample", "simulated"]
    assert feeds.provenance(live.union(sample)).first().source == "mixed"
    assert feeds.provenance(sim).first().source == "simulated" and feeds.provenance(sample.union(sim)).first().source == "sample"
    now = [1000.0]
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/snap", clock=lambda: now[0])
    made = []
    produce = lambda: made.append(1) or live
    assert store.cached("k", produce).count() == 2 and store.cached("k", produce).count() == 2 and len(made) == 1
    now[0] += 7 * 3600
    store.cached("k", produce)
    assert len(made) == 2 and store.count() == 2
    store.cached("s", lambda: sample)
    assert store.count() == 2 and store.clear() == 2 and store.load("k") is None


def test_synthetic_feeds(spark):
    end = dt.date(2024, 6, 28)
    b = synthetic.crypto_bars(spark, end, 60)
    last = {r.symbol: r.price for r in b.where(F.col("day") == F.lit(end)).collect()}
    assert last["BTC"] == pytest.approx(95_000) and len(last) == 6 and b.count() == 360
    assert b.exceptAll(synthetic.crypto_bars(spark, end, 60)).count() == 0
    m = synthetic.macro_levels(spark, end, 60)
    assert m.where(F.weekday("day") > 4).count() == 0 and m.where("is_rate").select("asset").distinct().count() == 1
    assert synthetic.sentiment(spark, end, 60).where("fng_value between 5 and 95 and fng_label is not null").count() == 60
    assert synthetic.onchain(spark, end, 60).count() == 60
    equity, crypto = synthetic.factors(5000)
    assert np.corrcoef(equity, crypto)[0, 1] == pytest.approx(0.35, abs=0.05)


def test_moving_averages_of_any_length(spark):
    from tidemark.config import ma_windows

    lengths = {"a": 1, "b": 19, "c": 20, "d": 61, "e": 299, "f": 300, "g": 450}
    values = {k: [float((i * 7919) % 101) for i in range(n)] for k, n in lengths.items()}
    rows = [(k, D0 + dt.timedelta(days=i), v, 1.0, 1.0) for k, vs in values.items() for i, v in enumerate(vs)]
    got = {(r.symbol, r.day): r for r in cycles.moving_averages(spark.createDataFrame(rows, BARS)).collect()}
    assert len(got) == len(rows)
    for k, vs in values.items():
        short, long_ = ma_windows(len(vs))
        for i in range(len(vs)):
            r = got[k, D0 + dt.timedelta(days=i)]
            assert (r.ma_short, r.ma_long) == (short, long_)
            for w, x in ((short, r.sma_short), (long_, r.sma_long)):
                want = sum(vs[i - w + 1 : i + 1]) / w if i + 1 >= w else None
                assert x == pytest.approx(want) if want is not None else x is None


def test_forecaster_can_be_replaced(spark):
    def fit(y, p, q):
        if len(y) < 5:
            raise ValueError("too few values")
        return (float(np.mean(y)),), float(np.var(y)), float(p)  # the order with p = 0 wins

    drift = forecast.Forecaster(fit, lambda y, m: np.full(len(y), m[0]), lambda y, m, v, h: (m[0] * np.arange(1, h + 1), v * np.arange(1, h + 1)), ((1, 0), (0, 0)), "Drift")
    rows = bars(spark, [100 * 1.01**i for i in range(200)])
    head = forecast.forecast(rows, model=drift).first()
    assert (head.p, head.q) == (0, 0) and head.skill == pytest.approx(1) and head.verdict == "Drift(0,1,0): error 0.0% of naive"
    fan = forecast.forecast_fan(rows, model=drift).orderBy("day").collect()
    assert [r.kind for r in fan] == ["history"] * 120 + ["forecast"] * 30
    assert fan[119].value == pytest.approx(100 * 1.01**199) and fan[-1].value == pytest.approx(100 * 1.01**229) and fan[119].lower is None and fan[-1].lower <= fan[-1].value


def test_load_of_a_bundle_whose_feeds_fail(spark):
    from tidemark.sources import bundle

    sample = bars(spark, range(1, 9))
    with pytest.raises(ValueError):
        bundle.load_assets(lambda *a: sample, lambda s: sample, {})
    simulated = bundle.load_assets(lambda *a: 1 / 0, lambda s: sample.withColumn("symbol", F.lit(s)), {"a": "A", "b": "B"}, simulated=True)
    feed = (lambda: 1 / 0, lambda: sample)
    found = bundle.load_market(simulated, feed, feed, feed, simulated=True)
    assert {(r.feed, r.source) for r in found.sources.collect()} == {(f, "simulated") for f in bundle.FEEDS.values()}
    assert {r.symbol for r in found.not_live.collect()} == {"A", "B"} and found.prices.count() == 16


def test_settings_are_checked_as_a_whole():
    import dataclasses

    from tidemark import config

    good = dataclasses.asdict(config.DEFAULT)
    assert config.problems(good) == [] and config.checked(good) == config.DEFAULT and config.checked(good | {"history_days": [30]}).history_days == (30,)
    bad = {k: v for k, v in good.items() if k != "alpha"} | {"theme": 1, "vol_window": 2.5, "test_share": 1, "corr_windows": 30, "ma_short": -1, "regime_cuts": (0.6, 0.3), "risk_free": "4%"}
    found = config.problems(bad)
    assert sorted(f.split()[0] for f in found) == ["alpha", "corr_windows", "ma_short", "regime_cuts", "risk_free", "test_share", "theme", "vol_window"]
    with pytest.raises(ValueError, match="alpha is missing.*theme is unknown"):
        config.checked(bad)
    assert config.problems(good | {"ma_short": 300}) == ["ma_short must be below ma_long"] and config.checked(good | {"deep": -0.5, "risk_free": 0}).deep == -0.5


def test_macro_names(spark):
    names = feeds.macro_names(spark)
    closes = spark.createDataFrame([("^TNX", D0, 4.1), ("GC=F", D0, 2000.0), ("other", D0, 1.0)], "ticker string, day date, level double")
    got = {(r.asset, r.is_rate) for r in feeds.macro_levels(closes, names).collect()}
    assert got == {("US 10Y Yield", True), ("Gold", False)} and names.count() == 5


def test_phases_come_by_number_of_days(spark):
    days = [r.days for r in cycles.phase_distribution(bars(spark, [100 + 30 * math.sin(i / 20) for i in range(400)])).collect()]
    assert days == sorted(days, reverse=True) and sum(days) == 400
