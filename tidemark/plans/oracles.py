"""DuckDB SQL that states each query's result independently of the Spark plans."""

from __future__ import annotations

BARS = """
bars AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS price,
                sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS volume FROM orders GROUP BY ALL)"""
MACRO = """
macro AS (SELECT l_returnflag AS asset, l_shipdate::DATE AS day, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) AS level, l_returnflag = 'R' AS is_rate
          FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY ALL)"""
SENTIMENT = """
mood AS (SELECT ts::DATE AS day, least(greatest(sum(value::DECIMAL(18,2))::DOUBLE / count(*), 0.0), 100.0) AS fng_value FROM events GROUP BY ALL)"""
DAILY = """
daily AS (SELECT event_type AS symbol, ts::DATE AS day, arg_max(value, (ts, event_id)) AS price FROM events WHERE value IS NOT NULL GROUP BY ALL)"""
RETURNS = BARS + """,
r AS (SELECT symbol, day, price, price / nullif(lag(price) OVER w, 0) - 1 AS ret, price / max(price) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
i AS (SELECT *, CASE WHEN count(ret) OVER v = 30 THEN stddev_samp(ret) OVER v * sqrt(365) END AS rolling_vol
      FROM r WINDOW v AS (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING))"""
PROFILE = RETURNS + """,
q AS (SELECT symbol, quantile_cont(ret, 1 - 0.95::DOUBLE) AS cut FROM r GROUP BY symbol),
l AS (SELECT symbol, max(day) FILTER (rolling_vol IS NOT NULL) AS latest FROM i GROUP BY symbol),
p AS (
  SELECT i.symbol, stddev_samp(ret) * sqrt(365) AS annual_volatility, -max(cut) AS var_95, -quantile_cont(ret, 1 - 0.99::DOUBLE) AS var_99, -avg(ret) FILTER (ret <= cut) AS cvar_95,
         min(drawdown) AS max_drawdown, (avg(ret) - 0.04::DOUBLE / 365) / nullif(stddev_samp(ret), 0) * sqrt(365) AS sharpe,
         (avg(ret) - 0.04::DOUBLE / 365) / nullif(sqrt(avg(pow(least(ret - 0.04::DOUBLE / 365, 0), 2)) FILTER (ret IS NOT NULL)), 0) * sqrt(365) AS sortino,
         count(rolling_vol) AS vols, max(rolling_vol) FILTER (day = latest) AS now,
         quantile_cont(rolling_vol, 0.33) FILTER (day < latest) AS low, quantile_cont(rolling_vol, 0.66) FILTER (day < latest) AS high
  FROM i JOIN q USING (symbol) JOIN l USING (symbol) GROUP BY i.symbol),
profile AS (SELECT symbol, annual_volatility, var_95, var_99, cvar_95, max_drawdown, sharpe, sortino,
                   CASE WHEN vols < 5 THEN 'Unknown' WHEN now <= low THEN 'Low' WHEN now >= high THEN 'High' ELSE 'Elevated' END AS regime FROM p)"""


def phases(bars: str) -> str:
    """CTEs up to `phases` over a CTE `bars`."""
    return bars + """,
n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
m AS (SELECT *, CASE WHEN n >= 300 THEN 200 ELSE greatest(20, n // 3) END AS ma_long FROM n),
s AS (SELECT *, CASE WHEN n >= 300 THEN 50 ELSE greatest(5, ma_long // 4) END AS ma_short, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k FROM m),
a AS (SELECT *, CASE WHEN k >= ma_short THEN avg(price) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN (ma_short - 1) PRECEDING AND CURRENT ROW) END AS sma_short,
             CASE WHEN k >= ma_long THEN avg(price) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN (ma_long - 1) PRECEDING AND CURRENT ROW) END AS sma_long,
             price / max(price) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
             price - lag(price) OVER (PARTITION BY symbol ORDER BY day) AS change FROM s),
g AS (SELECT *, (13.0::DOUBLE / 14) AS q, CASE WHEN k = 2 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 14 END AS weight FROM a),
e AS (SELECT *, pow(q, k - 2) * sum(greatest(change, 0) * weight * pow(q, -(k - 2))) OVER w AS gain, pow(q, k - 2) * sum(greatest(-change, 0) * weight * pow(q, -(k - 2))) OVER w AS loss
      FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN k < 15 THEN NULL WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100.0 ELSE 50.0 END AS rsi FROM e),
phases AS (
  SELECT symbol, day, price, sma_short, sma_long, ma_short, ma_long, rsi, drawdown,
         CASE WHEN sma_long IS NULL OR rsi IS NULL THEN 'Undetermined'
              WHEN price > sma_short AND sma_short > sma_long AND rsi >= 55 THEN 'Markup (Bull)'
              WHEN price > sma_short AND sma_short > sma_long AND drawdown > -0.10 THEN 'Distribution'
              WHEN price < sma_short AND sma_short < sma_long AND rsi > 45 AND drawdown < -0.25 THEN 'Accumulation'
              WHEN price < sma_short AND sma_short < sma_long THEN 'Markdown (Bear)'
              WHEN drawdown < -0.30 AND rsi < 50 THEN 'Accumulation'
              WHEN drawdown > -0.10 AND rsi > 55 THEN 'Distribution' ELSE 'Transition' END AS phase FROM f)"""


ALIGNED = BARS + "," + MACRO + """,
days AS (SELECT day FROM bars INTERSECT SELECT day FROM macro),
lv AS (SELECT symbol AS asset, day, price AS level, false AS is_rate FROM bars UNION ALL SELECT asset, day, level, is_rate FROM macro),
mr AS (SELECT asset, day, CASE WHEN is_rate THEN level - lag(level) OVER w ELSE level / nullif(lag(level) OVER w, 0) - 1 END AS ret
       FROM lv WHERE day IN (SELECT day FROM days) WINDOW w AS (PARTITION BY asset ORDER BY day)),
present AS (SELECT * FROM mr WHERE day IN (SELECT day FROM mr GROUP BY day HAVING count(ret) > 0)),
cov AS (SELECT asset, count(ret) AS n, count(ret) >= 0.5 * max(count(ret)) OVER () AS keep FROM present GROUP BY asset),
full_days AS (SELECT day FROM present WHERE asset IN (SELECT asset FROM cov WHERE keep) GROUP BY day HAVING count(ret) = (SELECT count(*) FROM cov WHERE keep)),
al AS (SELECT asset, day, ret FROM present WHERE asset IN (SELECT asset FROM cov WHERE keep) AND day IN (SELECT day FROM full_days))"""
PAIRS = ALIGNED + """,
cm AS (SELECT a.asset AS asset_a, b.asset AS asset_b, corr(a.ret, b.ret) AS corr FROM al a JOIN al b USING (day) GROUP BY ALL)"""
DENSE = """,
span AS (SELECT symbol, min(day) AS low, max(day) AS high FROM bars GROUP BY symbol),
grid AS (SELECT symbol, unnest(generate_series(low, high, INTERVAL 1 DAY))::DATE AS day FROM span),
dense AS (SELECT symbol, day, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS price FROM grid LEFT JOIN bars USING (symbol, day))"""
LOGS = BARS + DENSE + """,
lg AS (SELECT *, ln(price) AS log_price, lag(ln(price)) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY symbol) AS n FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY day)),
ts AS (SELECT *, k > n - greatest(10, floor(n * 0.15)) AS is_test FROM lg)"""
BANDS = "CASE WHEN fng_value <= 25 THEN 'Extreme Fear' WHEN fng_value <= 45 THEN 'Fear' WHEN fng_value <= 55 THEN 'Neutral' WHEN fng_value <= 75 THEN 'Greed' ELSE 'Extreme Greed' END"


def of(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


ORACLES = {
    "daily_bars": of(BARS, "SELECT symbol, day, round(price, 4) AS price, round(volume, 2) AS volume FROM bars"),
    "daily_last": of(DAILY, "SELECT symbol, day, price FROM daily"),
    "daily_returns": of(RETURNS, "SELECT symbol, day, round(ret, 8) AS ret FROM r WHERE ret IS NOT NULL"),
    "log_returns": of(BARS, "SELECT * FROM (SELECT symbol, day, round(ln(price / nullif(lag(price) OVER (PARTITION BY symbol ORDER BY day), 0)), 8) AS ret FROM bars) WHERE ret IS NOT NULL"),
    "annualised_volatility": of(PROFILE, "SELECT symbol, round(annual_volatility, 6) AS annual_volatility FROM profile"),
    "rolling_volatility": of(RETURNS, "SELECT symbol, day, round(rolling_vol, 6) AS rolling_vol FROM i WHERE rolling_vol IS NOT NULL"),
    "mean_rolling_volatility": of(RETURNS, "SELECT symbol, round(avg(rolling_vol), 6) AS mean_vol FROM i GROUP BY symbol"),
    "historical_var": of(PROFILE, "SELECT symbol, round(var_95, 6) AS var_95, round(var_99, 6) AS var_99 FROM profile"),
    "conditional_var": of(PROFILE, "SELECT symbol, round(cvar_95, 6) AS cvar_95 FROM profile"),
    "drawdown_series": of(RETURNS, "SELECT symbol, day, round(drawdown, 8) AS drawdown FROM i"),
    "max_drawdown": of(PROFILE, "SELECT symbol, round(max_drawdown, 6) AS max_drawdown FROM profile"),
    "sharpe": of(PROFILE, "SELECT symbol, round(sharpe, 6) AS sharpe FROM profile"),
    "sortino": of(PROFILE, "SELECT symbol, round(sortino, 6) AS sortino FROM profile"),
    "volatility_regime": of(PROFILE, "SELECT symbol, regime FROM profile"),
    "risk_profile": of(
        PROFILE,
        "SELECT symbol, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("annual_volatility", "var_95", "var_99", "cvar_95", "max_drawdown", "sharpe", "sortino")) + ", regime FROM profile",
    ),
    "moving_averages": of(phases(BARS), "SELECT symbol, day, round(sma_short / price, 8) AS short_ratio, round(sma_long / price, 8) AS long_ratio, ma_short::INT AS ma_short, ma_long::INT AS ma_long FROM phases"),
    "rsi": of(phases(BARS), "SELECT symbol, day, round(rsi, 6) AS rsi FROM phases"),
    "phase_series": of(phases(BARS), "SELECT symbol, day, phase FROM phases"),
    "phase_series_short": of(phases(DAILY.replace("daily AS", "bars AS")), "SELECT symbol, day, phase, round(rsi, 6) AS rsi, ma_short::INT AS ma_short, ma_long::INT AS ma_long FROM phases"),
    "phase_distribution": of(phases(BARS), "SELECT symbol, phase, count(*) AS days FROM phases GROUP BY ALL"),
    "undetermined_days": of(phases(BARS), "SELECT symbol, count(*) FILTER (phase = 'Undetermined') AS days FROM phases GROUP BY symbol"),
    "current_phase": of(
        phases(BARS),
        """SELECT symbol, phase, round(rsi, 6) AS rsi, round(price / sma_long - 1, 6) AS price_vs_ma_long, round(drawdown, 6) AS drawdown_from_high,
       CASE WHEN sma_long IS NULL THEN 'n/a' WHEN price > sma_long THEN 'Up' ELSE 'Down' END AS trend, ma_short::INT AS ma_short, ma_long::INT AS ma_long
FROM phases QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1""",
    ),
    "densified_prices": of(BARS + DENSE, "SELECT symbol, day, round(price, 4) AS price FROM dense"),
    "close_price_matrix": of(
        BARS,
        """SELECT day, symbol, round(price, 4) AS price FROM (
  SELECT day, symbol, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS price
  FROM (SELECT DISTINCT day FROM bars) CROSS JOIN (SELECT DISTINCT symbol FROM bars) LEFT JOIN bars USING (day, symbol)) WHERE price IS NOT NULL""",
    ),
    "aligned_returns": of(ALIGNED, "SELECT asset, day, round(ret, 6) AS ret FROM al"),
    "column_coverage": of(ALIGNED, "SELECT asset, n, keep FROM cov"),
    "correlation_pearson": of(PAIRS, "SELECT asset_a, asset_b, round(corr, 6) AS corr FROM cm"),
    "correlation_spearman": of(
        ALIGNED + """,
rk AS (SELECT asset, day, rank() OVER (PARTITION BY asset ORDER BY ret) + (count(*) OVER (PARTITION BY asset, ret) - 1) / 2.0::DOUBLE AS ret FROM al)""",
        "SELECT a.asset AS asset_a, b.asset AS asset_b, round(corr(a.ret, b.ret), 6) AS corr FROM rk a JOIN rk b USING (day) GROUP BY ALL",
    ),
    "crypto_macro_summary": of(PAIRS, "SELECT asset_a, asset_b, round_even(corr, 2) AS corr FROM cm WHERE asset_a IN (SELECT symbol FROM bars) AND asset_b IN (SELECT asset FROM macro)"),
    "rolling_correlation": of(
        ALIGNED,
        """SELECT asset, day, round(corr, 6) AS corr FROM (
  SELECT a.asset, day, CASE WHEN count(*) OVER w = 30 THEN corr(a.ret, b.ret) OVER w END AS corr FROM al a JOIN al b USING (day) WHERE b.asset = 'A' AND a.asset <> 'A'
  WINDOW w AS (PARTITION BY a.asset ORDER BY day ROWS 29 PRECEDING)) WHERE corr IS NOT NULL""",
    ),
    "beta": of(ALIGNED, "SELECT a.asset, round(CASE WHEN count(*) >= 3 THEN regr_slope(a.ret, b.ret) END, 6) AS beta FROM al a JOIN al b USING (day) WHERE b.asset = 'A' AND a.asset <> 'A' GROUP BY a.asset"),
    "regime_correlation": of(
        ALIGNED + """,
bm AS (SELECT day, ret AS bench FROM al WHERE asset = 'A'),
cut AS (SELECT quantile_cont(bench, 0.10) AS cut, count(*) AS n FROM bm)""",
        """SELECT asset, 'A' AS benchmark, round(corr(ret, bench) FILTER (bench > cut), 6) AS calm, round(corr(ret, bench) FILTER (bench <= cut), 6) AS stressed,
       round(corr(ret, bench) FILTER (bench <= cut) - corr(ret, bench) FILTER (bench > cut), 6) AS shift, count(*) FILTER (bench > cut) AS calm_days, count(*) FILTER (bench <= cut) AS stressed_days
FROM al JOIN bm USING (day) CROSS JOIN cut WHERE asset <> 'A' GROUP BY asset""",
    ),
    "naive_backtest": of(
        LOGS,
        """SELECT symbol, count(*) AS n_test, round(sqrt(avg(pow(price - exp(before), 2))), 2) AS naive_rmse, round(avg(abs(price - exp(before))), 2) AS naive_mae, round(100 * avg(abs((price - exp(before)) / price)), 6) AS naive_mape
FROM ts WHERE is_test AND before IS NOT NULL GROUP BY symbol""",
    ),
    "random_walk_forecast": of(
        LOGS + """,
lw AS (SELECT symbol, max(day) AS ended, arg_max(log_price, day) AS level, avg(pow(log_price - before, 2)) AS variance FROM ts GROUP BY symbol),
st AS (SELECT *, unnest(range(1, 31)) AS step FROM lw)""",
        """SELECT symbol, (ended + step::INT)::DATE AS day, step::INT AS step, round(exp(level), 2) AS point, round(exp(level - 1.2815515655446004::DOUBLE * sqrt(variance * step)), 2) AS lower,
       round(exp(level + 1.2815515655446004::DOUBLE * sqrt(variance * step)), 2) AS upper FROM st""",
    ),
    "sentiment_bands": of(SENTIMENT, f"SELECT day, round(fng_value, 4) AS fng_value, {BANDS} AS fng_label FROM mood"),
    "overview": of(
        BARS + """,
rn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars)""",
        """SELECT symbol, round(max(price) FILTER (k = 1), 4) AS price, round(max(price) FILTER (k = 1) / nullif(max(price) FILTER (k = 2), 0) - 1, 6) AS change_1,
       round(max(price) FILTER (k = 1) / nullif(max(price) FILTER (k = least(31, n)), 0) - 1, 6) AS change_30 FROM rn GROUP BY symbol""",
    ),
    "latest_k": of(BARS, "SELECT symbol, day, round(price, 4) AS price FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 50"),
    "phase_rows": of(phases(BARS), "SELECT symbol, day, round(price, 4) AS price FROM phases WHERE phase = 'Accumulation'"),
    "history_window": of(BARS, "SELECT symbol, day, round(price, 4) AS price FROM bars WHERE day > (SELECT max(day) FROM bars) - 365"),
    "regime_absent": of(
        ALIGNED + """,
bm AS (SELECT day, ret AS bench FROM al WHERE asset = 'A'),
cut AS (SELECT quantile_cont(bench, 0.10) AS cut FROM bm),
sides AS (SELECT asset, corr(ret, bench) FILTER (bench > cut) AS calm, corr(ret, bench) FILTER (bench <= cut) AS stressed, count(*) FILTER (bench > cut) AS calm_days, count(*) FILTER (bench <= cut) AS stressed_days
          FROM al JOIN bm USING (day) CROSS JOIN cut GROUP BY asset)""",
        """SELECT w.asset, 'A' AS benchmark, round(calm, 6) AS calm, round(stressed, 6) AS stressed, round(stressed - calm, 6) AS shift, coalesce(calm_days, 0) AS calm_days, coalesce(stressed_days, 0) AS stressed_days
FROM (VALUES ('N'), ('nowhere')) AS w(asset) LEFT JOIN sides USING (asset)""",
    ),
    "macro_block_absent": of(PAIRS, "SELECT asset_a, asset_b, round_even(corr, 2) AS corr FROM cm WHERE asset_a IN ('1-URGENT', 'nowhere') AND asset_b IN ('R', 'nothing')"),
    "regime_table": of(
        ALIGNED + """,
bm AS (SELECT day, ret AS bench FROM al WHERE asset = 'A'),
cut AS (SELECT quantile_cont(bench, 0.10) AS cut FROM bm),
sides AS (SELECT asset, corr(ret, bench) FILTER (bench > cut) AS calm, corr(ret, bench) FILTER (bench <= cut) AS stressed, count(*) FILTER (bench > cut) AS calm_days, count(*) FILTER (bench <= cut) AS stressed_days
          FROM al JOIN bm USING (day) CROSS JOIN cut WHERE asset <> 'A' GROUP BY asset)""",
        """SELECT asset, coalesce(printf('%+.2f', calm), '—') AS calm, coalesce(printf('%+.2f', stressed), '—') AS stressed, coalesce(printf('%+.2f', stressed - calm), '—') AS shift, calm_days, stressed_days FROM sides""",
    ),
    "cycle_table": of(
        phases(BARS),
        """SELECT symbol, phase, coalesce(printf('%.0f', rsi), '—') AS rsi, coalesce(printf('%+.1f%%', 100 * (price / sma_long - 1)), '—') AS price_vs_ma_long, coalesce(printf('%.1f%%', 100 * drawdown), '—') AS drawdown,
       CASE WHEN sma_long IS NULL THEN 'n/a' WHEN price > sma_long THEN 'Up' ELSE 'Down' END AS trend, ma_long::INT AS ma_long
FROM phases QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1""",
    ),
    "chart_bars": """
SELECT event_type AS symbol, ts::DATE AS day, arg_max(value, (epoch_ms(ts), value)) AS price, arg_max(value * 10, (epoch_ms(ts), value)) FILTER (event_id % 7 <> 0) AS volume,
       arg_max(user_id::DOUBLE, (epoch_ms(ts), user_id)) FILTER (event_id % 5 <> 0) AS market_cap
FROM events GROUP BY ALL HAVING volume IS NOT NULL AND market_cap IS NOT NULL""",
    "sentiment_feed": """
SELECT ts::DATE AS day, CASE WHEN event_id % 13 <> 0 THEN (event_id % 101)::DOUBLE END AS fng_value, event_type AS fng_label FROM events WHERE event_id % 11 <> 0""",
    "onchain_feed": """
SELECT ts::DATE AS day, arg_max(user_id::DOUBLE, (epoch_ms(ts) // 1000, user_id)) FILTER (event_type = 'click') AS tx_count,
       arg_max(user_id::DOUBLE, (epoch_ms(ts) // 1000, user_id)) FILTER (event_type = 'view' AND day(ts) % 3 <> 0) AS active_addresses
FROM events GROUP BY ALL HAVING tx_count IS NOT NULL AND active_addresses IS NOT NULL""",
    "macro_filled": of(
        MACRO + """,
m AS (SELECT 'Flag ' || asset AS asset, day, CASE WHEN day(day) % 4 <> 0 THEN level END AS level, asset = 'R' AS is_rate FROM macro WHERE asset IN ('A', 'R')),
g AS (SELECT a.asset, a.is_rate, d.day, m.level FROM (SELECT DISTINCT day FROM m WHERE level IS NOT NULL) d CROSS JOIN (SELECT DISTINCT asset, is_rate FROM m) a LEFT JOIN m ON m.asset = a.asset AND m.day = d.day)""",
        """SELECT asset, day, round(filled, 6) AS level, is_rate FROM (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY asset ORDER BY day) AS filled FROM g) WHERE filled IS NOT NULL""",
    ),
    "feed_status": """
SELECT * FROM (VALUES ('Crypto (CoinGecko)', 'mixed'), ('Macro (Yahoo Finance)', 'live'), ('Sentiment (Fear & Greed)', 'sample'), ('On-chain (Blockchain.info)', 'sample'), ('1-URGENT', 'live'), ('2-HIGH', 'sample')) AS t(feed, source)""",
}
ORACLES |= {
    "stored_bars": ORACLES["daily_bars"],
    "stored_volatility": ORACLES["rolling_volatility"],
    "streamed_bars": ORACLES["daily_last"],
    "streamed_indicators": of(phases(BARS), "SELECT symbol, day, round(rsi, 6) AS rsi, round(drawdown, 6) AS drawdown FROM phases"),
    "memoised_profile": ORACLES["risk_profile"],
    "chart_bars_json": ORACLES["chart_bars"],
    "sentiment_feed_json": ORACLES["sentiment_feed"],
    "onchain_feed_json": ORACLES["onchain_feed"],
    "payload_health": """
WITH d AS (
  SELECT DISTINCT 'chart' AS feed, event_type AS asset, ts::DATE AS day FROM events
  UNION ALL SELECT DISTINCT 'sentiment', 'all', ts::DATE FROM events
  UNION ALL SELECT DISTINCT 'chain', CASE event_type WHEN 'click' THEN 'tx_count' ELSE 'active_addresses' END, ts::DATE FROM events
  WHERE event_type = 'click' OR event_type = 'view' AND day(ts) % 3 <> 0)
SELECT feed, asset, count(*) + count(*) FILTER (dayofyear(day) % 11 = 0) AS responses, count(*) FILTER (dayofyear(day) % 11 = 0) AS corrupt FROM d GROUP BY ALL""",
    "spread_ranks": """
SELECT o_orderpriority AS asset, o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0::DOUBLE AS rank FROM orders""",
    "exact_var": ORACLES["historical_var"],
    "segmented_indicators": f"""
SELECT symbol, day, ret, drawdown, rolling_vol, rsi FROM
  ({of(RETURNS, "SELECT symbol, day, round(ret, 6) AS ret, round(drawdown, 6) AS drawdown, round(rolling_vol, 6) AS rolling_vol FROM i")})
  JOIN ({of(phases(BARS), "SELECT symbol, day, round(rsi, 6) AS rsi FROM phases")}) USING (symbol, day)""",
    "backtest_naive": of(LOGS, "SELECT symbol, day, round(log_price, 8) AS log_actual, round(before, 8) AS log_naive FROM ts WHERE is_test AND before IS NOT NULL"),
    "fan_history": of(BARS, "SELECT symbol, day, round(price, 4) AS value FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 120"),
}
