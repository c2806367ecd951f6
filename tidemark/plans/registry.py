"""Queries of the daily-series engine over the driver's tables; floats are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.config import DEFAULT
from tidemark.functions.stats import ratio
from tidemark.operators import correlation, cycles, forecast, large, returns, risk
from tidemark.plans.oracles import ORACLES
from tidemark.sources import bundle, feeds, files, memo, payloads, store, synthetic, tables
from tidemark.streaming import bars as streaming

Query = Callable[[SparkSession, str], DataFrame]
BENCHMARK = "A"


def _rounded(df: DataFrame, places: int | dict[str, int]) -> DataFrame:
    def of(name: str, kind: str):
        n = places if isinstance(places, int) else places.get(name)
        return F.round(name, n).alias(name) if kind == "double" and n is not None else F.col(name)

    return df.select(*(of(c, t) for c, t in df.dtypes))


def _on_bars(f: Callable[[DataFrame], DataFrame], places: int | dict[str, int] = 6) -> Query:
    return lambda spark, sf_dir: _rounded(f(tables.bars_orders(spark, sf_dir)), places)


def _profile(*columns: str) -> Query:
    return _on_bars(lambda bars: risk.risk_profile(bars).select("symbol", *columns))


def _aligned(f: Callable[[DataFrame], DataFrame], places: int = 6) -> Query:
    return lambda spark, sf_dir: _rounded(f(returns.aligned_returns(tables.bars_orders(spark, sf_dir), tables.macro_lineitem(spark, sf_dir))), places)


def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = returns.align(tables.bars_orders(spark, sf_dir), tables.macro_lineitem(spark, sf_dir))
    return returns.coverage(returns.drop_empty_days(returns.mixed_returns(levels)))


def crypto_macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.macro_block(returns.aligned_returns(tables.bars_orders(spark, sf_dir), tables.macro_lineitem(spark, sf_dir)))


def overview(bars: DataFrame) -> DataFrame:
    """(symbol, price, change_1, change_30): the last price against the row before and the thirtieth before, or the first."""
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    rows = bars.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("price")))
    return rows.groupBy("symbol").agg(at(F.lit(1)).alias("price"), (ratio(at(F.lit(1)), at(F.lit(2))) - 1).alias("change_1"), (ratio(at(F.lit(1)), at(F.least(F.lit(31), F.col("n")))) - 1).alias("change_30"))


def latest(bars: DataFrame, k: int = 50) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    return bars.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("symbol", "day", "price")


def sentiment_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = tables.sentiment_events(spark, sf_dir)
    return mood.select("day", F.round("fng_value", 4).alias("fng_value"), synthetic.label(F.col("fng_value")).alias("fng_label"))


def phase_series_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.daily_last(tables.ticks_events(spark, sf_dir))
    return _rounded(cycles.phase_series(bars).select("symbol", "day", "phase", "rsi", "ma_short", "ma_long"), 6)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("day", F.to_date("ts"))


def chart_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed as chart responses, one for each type and day: some volumes unknown, some capitalisations missing."""
    rows = _events(spark, sf_dir)
    pair = lambda v: F.array(F.col("ms").cast("double"), v)
    volume = F.when(F.col("event_id") % 7 != 0, F.col("value") * 10)
    cap = F.when(F.col("event_id") % 5 != 0, pair(F.col("user_id").cast("double")))
    return rows.groupBy(F.col("event_type").alias("symbol"), "day").agg(F.collect_list(pair(F.col("value"))).alias("prices"), F.collect_list(pair(volume)).alias("total_volumes"), F.collect_list(cap).alias("market_caps"))


def sentiment_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed as sentiment responses, one a day; some have no readable time or value."""
    time = F.when(F.col("event_id") % 11 == 0, "soon").otherwise((F.floor(F.col("ms") / 1000)).cast("string"))
    value = F.when(F.col("event_id") % 13 == 0, "none").otherwise((F.col("event_id") % 101).cast("string"))
    entry = F.struct(time.alias("timestamp"), value.alias("value"), F.col("event_type").alias("value_classification"))
    return _events(spark, sf_dir).groupBy("day").agg(F.collect_list(entry).alias("data"))


def chain_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views packed as chain responses, one for each day; users stand for counts."""
    rows = _events(spark, sf_dir).where("event_type in ('click', 'view')").where("event_type = 'click' or dayofmonth(day) % 3 <> 0")
    metric = F.when(F.col("event_type") == "click", "tx_count").otherwise("active_addresses").alias("metric")
    return rows.groupBy(metric, "day").agg(F.collect_list(F.struct(F.floor(F.col("ms") / 1000).alias("x"), F.col("user_id").cast("double").alias("y"))).alias("values"))


def filled_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes by ticker with gaps, renamed and filled."""
    closes = tables.macro_lineitem(spark, sf_dir).select(F.concat(F.lit("^"), "asset").alias("ticker"), "day", F.when(F.dayofmonth("day") % 4 != 0, F.col("level")).alias("level"))
    names = spark.createDataFrame([("^A", "Flag A", False), ("^R", "Flag R", True), ("^X", "absent", False)], "ticker string, asset string, is_rate boolean")
    return feeds.macro_levels(closes, names)


def feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a bundle: one asset's feed fails, macro is live, sentiment fails and on-chain is empty."""
    bars, macro = tables.bars_orders(spark, sf_dir), tables.macro_lineitem(spark, sf_dir)

    def fetch(provider: str, symbol: str) -> DataFrame:
        if provider == "down":
            raise OSError("no route")
        return bars.where(F.col("symbol") == symbol)

    def fails() -> DataFrame:
        raise OSError("no route")

    loaded = bundle.load_assets(fetch, lambda s: bars.where(F.col("symbol") == s), {"one": "1-URGENT", "down": "2-HIGH"})
    mood, chain = tables.sentiment_events(spark, sf_dir), feeds.onchain(chain_payloads(spark, sf_dir))
    found = bundle.load_market(loaded, (lambda: macro, lambda: macro), (fails, lambda: mood), (lambda: chain.limit(0), lambda: chain))
    return found.sources.unionByName(found.asset_sources.withColumnRenamed("symbol", "feed"))


def _stored(spark: SparkSession, sf_dir: str) -> store.BarStore:
    """The order bars in a table of their own: first as an estimate of every other month, then as they are."""
    bars, kept = tables.bars_orders(spark, sf_dir), store.BarStore(spark, files.new_path(spark, "bars"))
    kept.upsert(bars.where(F.month("day") % 2 == 0).withColumn("price", F.col("price") + 1), "estimates")
    kept.upsert(bars, "closes")
    return kept


def _on_store(f: Callable[[store.BarStore], DataFrame], places: int | dict[str, int] = 6) -> Query:
    return lambda spark, sf_dir: _rounded(f(_stored(spark, sf_dir)), places)


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a stream of ticks whose files hold all days each, so that every micro-batch reopens days of those before."""
    ticks, at = tables.ticks_events(spark, sf_dir), files.new_path(spark, "ticks")
    ticks.repartition(4, "id").write.parquet(at)
    kept = store.BarStore(spark, files.new_path(spark, "bars"))
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(at)
    streaming.write_bars(source, kept, files.new_path(spark, "stream")).awaitTermination()
    return kept.read().select("symbol", "day", "price")


def streamed_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and drawdown carried along a stream of bars that comes in three parts."""
    bars = tables.bars_orders(spark, sf_dir).select("symbol", "day", "price")
    parted, at, out, checkpoint = (files.new_path(spark, label) for label in ("parts", "bars", "indicators", "stream"))
    third = F.floor(F.percent_rank().over(Window.partitionBy("symbol").orderBy("day")) * 3)
    bars.withColumn("part", F.least(third, F.lit(2)).cast("int")).write.partitionBy("part").parquet(parted)
    for part in range(3):
        spark.read.schema(bars.schema).parquet(f"{parted}/part={part}").write.mode("append").parquet(at)
        found = streaming.indicators_stream(spark.readStream.schema(bars.schema).parquet(at))
        with streaming.rocksdb_state(spark):
            stream = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
    return _rounded(spark.read.parquet(out).select("symbol", "day", "rsi", "drawdown"), 6)


def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of responses as JSON text; every eleventh day's also come cut off."""
    chart, mood, chain = chart_payloads(spark, sf_dir), sentiment_payloads(spark, sf_dir), chain_payloads(spark, sf_dir)
    body = lambda *columns: F.to_json(F.struct(*columns)).alias("value")
    rows = chart.select(F.lit("chart").alias("feed"), F.col("symbol").alias("asset"), "day", body("prices", "total_volumes", "market_caps"))
    rows = rows.unionByName(mood.select(F.lit("sentiment").alias("feed"), F.lit("all").alias("asset"), "day", body("data")))
    rows = rows.unionByName(chain.select(F.lit("chain").alias("feed"), F.col("metric").alias("asset"), "day", body("values")))
    cut = rows.where(F.dayofyear("day") % 11 == 0).withColumn("value", F.expr("left(value, length(value) - 3)"))
    root = files.new_path(spark, "payloads")
    payloads.save_all(rows.unionByName(cut), root)
    return payloads.raw(spark, root)


def spread_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of order totals within their priority, each priority's orders in many tasks."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("asset"), "o_orderkey", F.col("o_totalprice").cast("double").alias("ret"))
    return large.ranks(orders).select("asset", "o_orderkey", F.col("ret").alias("rank"))


def exact_var(bars: DataFrame) -> DataFrame:
    """Value at risk by passes over histograms."""
    found = large.quantiles(returns.daily_returns(bars), "symbol", "ret", [1 - 0.95, 1 - 0.99])
    at = lambda p: -F.max(F.when(F.col("probability") == p, F.col("quantile")))
    return found.groupBy("symbol").agg(at(1 - 0.95).alias("var_95"), at(1 - 0.99).alias("var_99"))


def memoised_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk profile from the stored result that a first call has left."""
    results = memo.Results(spark, files.new_path(spark, "results"))
    call = lambda: results.get("risk_profile", {"days": None}, [f"{sf_dir}/orders.parquet"], lambda: QUERIES["risk_profile"](spark, sf_dir))
    call()
    return call()


QUERIES: dict[str, Query] = {
    "daily_bars": _on_bars(lambda b: b.select("symbol", "day", "price", "volume"), {"price": 4, "volume": 2}),
    "daily_last": lambda spark, sf_dir: tables.daily_last(tables.ticks_events(spark, sf_dir)),
    "daily_returns": _on_bars(returns.daily_returns, 8),
    "log_returns": _on_bars(returns.log_returns, 8),
    "annualised_volatility": _profile("annual_volatility"),
    "rolling_volatility": _on_bars(risk.rolling_volatility),
    "mean_rolling_volatility": _on_bars(lambda b: risk.indicators(b).groupBy("symbol").agg(F.avg("rolling_vol").alias("mean_vol"))),
    "historical_var": _profile("var_95", "var_99"),
    "conditional_var": _profile("cvar_95"),
    "drawdown_series": _on_bars(risk.drawdown_series, 8),
    "max_drawdown": _profile("max_drawdown"),
    "sharpe": _profile("sharpe"),
    "sortino": _profile("sortino"),
    "volatility_regime": _profile("regime"),
    "risk_profile": _on_bars(risk.risk_profile),
    "moving_averages": _on_bars(lambda b: cycles.moving_averages(b).select("symbol", "day", ratio(F.col("sma_short"), F.col("price")).alias("short_ratio"), ratio(F.col("sma_long"), F.col("price")).alias("long_ratio"), "ma_short", "ma_long"), 8),
    "rsi": _on_bars(cycles.rsi),
    "phase_series": _on_bars(lambda b: cycles.phase_series(b).select("symbol", "day", "phase")),
    "phase_series_short": phase_series_short,
    "phase_distribution": _on_bars(cycles.phase_distribution),
    "undetermined_days": _on_bars(lambda b: cycles.phase_series(b).groupBy("symbol").agg(F.count_if(F.col("phase") == "Undetermined").alias("days"))),
    "current_phase": _on_bars(cycles.current_phase),
    "densified_prices": _on_bars(returns.densified, 4),
    "close_price_matrix": _on_bars(returns.price_matrix, 4),
    "aligned_returns": _aligned(lambda r: r.select("asset", "day", "ret")),
    "column_coverage": column_coverage,
    "correlation_pearson": _aligned(correlation.correlation_matrix),
    "correlation_spearman": _aligned(lambda r: correlation.correlation_matrix(r, "spearman")),
    "crypto_macro_summary": crypto_macro_summary,
    "rolling_correlation": _aligned(lambda r: correlation.rolling_correlation(r, BENCHMARK)),
    "beta": _aligned(lambda r: correlation.beta(r, BENCHMARK)),
    "regime_correlation": _aligned(lambda r: correlation.regime_correlation(r, BENCHMARK)),
    "regime_absent": _aligned(lambda r: correlation.regime_correlation(r, BENCHMARK, ["N", "nowhere"])),
    "macro_block_absent": _aligned(lambda r: correlation.macro_block(r, ["1-URGENT", "nowhere"], ["R", "nothing"])),
    "regime_table": _aligned(lambda r: correlation.regime_table(r, BENCHMARK)),
    "cycle_table": _on_bars(cycles.cycle_table),
    "chart_bars": lambda spark, sf_dir: feeds.chart_bars(chart_payloads(spark, sf_dir)),
    "sentiment_feed": lambda spark, sf_dir: feeds.sentiment(sentiment_payloads(spark, sf_dir)),
    "onchain_feed": lambda spark, sf_dir: feeds.onchain(chain_payloads(spark, sf_dir)),
    "macro_filled": lambda spark, sf_dir: _rounded(filled_macro(spark, sf_dir), 6),
    "feed_status": feed_status,
    "naive_backtest": _on_bars(forecast.naive_backtest, {"naive_rmse": 2, "naive_mae": 2, "naive_mape": 6}),
    "random_walk_forecast": _on_bars(forecast.random_walk_forecast, 2),
    "sentiment_bands": sentiment_bands,
    "overview": _on_bars(overview, {"price": 4, "change_1": 6, "change_30": 6}),
    "latest_k": _on_bars(latest, 4),
    "phase_rows": _on_bars(lambda b: cycles.phase_series(b).where("phase = 'Accumulation'").select("symbol", "day", "price"), 4),
    "history_window": _on_store(lambda kept: kept.recent(DEFAULT.history_days[-1]).select("symbol", "day", "price"), 4),
    "stored_bars": _on_store(lambda kept: kept.read().select("symbol", "day", "price", "volume"), {"price": 4, "volume": 2}),
    "stored_volatility": _on_store(lambda kept: risk.rolling_volatility(kept.read())),
    "streamed_bars": streamed_bars,
    "streamed_indicators": streamed_indicators,
    "memoised_profile": memoised_profile,
    "spread_ranks": spread_ranks,
    "chart_bars_json": lambda spark, sf_dir: payloads.chart_bars(stored_payloads(spark, sf_dir)),
    "sentiment_feed_json": lambda spark, sf_dir: payloads.sentiment(stored_payloads(spark, sf_dir)),
    "onchain_feed_json": lambda spark, sf_dir: payloads.onchain(stored_payloads(spark, sf_dir)),
    "payload_health": lambda spark, sf_dir: payloads.health(stored_payloads(spark, sf_dir)),
    "exact_var": _on_bars(exact_var),
    "segmented_indicators": _on_bars(lambda b: large.indicators(b, block_rows=512).drop("price")),
    "forecast": _on_bars(forecast.forecast),
    "forecast_path": _on_bars(forecast.forecast_path),
    "forecast_fan": _on_bars(forecast.forecast_fan),
    "backtest": _on_bars(forecast.backtest),
    "backtest_naive": _on_bars(lambda b: forecast.backtest(b).select("symbol", "day", F.ln("actual").alias("log_actual"), F.ln("naive").alias("log_naive")), 8),
    "fan_history": _on_bars(lambda b: forecast.forecast_fan(b).where("kind = 'history'").select("symbol", "day", "value"), 4),
}

__all__ = ["ORACLES", "QUERIES"]
