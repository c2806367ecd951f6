"""Market feeds: payloads to tables, provenance, and a polite HTTP client.

Requests are made on the driver, which writes the raw payloads; executors only read files.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.config import MACRO_ASSETS, RATE_ASSETS
from tidemark.functions.stats import no_nan

_PAIRS = "array<array<double>>"
CHART = f"symbol string, prices {_PAIRS}, total_volumes {_PAIRS}, market_caps {_PAIRS}"
FEAR_GREED = "data array<struct<timestamp:string,value:string,value_classification:string>>"
CHAIN = "metric string, values array<struct<x:long,y:double>>"


@dataclass
class Client:
    """GET with a least spacing between calls and retries on rate limits and transport errors.

    `get(url, params, headers)` returns (status, headers, body); other errors than 429 raise
    at once.  Clock and sleep can be replaced in tests.
    """

    get: Callable[[str, dict, dict], tuple[int, dict, str]]
    spacing: float = 2.5
    attempts: int = 4
    delay: float = 3.0
    longest: float = 30.0
    api_key: str | None = None
    pro: bool = False
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float | None = field(default=None, repr=False)

    def headers(self) -> dict[str, str]:
        if not self.api_key:
            return {}
        return {"x-cg-pro-api-key" if self.pro else "x-cg-demo-api-key": self.api_key}

    def base(self) -> str:
        return "https://pro-api.coingecko.com/api/v3" if self.pro else "https://api.coingecko.com/api/v3"

    def fetch(self, url: str, params: dict | None = None) -> str:
        wait, failure = self.delay, None
        for attempt in range(self.attempts):
            now = self.clock()
            if self._last is not None and now - self._last < self.spacing:
                self.sleep(self.spacing - (now - self._last))
            self._last = self.clock()
            pause = wait
            try:
                status, headers, body = self.get(url, params or {}, self.headers())
            except OSError as e:
                failure = e
            else:
                if status < 400:
                    return body
                failure = RuntimeError(f"status {status} from {url}")
                if status != 429:
                    raise failure
                try:
                    pause = float(headers.get("Retry-After", wait))
                except ValueError:
                    pass
            if attempt + 1 < self.attempts:
                self.sleep(min(pause, self.longest))
            wait *= 2
        raise failure


def chart_bars(payloads: DataFrame) -> DataFrame:
    """bars from chart payloads (schema CHART): fields meet by timestamp, the last known value of each day counts, days without all three go."""
    parts = None
    for name, column in (("price", "prices"), ("volume", "total_volumes"), ("market_cap", "market_caps")):
        points = payloads.select("symbol", F.explode(column).alias("p")).select("symbol", F.col("p")[0].cast("long").alias("ms"), no_nan(F.col("p")[1]).alias(name))
        points = points.where(F.col(name).isNotNull()).withColumn("day", F.to_date(F.timestamp_millis("ms")))
        daily = points.groupBy("symbol", "day").agg(F.max_by(name, F.struct("ms", name)).alias(name))
        parts = daily if parts is None else parts.join(daily, ["symbol", "day"])
    return parts


def sentiment(payloads: DataFrame) -> DataFrame:
    """(day, fng_value, fng_label) from sentiment payloads (schema FEAR_GREED); rows without a time go."""
    rows = payloads.select(F.inline("data"))
    day = F.to_date(F.timestamp_seconds(F.expr("try_cast(timestamp as bigint)")))
    return rows.select(day.alias("day"), F.expr("try_cast(value as double)").alias("fng_value"), F.col("value_classification").alias("fng_label")).where("day is not null")


def onchain(payloads: DataFrame) -> DataFrame:
    """(day, tx_count, active_addresses) from chart payloads (schema CHAIN), days that have both."""
    points = payloads.select("metric", F.inline("values")).where("y is not null and not isnan(y)").withColumn("day", F.to_date(F.timestamp_seconds("x")))
    daily = points.groupBy("metric", "day").agg(F.max_by("y", F.struct("x", "y")).alias("y"))
    pick = lambda m: daily.where(F.col("metric") == m).select("day", F.col("y").alias(m))
    return pick("tx_count").join(pick("active_addresses"), "day")


def macro_levels(closes: DataFrame, names: DataFrame) -> DataFrame:
    """macro(asset, day, level, is_rate) from closes (ticker, day, level): renamed by (ticker, asset, is_rate), forward-filled per asset.

    A feed that ends stays flat from there on, like its source.  No rows are an error.
    """
    from tidemark.operators.returns import forward_filled

    rows = closes.join(names, "ticker").select("asset", "day", no_nan(F.col("level")).alias("level"), "is_rate")
    days = rows.where("level is not null").select("day").distinct()
    grid = days.crossJoin(rows.select("asset", "is_rate").distinct())  # days by assets is the matrix asked for
    filled = forward_filled(grid.join(rows.select("asset", "day", "level"), ["asset", "day"], "left"))
    return filled.where("level is not null").select("asset", "day", "level", "is_rate")


def macro_names(spark: SparkSession) -> DataFrame:
    """(ticker, asset, is_rate) of the macro assets by default, a few rows."""
    return spark.createDataFrame([(t, a, a in RATE_ASSETS) for t, a in MACRO_ASSETS.items()], "ticker string, asset string, is_rate boolean")


def with_fallback(fetch: Callable[[], DataFrame], fallback: Callable[[], DataFrame], simulated: bool = False) -> DataFrame:
    """The feed with its `source`: live, simulated (asked for), or sample where fetching failed."""
    if simulated:
        return fallback().withColumn("source", F.lit("simulated"))
    try:
        live = fetch()
        if live.isEmpty():
            raise ValueError("the feed is empty")
        return live.withColumn("source", F.lit("live"))
    except Exception:  # whatever a provider does wrong, the sample stands in
        return fallback().withColumn("source", F.lit("sample"))


def provenance(tables: DataFrame) -> DataFrame:
    """One row (source) for a table with `source`: live, simulated, mixed (some live) or sample."""
    live, simulated = F.col("source") == "live", F.col("source") == "simulated"
    value = F.when(F.bool_and(live), "live").when(F.bool_and(simulated), "simulated").when(F.bool_or(live), "mixed").otherwise("sample")
    return tables.agg(value.alias("source"))


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
