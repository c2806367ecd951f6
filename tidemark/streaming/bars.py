"""Daily bars from a stream of ticks, their table, and indicators that go on with the stream (extensions of the batch)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.config import DEFAULT, Settings
from tidemark.sources.store import BarStore


def daily_last_stream(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """(symbol, day, price): the last price of each day; a day is final once the watermark, `delay` behind, has passed it.

    `ticks` (symbol, ts timestamp, id, price) is a streaming DataFrame; later ticks are dropped.
    """
    known = ticks.where(F.col("price").isNotNull() & ~F.isnan("price")).withWatermark("ts", delay)
    daily = known.groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.max(F.struct("ts", "id", "price")).alias("last"))
    return daily.select("symbol", F.to_date("w.start").alias("day"), "last.price")


def to_bars(ticks: DataFrame) -> DataFrame:
    """(symbol, day, price, as_of, seq): the last known price of each day and the tick it is from."""
    known = ticks.where(F.col("price").isNotNull() & ~F.isnan("price"))
    last = F.max(F.struct(F.col("ts").cast("timestamp").alias("as_of"), F.col("id").cast("long").alias("seq"), "price")).alias("last")
    return known.groupBy("symbol", F.to_date("ts").alias("day")).agg(last).select("symbol", "day", "last.*")


def write_bars(ticks: DataFrame, store: BarStore, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep `store` up to date with a stream of ticks (symbol, ts, id, price).

    Each micro-batch is reduced to daily bars and merged.  A bar remembers its tick, so a late tick
    reopens its day however old that is, and replaces the bar only if it is the later one.  The batch
    id names the merge: a batch that the stream repeats after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(to_bars(batch), f"{stream}-{number}")

    stream = checkpoint.rstrip("/").rpartition("/")[2]
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


_INDICATORS = StructType([StructField("symbol", StringType()), StructField("day", DateType()), StructField("price", DoubleType()), StructField("rsi", DoubleType()), StructField("drawdown", DoubleType())])
_STATE = StructType([StructField(n, t) for n, t in (("day", DateType()), ("price", DoubleType()), ("changes", LongType()), ("gain", DoubleType()), ("loss", DoubleType()), ("high", DoubleType()))])


class _Indicators(StatefulProcessor):
    """For each symbol the last bar, the smoothed gain and loss and the running high: a few numbers, however long the history."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        day, price, changes, gain, loss, high = self.state.get() if self.state.exists() else (None, None, 0, 0.0, 0.0, None)
        n = self.window
        for bar in sorted(rows, key=lambda r: r["day"]):
            if day is not None and bar["day"] <= day:
                continue
            if price is not None:
                change = bar["price"] - price
                weight = 1.0 if changes == 0 else 1 / n
                gain += (max(change, 0.0) - gain) * weight
                loss += (max(-change, 0.0) - loss) * weight
                changes += 1
            day, price = bar["day"], bar["price"]
            high = price if high is None else max(high, price)
            strength = None
            if changes >= n:
                strength = 100 - 100 / (1 + gain / loss) if loss > 0 else 100.0 if gain > 0 else 50.0
            yield Row(symbol=key[0], day=day, price=price, rsi=strength, drawdown=price / high - 1 if high else None)
        self.state.update((day, price, changes, gain, loss, high))

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def indicators_stream(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, day, price, rsi, drawdown) for each bar of a stream, equal to the batch's over the same bars.

    `bars` (symbol, day, price) come in the order of their days from one micro-batch to the next, as
    `daily_last_stream` gives them; a bar that is not newer than the symbol's last is passed over, and so are bars
    without a price.  The state of a symbol is six numbers.  Start the query within `rocksdb_state`, as
    Spark keeps such state in RocksDB only.
    """
    known = bars.where("price is not null and day is not null").select("symbol", "day", "price")
    return known.groupBy("symbol").transformWithState(statefulProcessor=_Indicators(s.rsi_window), outputStructType=_INDICATORS, outputMode="Append", timeMode="None")
