"""Bars that stay, results that are computed once, and bars and indicators of streams."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cycles, risk
from tidemark.sources import files, memo, payloads, store, tables
from tidemark.streaming import bars as streaming

DAY = datetime.date(2024, 1, 30)
BARS = "symbol string, day date, price double, volume double, market_cap double"


def day(i):
    return DAY + datetime.timedelta(days=i)


def bars(spark, rows):
    return spark.createDataFrame([(s, d if d is None else day(d), p, None, None) for s, d, p in rows], BARS)


def rows_of(df):
    return sorted((r["symbol"], (r["day"] - DAY).days, r["price"]) for r in df.collect())


@pytest.fixture
def kept(spark, tmp_path):
    return store.BarStore(spark, f"file://{tmp_path}/bars", buckets=3)


@pytest.fixture(scope="module")
def walk():
    r, out = random.Random(4), []
    for s in ("A", "B"):
        p = 100.0
        for i in range(70):
            p = max(1.0, p + r.choice((-2, -1, 0, 1, 2)))
            out.append((s, i, p))
    return out


# -- the table ---------------------------------------------------------------------------------


def test_upsert_merges_and_repeats_change_nothing(spark, kept):
    assert kept.last_day() is None and kept.read().count() == 0 and kept.recent(5).count() == 0
    assert kept.upsert(bars(spark, [("A", 0, 1.0), ("A", 1, 2.0), ("B", 40, 3.0), (None, 0, 9.0), ("A", None, 9.0)]), "one")
    assert kept.upsert(bars(spark, [("A", 1, 5.0), ("A", 2, 6.0), ("C", 100, None)]), "two")
    want = [("A", 0, 1.0), ("A", 1, 5.0), ("A", 2, 6.0), ("B", 40, 3.0), ("C", 100, None)]
    assert rows_of(kept.read()) == want
    assert not kept.upsert(bars(spark, [("A", 1, 7.0)]), "one") and rows_of(kept.read()) == want
    assert kept.upsert(bars(spark, []), "none") and rows_of(kept.read()) == want
    assert kept.months() == [202401, 202402, 202403, 202405] and kept.last_day() == day(100)
    again = store.BarStore(spark, kept.path, buckets=99)  # the layout stays
    assert again.buckets == 3 and rows_of(again.read()) == want
    assert rows_of(kept.recent(61)) == [("B", 40, 3.0), ("C", 100, None)] and rows_of(kept.recent(60)) == [("C", 100, None)]


def test_the_more_recent_bar_stays(spark, kept):
    at = lambda h, seq, p: spark.createDataFrame([("A", DAY, p, datetime.datetime(2024, 1, 30, h), seq)], "symbol string, day date, price double, as_of timestamp, seq long")
    for h, seq, p, want in ((5, 1, 1.0, 1.0), (4, 9, 2.0, 1.0), (5, 2, 3.0, 3.0), (5, 2, 2.5, 2.5), (5, 1, 9.0, 2.5)):
        kept.upsert(at(h, seq, p))
        assert rows_of(kept.read()) == [("A", 0, want)]
    kept.upsert(at(6, 1, 4.0).union(at(6, 2, 3.0)).union(at(6, 2, 3.5)))
    assert rows_of(kept.read()) == [("A", 0, 3.5)]


@pytest.mark.parametrize("lost", ["before the journal", "before the table", "after a month", "before the mark"])
def test_a_lost_writer_is_made_good(spark, kept, monkeypatch, lost):
    kept.upsert(bars(spark, [("A", 0, 1.0), ("A", 10, 2.0)]), "one")
    put = store.BarStore._put

    def fail(self, batch):
        if lost == "before the journal":
            self.files.delete(f"{self._journal(batch)}/_SUCCESS")
        if lost == "before the mark":
            put(self, batch)
        if lost == "after a month":
            self.files.delete(f"{self.path}/month=202402")  # as if the rename had not come
        raise RuntimeError("lost")

    monkeypatch.setattr(store.BarStore, "_put", fail)
    with pytest.raises(RuntimeError):
        kept.upsert(bars(spark, [("A", 10, 3.0), ("B", 11, 4.0)]), "two")
    monkeypatch.undo()
    again = store.BarStore(spark, kept.path)
    old = lost == "before the journal"
    assert rows_of(again.read()) == ([("A", 0, 1.0), ("A", 10, 2.0)] if old else [("A", 0, 1.0), ("A", 10, 3.0), ("B", 11, 4.0)])
    assert again.upsert(bars(spark, [("A", 10, 3.0), ("B", 11, 4.0)]), "two") is old
    assert rows_of(again.read()) == [("A", 0, 1.0), ("A", 10, 3.0), ("B", 11, 4.0)]


def test_windows_need_no_shuffle_and_histories_their_months_alone(spark, kept, walk):
    kept.upsert(bars(spark, walk))
    found = risk.rolling_volatility(kept.recent(20))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(month" in plan and "Bucketed: true" in plan
    files_read = kept.recent(20).inputFiles()
    assert files_read and all("month=202403" in f or "month=202404" in f for f in files_read)
    by_table = risk.rolling_volatility(bars(spark, walk))
    assert rows_of(risk.rolling_volatility(kept.read()).withColumnRenamed("rolling_vol", "price")) == rows_of(by_table.withColumnRenamed("rolling_vol", "price"))
    assert rows_of(kept.recent(20)) == rows_of(tables.recent(bars(spark, walk), 20))


# -- results ----------------------------------------------------------------------------------


def jobs(spark, f):
    """The jobs that f runs."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        f()
        return list(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_results_are_stored_by_query_arguments_and_files(spark, tmp_path):
    source, calls, now = f"file://{tmp_path}/source", [], [1000.0]
    spark.range(5).write.parquet(source)
    results = memo.Results(spark, f"file://{tmp_path}/results", hours=1, clock=lambda: now[0])

    def produce():
        calls.append(1)
        return spark.read.parquet(source).withColumn("n", F.lit(None).cast("double"))

    get = lambda name="q", days=30: results.get(name, {"days": days, "symbol": "A"}, [source], produce)
    assert get().count() == 5 and get().schema == produce().schema and len(calls) == 2
    calls.clear()
    assert jobs(spark, get) == [] and not calls  # no job, not on the source either
    for other in (lambda: get("other"), lambda: get(days=31)):
        other(), other()
    assert len(calls) == 2 and results.count() == 3
    spark.range(2).write.mode("append").parquet(source)  # a changed input is a miss
    assert get().count() == 7 and get().count() == 7 and len(calls) == 3
    now[0] += 3601
    assert results.count() == 0 and get().count() == 7 and len(calls) == 4 and results.count() == 1
    assert results.expire() == 3 and results.clear() == 1 and results.count() == 0
    assert get().count() == 7 and len(calls) == 5


def test_callers_at_the_same_time_compute_once(spark, tmp_path):
    calls, found = [], []

    def produce():
        calls.append(1)
        return spark.range(3)

    # two caches, as two processes would have; the lock is in the store
    caches = [memo.Results(spark, f"file://{tmp_path}/r", pause=0.02) for _ in range(2)]
    callers = [threading.Thread(target=lambda c=c: found.append(c.get("q", {}, [], produce).count())) for c in caches * 3]
    for t in callers:
        t.start()
    for t in callers:
        t.join()
    assert found == [3] * 6 and len(calls) == 1 and sum(c.misses for c in caches) == 1 and sum(c.hits for c in caches) == 5


def test_errors_store_nothing_and_lost_locks_end(spark, tmp_path):
    now = [1000.0]
    results = memo.Results(spark, f"file://{tmp_path}/r", lease=60, pause=0.01, clock=lambda: now.__setitem__(0, now[0] + 5) or now[0])

    def fails():
        raise OSError("no route")

    with pytest.raises(OSError):
        results.get("q", {}, [], fails)
    folder = f"{results.files.root}/{results.fingerprint('q', {}, [])}"
    assert results.files.create(f"{folder}/_lock", "900")  # its caller is gone
    assert results.get("q", {}, [], lambda: spark.range(4)).count() == 4
    assert not results.files.exists(f"{folder}/_lock")


# -- streams -----------------------------------------------------------------------------------


def test_streamed_bars_equal_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(s, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.randrange(60 * 24 * 40)), i, None if i % 17 == 0 else float(r.randrange(100))) for i, s in enumerate("AAAB" * 60)]
    rows += [(*rows[0][:2], 1000, 5.0), rows[3]]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, id long, price double")
    ticks.repartition(5).write.parquet(f"file://{tmp_path}/ticks")
    kept = store.BarStore(spark, f"file://{tmp_path}/bars")
    stream = lambda: spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/ticks")
    checkpoint = f"file://{tmp_path}/checkpoint"
    streaming.write_bars(stream(), kept, checkpoint).awaitTermination()
    want = rows_of(tables.daily_last(ticks))
    assert rows_of(kept.read()) == want
    kept.files.delete(f"{checkpoint}/commits")  # the last batch is taken for unfinished and comes again
    streaming.write_bars(stream(), kept, checkpoint).awaitTermination()
    assert rows_of(kept.read()) == want
    late = spark.createDataFrame([("A", datetime.datetime(2024, 1, 1, 0, 0), 0, 7.0), ("A", datetime.datetime(2024, 1, 2, 23, 59, 59), 0, 8.0), ("C", datetime.datetime(2023, 5, 1), 0, 9.0)], ticks.schema)
    late.write.mode("append").parquet(f"file://{tmp_path}/ticks")
    streaming.write_bars(stream(), kept, checkpoint).awaitTermination()
    assert rows_of(kept.read()) == rows_of(tables.daily_last(ticks.union(late)))


def test_streamed_indicators_equal_the_batch(spark, tmp_path, walk):
    at, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    flat = [("F", i, 3.0) for i in range(20)] + [("U", i, 1.0 + i) for i in range(20)] + [("Z", i, 0.0) for i in range(3)]
    table = bars(spark, walk + flat).select("symbol", "day", "price")
    for low, high in ((0, 9), (9, 10), (10, 70)):
        table.where(F.col("day").between(F.lit(day(low)), F.lit(day(high - 1)))).write.mode("append").parquet(at)
        if low == 10:  # a day that has gone by, and a bar without a price, are passed over
            bars(spark, [("A", 3, 999.0), ("A", 300, None)]).select("symbol", "day", "price").write.mode("append").parquet(at)
        source = streaming.indicators_stream(spark.readStream.schema(table.schema).parquet(at))
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        with streaming.rocksdb_state(spark):
            stream = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {(r["symbol"], r["day"]): r for r in spark.read.parquet(out).collect()}
    want = cycles.rsi(table).join(risk.drawdown_series(table), ["symbol", "day"]).collect()
    assert len(got) == len(want) == len(walk) + len(flat)
    for r in want:
        mine = got[r["symbol"], r["day"]]
        assert mine["rsi"] == pytest.approx(r["rsi"], abs=1e-9) and mine["drawdown"] == pytest.approx(r["drawdown"], abs=1e-12)
    assert {r["rsi"] for r in got.values()} >= {None, 50.0, 100.0}


def test_small_files(spark, tmp_path):
    f = files.Files(spark, f"file://{tmp_path}/x")
    assert f.create(f"{f.root}/a", "é\n") and not f.create(f"{f.root}/a", "b") and f.text(f"{f.root}/a") == "é\n"
    assert [(p.rpartition("/")[2], folder, n) for p, folder, n, _ in f.listed(f.root) if not p.endswith(".crc")] == [("a", False, 3)]
    assert f.rename(f"{f.root}/a", f"{f.root}/b") and f.exists(f"{f.root}/b") and f.listed(f"{f.root}/none") == []
    f.create(f"{f.root}/deep/_hidden", ""), f.create(f"{f.root}/deep/c", "1")
    assert [p.rpartition("/x")[2] for p, _, _ in f.below(f.root)] == ["/b", "/deep/c"]


# -- stored responses ----------------------------------------------------------------------------


def test_responses_are_read_as_stored_and_broken_ones_counted(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    good = '{"prices": [[1704067200000, 1.5], [1704070800000, 2]],\n "total_volumes": [[1704067200000, 10]], "market_caps": [[1704067200000, null], [1704067200001, 7]], "more": {}}'
    for asset, bodies in {"BTC": [good, good[:40], ""], "ETH": ["[]", "null", "no", '{"prices": "none"}', "{}"]}.items():
        for body in bodies:
            payloads.save(spark, root, "chart", asset, body)
    payloads.save(spark, root, "sentiment", "all", '{"data": [{"timestamp": "1704067200", "value": "55", "value_classification": "Neutral"}]}')
    payloads.save_all(spark.createDataFrame([("chain", m, f'{{"values":\n[{{"x": 1704067200, "y": {y}}}]}}') for m, y in (("tx_count", 3), ("active_addresses", 4.5))], "feed string, asset string, value string"), root)
    rows = payloads.raw(spark, root)
    bar = payloads.chart_bars(rows).collect()
    assert [(r.symbol, str(r.day), r.price, r.volume, r.market_cap) for r in bar] == [("BTC", "2024-01-01", 2.0, 10.0, 7.0)]
    assert [(str(r.day), r.fng_value, r.fng_label) for r in payloads.sentiment(rows).collect()] == [("2024-01-01", 55.0, "Neutral")]
    assert [(r.tx_count, r.active_addresses) for r in payloads.onchain(rows).collect()] == [(3.0, 4.5)]
    health = {(r.feed, r.asset): (r.responses, r.corrupt) for r in payloads.health(rows).collect()}
    assert health["chart", "BTC"] == (3, 2) and health["chart", "ETH"][0] == 5 and 3 <= health["chart", "ETH"][1] <= 4 and health["sentiment", "all"] == (1, 0)
    plan = payloads.chart_bars(rows)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(feed" in plan  # other feeds' folders are not read


def test_responses_come_as_a_stream(spark, tmp_path):
    root, kept = f"file://{tmp_path}/raw", []
    stream = lambda: payloads.raw_stream(spark, root).writeStream.option("checkpointLocation", f"file://{tmp_path}/c").foreachBatch(lambda df, i: kept.extend(payloads.responses(df, "chart").select("symbol").collect())).trigger(availableNow=True).start().awaitTermination()
    for asset in ("BTC", "ETH"):
        payloads.save(spark, root, "chart", asset, '{"prices": []}')
        payloads.save(spark, root, "chart", asset, "{")
        stream()
    assert [r.symbol for r in kept] == ["BTC", "ETH"]
