"""Daily bars that stay: a table partitioned by month and bucketed by symbol, with appends that merge.

Symbol windows over the table need no shuffle, as each bucket holds whole symbols, and a
history window reads its months alone.  A batch of bars is merged with the months that it
touches, and these are overwritten partition by partition.  The merged months are kept in a
journal until they are in place, so that a writer lost at any moment is made good by the
next, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.files import Files

#: `as_of` and `seq` say how recent a bar is; NULL is the least recent.
BARS = "symbol string, day date, price double, volume double, market_cap double, as_of timestamp, seq bigint"
_COLUMNS = tuple(c.split()[0] for c in BARS.split(", "))


def month_of(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


class BarStore:
    """Bars below `path`, in any store that Spark writes.  One writer at a time; readers see whole months.

    The number of buckets is fixed when the store is made: about the symbols' bytes in a month over
    a comfortable file size, and at least the tasks that a window over all symbols should have.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.files = spark, Files(spark, path)
        self.path = self.files.root
        layout = f"{self.path}/_layout.json"
        self.files.create(layout, json.dumps({"buckets": buckets}))
        self.buckets = json.loads(self.files.text(layout))["buckets"]
        self.name = f"bars_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({BARS}, month int) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY (month) CLUSTERED BY (symbol) SORTED BY (symbol, day) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        self.recover()

    # -- reading ----------------------------------------------------------------------------

    def read(self) -> DataFrame:
        """All bars (symbol, day, price, volume, market_cap)."""
        return self._table().select(*_COLUMNS[:5])

    def _table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # others may have written
        return self.spark.table(self.name)

    def months(self) -> list[int]:
        """The months that have bars, from the names of their folders."""
        names = (at.rpartition("/")[2] for at, folder, _, _ in self.files.listed(self.path) if folder)
        return sorted(int(n.removeprefix("month=")) for n in names if n.startswith("month="))

    def last_day(self) -> date | None:
        """The last day of the table, from the newest month alone."""
        for month in reversed(self.months()):
            day = self._table().where(F.col("month") == month).agg(F.max("day")).first()[0]
            if day is not None:
                return day
        return None

    def recent(self, days: int) -> DataFrame:
        """The bars of the last `days` calendar days; other months are not read."""
        last = self.last_day()
        if last is None:
            return self.read()
        low = last - timedelta(days=days - 1)
        table = self._table().where((F.col("month") >= low.year * 100 + low.month) & (F.col("day") >= F.lit(low)))
        return table.select(*_COLUMNS[:5])

    # -- writing ------------------------------------------------------------------------------

    def upsert(self, bars: DataFrame, batch: str | None = None) -> bool:
        """Add bars, or replace those of the same symbol and day that are not more recent; False if `batch` was added before.

        `bars` has symbol, day and price; volume, market_cap, as_of and seq are NULL where absent
        and further columns are ignored.  Of several bars for a symbol and day the one of greatest (as_of,
        seq) stays, then the one of the later batch, then the one of greatest price, volume and
        market_cap.  Bars without a symbol or day are left out.
        """
        self.recover()
        batch = batch or uuid.uuid4().hex
        if self.files.exists(self._mark(batch)):
            return False
        staged, journal = f"{self.path}/_staged/{batch}", self._journal(batch)
        kinds = dict(c.split() for c in BARS.split(", "))
        own = bars.select(*((F.col(c) if c in bars.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS))
        own = own.where("symbol is not null and day is not null").withColumn("month", month_of(F.col("day")))
        own.write.mode("overwrite").parquet(staged)
        new = self.spark.read.schema(f"{BARS}, month int").parquet(staged)
        months = [r["month"] for r in new.select("month").distinct().collect()]  # calendar months, however many bars
        if months:
            before = self._table().where(F.col("month").isin(months)).withColumn("fresh", F.lit(0))
            self._latest(before.unionByName(new.withColumn("fresh", F.lit(1)))).write.mode("overwrite").parquet(journal)
            self._put(batch)
        self.files.create(self._mark(batch), "")
        self.files.delete(journal)
        self.files.delete(staged)
        return True

    def recover(self) -> None:
        """Put in place what a lost writer had merged; what it had not finished merging goes."""
        for at, folder, _, _ in self.files.listed(f"{self.path}/_journal"):
            batch = at.rpartition("/")[2]
            if folder and not self.files.exists(self._mark(batch)) and self.files.exists(f"{at}/_SUCCESS"):
                self._put(batch)
                self.files.create(self._mark(batch), "")
            self.files.delete(at)

    def _journal(self, batch: str) -> str:
        return f"{self.path}/_journal/{batch}"

    def _mark(self, batch: str) -> str:
        return f"{self.path}/_applied/{batch}"

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        order = F.struct("as_of", "seq", "fresh", "price", "volume", "market_cap")
        kept = F.max_by(F.struct("price", "volume", "market_cap", "as_of", "seq"), order)
        return rows.groupBy("symbol", "day", "month").agg(kept.alias("kept")).select("symbol", "day", "kept.*", "month")

    def _put(self, batch: str) -> None:
        """Overwrite whole months with the journal's: each bucket of a month is written by one task."""
        merged = self.spark.read.schema(f"{BARS}, month int").parquet(self._journal(batch))
        bucket = F.pmod(F.hash("symbol"), F.lit(self.buckets))
        merged.repartition("month", bucket).select(*_COLUMNS, "month").write.mode("overwrite").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
