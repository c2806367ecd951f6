"""Snapshots of feeds with a lifetime: Parquet below one root, read and written by Spark."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import DEFAULT


class Snapshots:
    """`root` may be in any store that Spark reads.  A snapshot is a folder named by key and time of writing."""

    def __init__(self, spark: SparkSession, root: str, hours: float = DEFAULT.cache_hours, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.hours, self.clock = spark, root.rstrip("/"), hours, clock
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self, key: str | None = None) -> list[tuple[float, str]]:
        found = self._fs.globStatus(self._path(f"{self.root}/{hashlib.md5(key.encode()).hexdigest() if key else '*'}-*")) or []
        paths = [str(f.getPath()) for f in found if self._fs.exists(self._path(str(f.getPath()) + "/_SUCCESS"))]
        return sorted((int(p.rpartition("-")[2]) / 1000, p) for p in paths)

    def load(self, key: str) -> DataFrame | None:
        """The newest snapshot within its lifetime; None if there is none or it cannot be read."""
        for written, path in reversed(self._entries(key)):
            if self.clock() - written <= self.hours * 3600:
                try:
                    return self.spark.read.parquet(path)
                except Exception:  # an unreadable snapshot is a miss
                    continue
        return None

    def save(self, key: str, table: DataFrame) -> DataFrame:
        path = f"{self.root}/{hashlib.md5(key.encode()).hexdigest()}-{int(self.clock() * 1000)}"
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def cached(self, key: str, produce: Callable[[], DataFrame]) -> DataFrame:
        """The snapshot, or what `produce` gives, which is kept unless it is a sample."""
        found = self.load(key)
        if found is not None:
            return found
        table = produce()
        if "source" in table.columns and not table.where("source = 'sample'").isEmpty():
            return table
        return self.save(key, table)

    def clear(self) -> int:
        entries = self._entries()
        for _, path in entries:
            self._fs.delete(self._path(path), True)
        return len(entries)

    def count(self) -> int:
        return len(self._entries())
