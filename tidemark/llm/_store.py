"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

_own: dict[str, str] = {}  # folders of local applications that name none
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _qualified(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with its file system.

    Where that is unset, a new temporary folder if all of Spark is this one process (tests);
    on a cluster that would be out of the executors' reach, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    path, system = _qualified(spark, at)
    return re.sub(r"^file:/+", "file:///", str(system.makeQualified(path))).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write under settings of its own: Arrow batches are bounded by bytes, so that long texts come few at a time,
    and Spark deletes the write's shuffle files when it ends, as nothing reads them again.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def given_back(out=None):
    """`out`, after what Arrow's pool and, where it can be asked (glibc), the C heap hold without using it has gone back to the system.

    Python workers outlive their tasks, and allocators keep what was freed: 40 to 100 MB a worker, beside the workers that work.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches whose worker gives freed memory back when the task ends."""

    @wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        given_back()

    return call


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    return _write(df, new_path(df.sparkSession, label))


class Scratch:
    """Stored tables of one run of an operator; those that nothing reads any more are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        out = _write(df, path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, system = _qualified(self.spark, self.paths.pop(id(table))[1])
            system.delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Drop all but these."""
        kept = {id(t) for t in tables}
        self.drop(*(t for k, (t, _) in list(self.paths.items()) if k not in kept))


def numbered(df: DataFrame, label: str) -> DataFrame:
    """`df` written with a number `rid` for each row.

    A row's place in a scan depends on how the files are split at that moment, so a number
    that several jobs join by must be a stored column.
    """
    return materialize(df.withColumn("rid", F.monotonically_increasing_id()), label)


def blocked(df: DataFrame, label: str, store: Scratch, text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """`df` written with a number `rid` for each row and one for each `block` of consecutive rows.

    A block holds whole rows, of `block_bytes` of text at most or of a single row.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, block, size = TaskContext.get().partitionId() << 33, -1, 0
        for batch in batches:
            blocks = np.empty(batch.num_rows, np.int64)
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()):
                if block < 0 or size + n > block_bytes:
                    block, size = rid + i, 0
                blocks[i] = block
                size += n
            rids = rid + np.arange(batch.num_rows)
            rid += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rids), pa.array(blocks)], [*batch.schema.names, "rid", "block"])

    df = df.drop("rid", "block")
    schema = StructType([*df.schema.fields, StructField("rid", LongType()), StructField("block", LongType())])
    return store.write(df.mapInArrow(run, schema), label)


def broadcast_up_to(df: DataFrame, rows: int, most: int) -> DataFrame:
    """`df` marked for a broadcast join if its counted `rows` are at most `most`; else Spark shuffles both sides."""
    return df.hint("broadcast") if rows <= most else df


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of largest `n` (at least 1), at most `most` of them.

    Whole steps of the logarithm of `n` are taken, the last one left out if it does not fit,
    so that only a count for each step reaches the driver before the rows themselves do.
    """
    step = F.floor(F.log2("n") * 16)
    sizes = dict(table.groupBy(step).count().collect())  # at most 16 * 64 steps
    low, total = None, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        low = k
    return table.where(F.lit(False)) if low is None else table.where(step >= low)
