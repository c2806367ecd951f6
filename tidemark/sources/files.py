"""Small files and listings in any store that Spark reads, by the Hadoop file system of a path."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}  # folders of local applications that name none
_STATUS = re.compile(r"\w*FileStatus\{path=(?P<path>.*?); isDirectory=(?P<folder>true|false)(?:; length=(?P<size>\d+))?.*?; modification_time=(?P<time>\d+)")


class Files:
    """File operations below paths of one store; all of them run on the driver and touch names and small files only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._path = spark, spark._jvm.org.apache.hadoop.fs.Path
        path = self._path(root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = re.sub(r"^file:/+", "file:///", str(self._fs.makeQualified(path))).rstrip("/")

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, path: str, to: str) -> bool:
        return self._fs.rename(self._path(path), self._path(to))

    def create(self, path: str, text: str, overwrite: bool = False) -> bool:
        """Write a small file; False if there is one and it may not be overwritten."""
        try:
            out = self._fs.create(self._path(path), overwrite)
        except Exception as e:  # Java's exceptions have no Python classes of their own
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def listed(self, folder: str) -> list[tuple[str, bool, int, int]]:
        """(path, is a folder, bytes, milliseconds of the last change) of a folder's entries, or of a file."""
        if not self.exists(folder):
            return []
        found = (_STATUS.match(f.toString()) for f in self._fs.listStatus(self._path(folder)))  # one call for all that a status says
        return sorted((m["path"], m["folder"] == "true", int(m["size"] or 0), int(m["time"])) for m in found)

    def below(self, path: str) -> list[tuple[str, int, int]]:
        """(path, bytes, milliseconds of the last change) of all data files at or below a path."""
        out, folders = [], [path]
        while folders:
            for at, folder, size, time in self.listed(folders.pop()):
                if at.rpartition("/")[2].startswith(("_", ".")):
                    continue
                if folder:
                    folders.append(at)
                else:
                    out.append((at, size, time))
        return sorted(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and all of Spark is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return Files(spark, at).root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
