"""Results that are computed once: stored by what they were computed from, with a lifetime.

A result's key is a fingerprint of the query's name, its arguments and the names, sizes and
times of all files it reads, so a changed input is another result.  A manifest that appears
whole, by a rename, says where the rows are and which columns they have; reading it runs no
job.  Of callers that ask at the same time, in any process, one computes and the others wait.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.sources.files import Files

_computing: dict[str, threading.Lock] = {}  # by folder of a result, for the threads of this process
_guard = threading.Lock()


@dataclass
class Results:
    """Results below `root`.  `hours` is their lifetime; a lock that is older than `lease` seconds belongs to a lost caller.

    One call asks the store for each input file's status; nothing else grows with the input on a hit.
    """

    spark: SparkSession
    root: str
    hours: float = 1.0
    lease: float = 3600.0
    pause: float = 0.2
    clock: Callable[[], float] = time.time
    hits: int = field(default=0, init=False)
    misses: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.root)

    def fingerprint(self, name: str, arguments: Mapping[str, object], inputs: Sequence[str]) -> str:
        """Of the query, its arguments (JSON values) and the state of the files at or below `inputs`."""
        digest = hashlib.sha256(json.dumps([name, arguments], sort_keys=True).encode())
        for path in inputs:
            for entry in Files(self.spark, path).below(path):
                digest.update(json.dumps(entry).encode())
            digest.update(b"\n")
        return digest.hexdigest()

    def get(self, name: str, arguments: Mapping[str, object], inputs: Sequence[str], produce: Callable[[], DataFrame]) -> DataFrame:
        """The stored result, or what `produce` gives, which is stored.

        If inputs change while it is computed, the result belongs to the state before, and the
        next caller computes anew.  An error of `produce` is raised and stores nothing.
        """
        folder = f"{self.files.root}/{self.fingerprint(name, arguments, inputs)}"
        with _guard:
            own = _computing.setdefault(folder, threading.Lock())
        with own:
            while True:
                found = self._stored(folder)
                if found is not None:
                    self.hits += 1
                    return found
                if self._locked(folder):
                    break
                time.sleep(self.pause)
            try:
                found = self._stored(folder)  # whoever held the lock before may have stored it
                if found is None:
                    self.misses += 1
                    return self._store(folder, name, arguments, produce())
                self.hits += 1
                return found
            finally:
                self.files.delete(f"{folder}/_lock")

    def _locked(self, folder: str) -> bool:
        lock = f"{folder}/_lock"
        if self.files.create(lock, str(self.clock())):
            return True
        try:
            since = float(self.files.text(lock) or 0)
        except Exception:  # it went, or is being written: look again
            return False
        if self.clock() - since > self.lease:
            taken = f"{folder}/_lost-{uuid.uuid4().hex}"
            if self.files.rename(lock, taken):  # of several that find it lost, one renames it
                self.files.delete(taken)
        return False

    def _manifests(self, folder: str) -> list[tuple[float, str]]:
        names = (at for at, is_folder, _, _ in self.files.listed(folder) if not is_folder and at.endswith(".json"))
        return sorted((int(at.rpartition("/")[2].split("-")[0]) / 1000, at) for at in names if at.rpartition("/")[2][0].isdigit())

    def _stored(self, folder: str) -> DataFrame | None:
        for written, at in reversed(self._manifests(folder)):
            if 0 <= self.clock() - written <= self.hours * 3600:
                manifest = json.loads(self.files.text(at))
                return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{folder}/{manifest['rows']}")
        return None

    def _store(self, folder: str, name: str, arguments: Mapping[str, object], table: DataFrame) -> DataFrame:
        rows, schema = f"rows-{uuid.uuid4().hex}", table.schema
        table.write.parquet(f"{folder}/{rows}")
        manifest = {"query": name, "arguments": dict(arguments), "rows": rows, "schema": schema.jsonValue()}
        hidden = f"{folder}/_manifest-{uuid.uuid4().hex}"
        self.files.create(hidden, json.dumps(manifest))
        self.files.rename(hidden, f"{folder}/{int(self.clock() * 1000)}-{rows}.json")
        return self.spark.read.schema(schema).parquet(f"{folder}/{rows}")

    def count(self) -> int:
        """Results within their lifetime."""
        return sum(self._stored(at) is not None for at, folder, _, _ in self.files.listed(self.files.root) if folder)

    def expire(self) -> int:
        """Delete results beyond their lifetime; returns how many folders went."""
        old = [at for at, folder, _, _ in self.files.listed(self.files.root) if folder and self._stored(at) is None and not self.files.exists(f"{at}/_lock")]
        for at in old:
            self.files.delete(at)
        return len(old)

    def clear(self) -> int:
        """Delete all results; tables read from them must not be used any more."""
        folders = [at for at, folder, _, _ in self.files.listed(self.files.root) if folder]
        for at in folders:
            self.files.delete(at)
        return len(folders)
