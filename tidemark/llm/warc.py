"""WARC archives with an embedded Zstandard dictionary.

Each task writes archives of its own: a dictionary is built from the archive's records
and stored in a leading skippable frame, and every record is one frame compressed with
it, so that readers can seek to any record.  Equal payloads are stored once; the other
records of a payload are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm._store import materialize, new_path

#: Magic number of the skippable frame that holds a dictionary (fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D


@dataclass(frozen=True)
class Settings:
    archive_bytes: int = 64 << 20  # uncompressed records per archive, about
    dictionary_bytes: int = 65_536
    sample_bytes: int = 4 << 20  # of an archive's records, spread evenly, that its dictionary is built from
    level: int = 3
    min_bytes: int = 0  # payloads below this are never revisits


def _record(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    target = "".join(c for c in (url or "") if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def _dictionary(records: list[bytes], s: Settings) -> bytes:
    """Dictionary content from records spread over the archive; empty if there is too little to learn from."""
    total = sum(map(len, records))
    step = max(1, -(-total // s.sample_bytes))
    samples = [r[i : i + 8192] for r in records[::step] for i in range(0, len(r), 8192)]
    try:
        return zstandard.train_dictionary(min(s.dictionary_bytes, max(1024, total // 16)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(to: fs.FileSystem, path: str, records: list[bytes], s: Settings) -> int:
    """Write one archive under a name of its own, then move it in place; its bytes."""
    content = _dictionary(records, s)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    packer = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    with to.open_output_stream(own) as out:
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        for record in records:
            out.write(packer.compress(record))
        size = out.tell()
    to.move(own, path)
    return size


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of one archive, read as a stream."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    content = source.read(size) if size else b""
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    held, at, ended = b"", 0, False
    with unpacker.stream_reader(source, read_across_frames=True) as stream:
        while True:
            head = held.find(b"\r\n\r\n", at)
            if head >= 0:
                lines = held[at:head].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC record")
                headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
                end = head + 4 + int(headers["Content-Length"])
                if len(held) >= end + 4:
                    yield headers, held[head + 4 : end]
                    at = end + 4
                    continue
            if ended:
                if at < len(held):
                    raise ValueError("the archive ends within a record")
                return
            more = stream.read(4 << 20)
            held, at, ended = held[at:] + more, 0, not more


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_kinds(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`pages` (page_id, url, html) with digest, kind and refers_to.

    Of equal payloads of at least `min_bytes` bytes the record with the largest page_id
    is the response (several rows of that id: all of them), the others revisit it.  A
    null id is smaller than any other; a payload found only under null ids is a response.
    """
    html: Column = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    small = F.octet_length("html") < s.min_bytes
    owners = pages.where(~small).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").select("digest", "owner")
    revisit = (~small) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return pages.join(owners, "digest", "left").select("page_id", "url", "html", F.when(revisit, F.col("owner")).alias("refers_to"))


def write(pages: DataFrame, folder: str, s: Settings = Settings()) -> DataFrame:
    """Write the records of `pages` to archives in `folder`; (path, records, bytes) of each archive.

    Every attempt of a task writes under names of its own, as rows may come to it in another
    order; the list that is returned says which archives count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, root = fs.FileSystem.from_uri(folder)
        to.create_dir(root, recursive=True)
        part, held, size, n, out = TaskContext.get().partitionId(), [], 0, 0, []

        def close() -> None:
            nonlocal held, size, n
            if held:
                path = f"{root}/part-{part:06d}-{n:05d}-{uuid.uuid4().hex}.warc.zst"
                out.append((path, len(held), write_archive(to, path, held, s)))
                held, size, n = [], 0, n + 1

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                payload = html.encode("utf-8", "surrogatepass")
                revisit = refers_to is not None
                held.append(_record(page_id, url, "revisit" if revisit else "response", base32_sha1(payload), len(payload), refers_to, b"" if revisit else payload))
                size += len(held[-1])
                if size >= s.archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return materialize(record_kinds(pages, s).mapInArrow(run, "path string, records long, bytes long"), "warc-list")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives listed in `archives`; digests of stored payloads are checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def page(urn: str) -> int | None:
        number = urn.removeprefix("<urn:x-page:").removesuffix(">")
        return int(number) if number else None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with at.open_input_stream(path, compression=None) as source:
                    for head, payload in read_archive(source):
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: a payload does not match its digest")
                        refers_to = page(head["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind, refers_to, payload if payloads and kind == "response" else None))
                        if len(rows) == 2000:
                            yield table(rows)
                            rows = []
                yield table(rows)

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(run, READ)  # the list is small, the archives are not


def archive(spark: SparkSession, pages: DataFrame, s: Settings = Settings(), payloads: bool = False) -> DataFrame:
    """Write `pages` to archives in the shared folder and read their records back.

    A null html is an empty payload; a null url an empty target.  Columns beyond page_id, url
    and html are not archived.  An empty table gives no archive and no record.
    """
    folder = new_path(spark, "warc")
    return read(write(pages, folder, s), folder, payloads)


def op3(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base32 is not a DuckDB function: every five hex digits are four base32 digits.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
o AS (SELECT hex, max(page_id) AS owner, count(*) AS n FROM h GROUP BY hex),
d AS (
  SELECT page_id, payload_bytes, h.hex, CASE WHEN n > 1 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to FROM h JOIN o ON h.hex = o.hex)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, 1 + 5 * i::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to::BIGINT AS refers_to
FROM d
"""
