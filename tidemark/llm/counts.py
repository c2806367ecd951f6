"""Token counts through a digest cache.

A text's count is stored under the digest of its normalised content and the digest of
the tokenizer's version.  Counting joins the documents' digests to the stored counts,
encodes each distinct text that has none once, and appends these counts to the cache.
Copies, within a run or between runs, are encoded once, and a changed tokenizer file or
library has counts of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm._store import Scratch, _qualified, _write, broadcast_up_to, new_path

_COUNTS = "digest binary, n_tokens long"
_SPACE = "▁"


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file (.model of sentencepiece, .json of tokenizers), read on the driver and sent to tasks whole (a few MB)."""

    kind: str
    data: bytes
    longest: int = 1 << 16  # characters that are encoded at a time, where a text can be cut

    @staticmethod
    def of(path: str) -> Tokenizer:
        kind = Path(path).suffix
        if kind not in (".model", ".json"):
            raise ValueError(f"{path} is neither a .model nor a .json file")
        return Tokenizer(kind, Path(path).read_bytes())

    def version(self) -> str:
        """The digest of all that counts depend on: the file, the library and its version."""
        import sentencepiece
        import tokenizers

        library = f"sentencepiece {sentencepiece.__version__}" if self.kind == ".model" else f"tokenizers {tokenizers.__version__}"
        return hashlib.sha256(library.encode() + b"\0" + self.data).hexdigest()

    def normalised(self, text: Column) -> Column:
        """The text in a form that equal token sequences share more often; its count is the text's.

        Null is empty and invalid UTF-8 is read as replacement characters.  A sentencepiece model
        that writes spaces as U+2581 cannot tell the two apart, so they become one.
        """
        text = F.coalesce(F.make_valid_utf8(text), F.lit(""))
        return F.replace(text, F.lit(_SPACE), F.lit(" ")) if self.kind == ".model" and _library(self).encode("a▁ b▁") == _library(self).encode("a  b ") else text

    def counts(self, texts: Sequence[str]) -> list[int]:
        """Tokens of each text, without begin, end or added special tokens."""
        if self.kind == ".json":
            return [len(e.ids) for e in _library(self).encode_batch(list(texts), add_special_tokens=False)]
        out, extra = [0] * len(texts), len(_library(self).encode("\n"))
        group, size = [], 0

        def close() -> None:
            for (i, _, later), ids in zip(group, _library(self).encode([p for _, p, _ in group], num_threads=1)):
                out[i] += len(ids) - extra * later
            group.clear()

        for i, text in enumerate(texts):
            for k, part in enumerate(self._parts(text)):
                # later parts of a cut text follow a line feed, which no piece joins to anything and whose own tokens are subtracted
                group.append((i, "\n" + part if k else part, k > 0))
                size += len(part)
                if size >= 1 << 20:
                    close()
                    size = 0
        close()
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """`text` cut after every `longest` characters or so, where no piece of the vocabulary holds the two characters that meet."""
        inside = _inside(self) if len(text) > self.longest else None
        low = 0
        if inside is not None:
            high = self.longest
            while high < len(text):
                if text[high - 1 : high + 1].replace(_SPACE, " ") in inside:
                    high += 1
                    continue
                yield text[low:high]
                low, high = high, high + self.longest
        yield text[low:]


@lru_cache(maxsize=4)
def _library(t: Tokenizer):
    if t.kind == ".model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=t.data)
    from tokenizers import Tokenizer as Library

    tokenizer = Library.from_buffer(t.data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _inside(t: Tokenizer) -> frozenset[str] | None:
    """Pairs of characters that stand side by side in some piece (a space for U+2581); None if texts must not be cut.

    Only a model that merges pairs of pieces and leaves texts as they are encodes parts on their own.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(t.data)
    pieces = [p for p in model.pieces if p.type in (1, 4, 5)]  # normal, user-defined and unused; not bytes and controls
    plain = model.normalizer_spec.name == "identity" and not model.normalizer_spec.remove_extra_whitespaces and model.trainer_spec.byte_fallback
    if model.trainer_spec.model_type != 2 or not plain or any(p.type == 4 or "\n" in p.piece for p in pieces):
        return None
    return frozenset(pair.replace(_SPACE, " ") for p in pieces for pair in map("".join, zip(p.piece, p.piece[1:])))


class CountCache:
    """Counts (digest, n_tokens) by tokenizer version, in folders of Parquet below `root`, one for each append.

    A batch counts once its write has ended; what a failed writer left is not read.
    Writers may run side by side: a digest that two of them add has the same count in both.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self, version: str) -> list[str]:
        path, system = _qualified(self.spark, f"{self.root}/{version}/*/_SUCCESS")
        return sorted(str(f.getPath().getParent()) for f in system.globStatus(path) or [])

    def read(self, version: str) -> DataFrame:
        """One row for each digest."""
        found = self.batches(version)
        rows = self.spark.read.schema(_COUNTS).parquet(*found) if found else self.spark.createDataFrame([], _COUNTS)
        return rows if len(found) < 2 else rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, version: str, counts: DataFrame) -> DataFrame:
        """Store counts, one row a digest; returns them as stored."""
        return _write(counts, f"{self.root}/{version}/{uuid.uuid4().hex}")

    def compact(self, version: str) -> None:
        """Put all batches of a version into one.  Nothing else may read the cache meanwhile."""
        old = self.batches(version)
        if len(old) > 1:
            self.append(version, self.read(version))
            for at in old:
                path, system = _qualified(self.spark, at)
                system.delete(path, True)


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: CountCache, keep: Sequence[str] = ("doc_id",), most_broadcast: int = 500_000) -> DataFrame:
    """(`keep`..., n_bytes, n_tokens) for each row of `docs`, its `text` counted whole.

    n_bytes are UTF-8 bytes; a null text is empty and has no tokens.  Rows that repeat stay,
    an empty table gives an empty one, and columns that are not kept are ignored.  The text of
    a miss is shuffled once, after each task has kept one of its copies; all other shuffles move
    digests.  Up to `most_broadcast` missing digests (16 MB) go to the texts by broadcast, more
    by a join in the texts' own shuffle.
    """
    spark, version = docs.sparkSession, tokenizer.version()
    store = Scratch(spark)
    normal = tokenizer.normalised(F.col("text"))
    digest = F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    keyed = store.write(docs.select(F.struct(*keep).alias("row"), digest, size), "tokens-digests")
    needed = keyed.select("digest").distinct().join(cache.read(version), "digest", "left")
    needed = store.write(needed, "tokens-needed")
    missing, n = needed.where("n_tokens is null").select("digest"), needed.count()
    misses = missing.count()
    counts = needed.where("n_tokens is not null")
    if misses:
        texts = docs.select(digest, normal.alias("normal"))
        if misses < n and misses <= most_broadcast:
            texts = texts.join(broadcast_up_to(missing, misses, most_broadcast), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.any_value("normal").alias("normal"))  # each task keeps one copy first
        if most_broadcast < misses < n:
            texts = texts.join(missing, "digest", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(tokenizer.counts(batch["normal"].to_pylist()), pa.int64())], ["digest", "n_tokens"])

        counts = counts.unionByName(cache.append(version, texts.mapInArrow(run, _COUNTS)))
    # a digest may belong to a third of all rows: it has one count, so Spark can split its rows
    return keyed.join(counts, "digest").select("row.*", "n_bytes", "n_tokens")


def op12(spark, sf_dir: str) -> DataFrame:
    """Counts over a cache of its own, empty at first, so that each run encodes every distinct text of its table once."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, Tokenizer.of(public_tokenizers.path("piece_bpe_32k.model")), CountCache(spark, new_path(spark, "token-counts")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
