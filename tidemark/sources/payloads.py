"""Raw feed responses as stored, one a line below <root>/feed=<feed>/asset=<asset>/, and their reading by Spark's own text source.

Batch and stream read the same folders; a stream's checkpoint remembers which files it has read.  Bodies
stay text until a query asks for their fields, so a response that cannot be read harms no other and is counted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import feeds
from tidemark.sources.files import Files

RAW = "value string, feed string, asset string"


def save(spark: SparkSession, root: str, feed: str, asset: str, body: str) -> str:
    """Store one response, as the driver has fetched it; returns the file's path."""
    path = f"{root.rstrip('/')}/feed={feed}/asset={asset}/{uuid.uuid4().hex}.json"
    Files(spark, root).create(path, body.replace("\r", " ").replace("\n", " ") + "\n")  # in JSON a line break is a space
    return path


def save_all(responses: DataFrame, root: str) -> None:
    """Store many responses (feed, asset, value), without line breaks inside."""
    rows = responses.select("feed", "asset", F.translate("value", "\r\n", "  ").alias("value"))
    rows.write.mode("append").partitionBy("feed", "asset").text(root)


def raw(spark: SparkSession, root: str) -> DataFrame:
    """(value, feed, asset): a row for each response; feed and asset prune folders."""
    return spark.read.schema(RAW).text(root)


def raw_stream(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """`raw` as a stream of the responses that come."""
    return spark.readStream.schema(RAW).options(**options).format("text").load(root)


def parsed(responses: DataFrame, schema: str) -> DataFrame:
    """(feed, asset, payload, corrupt): `payload` by `schema` (DDL), NULL and `corrupt` where a body is not JSON of that kind."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    body = F.from_json("value", f"{schema}, _corrupt string", options)
    rows = responses.select("feed", "asset", body.alias("body"))
    corrupt = F.col("body").isNull() | F.col("body._corrupt").isNotNull()
    return rows.select("feed", "asset", F.when(~corrupt, F.col("body").dropFields("_corrupt")).alias("payload"), corrupt.alias("corrupt"))


def _fields(schema: str, *left_out: str) -> str:
    return ", ".join(f"{name} {kind}" for name, _, kind in (c.strip().partition(" ") for c in _split(schema)) if name not in left_out)


def _split(schema: str) -> list[str]:
    """The columns of a DDL schema: commas within brackets do not divide."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


#: By feed: the fields of a response.  A chart's symbol and a chain's metric are the asset it is stored under.
FIELDS = {"chart": _fields(feeds.CHART, "symbol"), "sentiment": feeds.FEAR_GREED, "chain": _fields(feeds.CHAIN, "metric")}


def responses(rows: DataFrame, feed: str) -> DataFrame:
    """The readable responses of a feed in the form that `feeds` takes, with their asset."""
    known = parsed(rows.where(F.col("feed") == feed), FIELDS[feed]).where("not corrupt")
    return known.select("asset", "payload.*").withColumnRenamed("asset", {"chart": "symbol", "chain": "metric"}.get(feed, "asset"))


def chart_bars(rows: DataFrame) -> DataFrame:
    return feeds.chart_bars(responses(rows, "chart"))


def sentiment(rows: DataFrame) -> DataFrame:
    return feeds.sentiment(responses(rows, "sentiment"))


def onchain(rows: DataFrame) -> DataFrame:
    return feeds.onchain(responses(rows, "chain"))


def health(rows: DataFrame) -> DataFrame:
    """(feed, asset, responses, corrupt): how many responses there are and how many cannot be read."""
    counts = None
    for feed, fields in FIELDS.items():
        own = parsed(rows.where(F.col("feed") == feed), fields).select("feed", "asset", "corrupt")
        counts = own if counts is None else counts.unionByName(own)
    return counts.groupBy("feed", "asset").agg(F.count("*").alias("responses"), F.count_if("corrupt").alias("corrupt"))
