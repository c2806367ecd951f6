"""All feeds of a market in one bundle, each with where its rows come from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.config import CRYPTO_ASSETS
from tidemark.operators.returns import price_matrix
from tidemark.sources.feeds import provenance, with_fallback

#: Feeds by what the status table calls them (fixed values).
FEEDS = {"crypto": "Crypto (CoinGecko)", "macro": "Macro (Yahoo Finance)", "sentiment": "Sentiment (Fear & Greed)", "onchain": "On-chain (Blockchain.info)"}

Load = Callable[[], DataFrame]


@dataclass(frozen=True)
class Bundle:
    """Tables of one load: bars, their price matrix, macro levels, sentiment and on-chain counts; each with a `source`, but for the matrix."""

    bars: DataFrame
    prices: DataFrame
    macro: DataFrame
    sentiment: DataFrame
    onchain: DataFrame

    @property
    def sources(self) -> DataFrame:
        """(feed, source): the status of every feed."""
        parts = [provenance(getattr(self, "bars" if k == "crypto" else k)).select(F.lit(name).alias("feed"), "source") for k, name in FEEDS.items()]
        return reduce(DataFrame.unionByName, parts)

    @property
    def asset_sources(self) -> DataFrame:
        """(symbol, source) of each asset's bars."""
        return self.bars.groupBy("symbol").agg(F.first("source").alias("source"))

    @property
    def not_live(self) -> DataFrame:
        """(symbol) of assets whose bars are not live."""
        return self.asset_sources.where("source <> 'live'").select("symbol")


def load_assets(fetch: Callable[[str, str], DataFrame], fallback: Callable[[str], DataFrame], assets: Mapping[str, str] = CRYPTO_ASSETS, simulated: bool = False) -> DataFrame:
    """Bars with `source` of every asset: `fetch(provider id, symbol)`, or where that fails `fallback(symbol)`.

    With `simulated` nothing is fetched.  No assets are an error.
    """
    if not assets:
        raise ValueError("no assets")
    parts = [with_fallback(lambda i=i, s=s: fetch(i, s), lambda s=s: fallback(s), simulated) for i, s in assets.items()]
    return reduce(DataFrame.unionByName, parts)


def load_market(bars: DataFrame, macro: tuple[Load, Load], sentiment: tuple[Load, Load], onchain: tuple[Load, Load], simulated: bool = False) -> Bundle:
    """The bundle of loaded bars and three feeds, each given as (fetch, fallback); a feed that fails is its fallback."""
    rest = [with_fallback(*feed, simulated) for feed in (macro, sentiment, onchain)]
    return Bundle(bars, price_matrix(bars), *rest)
