"""From raw files to prepared tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from xmseq.model import ITEM, MARKET, MARKETS
from xmseq.operators.prep import (
    all_items,
    dedup_first,
    item_text,
    keep_items,
    market_items,
    require_coverage,
    to_interactions,
)
from xmseq.operators.vectors import text_vectors
from xmseq.sinks.export import export_inter, export_items, export_vectors
from xmseq.sources.prepared import read_vectors
from xmseq.sources.raw import FILE_ORDER, read_markets, read_metadata
from xmseq.storage import pin


def selected_metadata(meta: DataFrame, inter: DataFrame, order: Sequence[str] = tuple(FILE_ORDER)) -> DataFrame:
    """The first metadata row of each item of any market; raises if an item has none."""
    items = all_items(inter)
    chosen = pin(dedup_first(keep_items(meta, items), [ITEM], order), "metadata")
    require_coverage(items, chosen)
    return chosen


def prepare(
    spark: SparkSession,
    market_dir: str,
    metadata_path: str,
    out_dir: str,
    markets: Sequence[str] = MARKETS,
    dim: int = 768,
    encoder: Callable | None = None,
) -> None:
    """Read market files and metadata, make item vectors, write the vector file and each market's tables.

    Interactions and vectors are pinned once and serve all markets.
    """
    inter = pin(to_interactions(read_markets(spark, market_dir, markets)), "interactions", MARKET)
    texts = item_text(selected_metadata(read_metadata(spark, metadata_path), inter), strict=True)
    export_vectors(text_vectors(texts, dim, encoder), f"{out_dir}/item_emb.csv")
    items = pin(market_items(read_vectors(spark, f"{out_dir}/item_emb.csv"), inter), "market-items", MARKET)
    for market in markets:
        export_inter(inter, out_dir, market)
        export_items(items, out_dir, market)
