"""Cleaning and joining of market interactions and item metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmseq.functions.dates import epoch_seconds
from xmseq.functions.text import joined_text
from xmseq.model import DESCRIPTION, ITEM, ITEM_KEY, MARKET, TEXT, TIME, TITLE, USER
from xmseq.storage import pin


def item_text(meta: DataFrame, item: str = ITEM, strict: bool = False) -> DataFrame:
    """One text per metadata row: title, a blank, the first description. strict=True raises on a missing title."""
    title: Column = F.col(TITLE)
    if strict:
        title = F.coalesce(title, F.raise_error(F.concat(F.lit("no title: "), F.col(item))).cast("string"))
    return meta.select(F.col(item), joined_text(title, DESCRIPTION).alias(TEXT))


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by `order`. An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(first).select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_items(meta: DataFrame, items: DataFrame, item: str = ITEM) -> DataFrame:
    """Metadata rows whose item is in `items`."""
    return meta.join(items.select(item), item, "left_semi")


def to_interactions(
    df: DataFrame, user: str = "userId", item: str = "itemId", date: str = "date", strict: bool = True
) -> DataFrame:
    """Market, user, item and epoch seconds; whatever else the source holds is dropped."""
    return df.select(
        F.col(MARKET),
        F.col(user).alias(USER),
        F.col(item).alias(ITEM),
        epoch_seconds(date, strict).alias(TIME),
    )


def market_item_sets(inter: DataFrame) -> DataFrame:
    """Distinct (market, item)."""
    return inter.select(*ITEM_KEY).distinct()


def all_items(inter: DataFrame) -> DataFrame:
    """Union of the markets' item sets."""
    return inter.select(ITEM).distinct()


def market_items(vectors: DataFrame, inter: DataFrame) -> DataFrame:
    """Per market, the vectors of its own items; one pass for all markets."""
    return market_item_sets(inter).join(vectors, ITEM).select(MARKET, *vectors.columns)


def coverage_report(items: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: items, items without metadata, items with several rows, missing titles and descriptions."""
    per_item = meta.groupBy(ITEM).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(TITLE).isNull()).alias("no_title"),
        F.count_if(F.col(DESCRIPTION).isNull()).alias("no_description"),
    )
    return (
        items.select(ITEM)
        .distinct()
        .join(per_item, ITEM, "left")
        .agg(
            F.count("*").alias("n_items"),
            F.count_if(F.col("rows").isNull()).alias("n_missing"),
            F.count_if(F.col("rows") > 1).alias("n_duplicated"),
            F.coalesce(F.sum("no_title"), F.lit(0)).alias("n_no_title"),
            F.coalesce(F.sum("no_description"), F.lit(0)).alias("n_no_description"),
        )
    )


def missing_items(items: DataFrame, meta: DataFrame) -> DataFrame:
    """Items without a metadata row."""
    return items.select(ITEM).distinct().join(meta.select(ITEM), ITEM, "left_anti")


def require_coverage(items: DataFrame, meta: DataFrame, show: int = 5) -> None:
    """Raise, naming a few ids, unless every item has metadata."""
    ids = [str(r[0]) for r in missing_items(items, meta).take(show)]
    if ids:
        raise ValueError(f"items without metadata, e.g. {', '.join(ids)}")


def market_stats(inter: DataFrame) -> DataFrame:
    """Rows, users, items and events per user of each market, exact.

    Users and items are counted first, so a market holding most rows is never one task's work.
    """
    users = inter.groupBy(MARKET, USER).agg(F.count("*").alias("n"))
    by_user = users.groupBy(MARKET).agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_users"),
        F.min("n").alias("min_events"),
        F.max("n").alias("max_events"),
    )
    by_item = market_item_sets(inter).groupBy(MARKET).agg(F.count("*").alias("n_items"))
    return by_user.join(by_item, MARKET).withColumn("avg_events", F.col("n_rows") / F.col("n_users"))


def market_overlap(inter: DataFrame, column: str = ITEM) -> DataFrame:
    """Shared items (or users) and Jaccard index of every two markets.

    Items are first grouped by the set of markets they occur in; pairs are formed per distinct set, never per item.
    """
    sets = pin(
        inter.select(MARKET, column)
        .groupBy(column)
        .agg(F.array_sort(F.collect_set(MARKET)).alias("markets"))
        .groupBy("markets")
        .agg(F.count("*").alias("n")),
        "market-sets",
    )
    one = sets.select(F.explode("markets").alias("a"), "markets", "n")
    pair = one.select("a", F.explode("markets").alias("b"), "n").where(F.col("a") <= F.col("b"))
    both = pair.groupBy("a", "b").agg(F.sum("n").alias("n_common"))
    own = both.where(F.col("a") == F.col("b"))
    # One row holding the list of markets and their sizes; its length is the number of markets.
    markets = own.agg(F.array_sort(F.collect_list(F.struct("a", F.col("n_common").alias("n")))).alias("m"))
    every = markets.select(F.explode("m").alias("x"), "m").select(
        "x", F.explode(F.filter("m", lambda y: y["a"] > F.col("x")["a"])).alias("y")
    )
    every = every.select(
        F.col("x.a").alias("a"), F.col("y.a").alias("b"), (F.col("x.n") + F.col("y.n")).alias("n_both")
    )
    common = F.coalesce("n_common", F.lit(0))
    return every.join(both, ["a", "b"], "left").select(
        F.col("a").alias("market_a"),
        F.col("b").alias("market_b"),
        common.alias("n_common"),
        (common / (F.col("n_both") - common)).alias("jaccard"),
    )
