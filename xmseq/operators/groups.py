"""Numbering rows within groups of any size.

A window puts a whole group into one task. That is right for ordinary users and wrong for one who holds a third of all
rows, so groups above a row limit take a second, equally exact way: range partitions cut through the group, rows are
numbered within each partition, and the rows before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.storage import BROADCAST_BYTES, SMALL_ROWS, fits, pin

HOT_ROWS = 2_000_000
COPY_BLOCK = 10_000


def total_order(df: DataFrame, first: Sequence[str], skip: Sequence[str]) -> list[str]:
    """`first`, then every other sortable column: rows still tied are equal, so numbers depend on the data only."""
    sortable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [*first, *[c for c in sortable if c not in first and c not in skip]]


def same(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """`other` with its keys renamed, and the condition that the keys of `df` equal them, a missing one included."""
    condition = F.lit(True)
    for k in keys:
        other = other.withColumnRenamed(k, f"_same_{k}")
        condition = condition & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return other, condition


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int | None
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups up to `hot_rows` rows; those of larger ones (None if there are none) and how many they are.

    hot_rows=None says that no group is large.
    """
    if hot_rows is None:
        return df, None, 0
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    if large.isEmpty():
        return df, None, 0
    large = pin(large, "hot-groups")
    n = large.agg(F.sum("_n")).first()[0]
    other, equal = same(df, large.select(*keys), keys)
    # Each has more than `hot_rows` rows, so there are few: rows are told apart where they are, not in one task per key.
    other = F.broadcast(other) if fits(other, SMALL_ROWS, BROADCAST_BYTES) else other
    return df.join(other, equal, "left_anti"), df.join(other, equal, "left_semi"), n


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: str,
    total: str,
    parts: int,
    distinct: bool = False,
) -> DataFrame:
    """Number rows 1.. within each group by `order`, and give the group's row count, without a task per group.

    `parts` range partitions share the rows. `keys` and `order` together must cover all columns that tell rows apart;
    `distinct` says that no two rows are equal.
    """
    copies = df.withColumn("_copies", F.lit(1)) if distinct else df.groupBy(*df.columns).agg(
        F.count("*").alias("_copies")
    )
    ranges = copies.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = pin(ranges, "ranges")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    upto = ranged.withColumn("_upto", F.sum("_copies").over(inside))
    # One row per group and range it touches: few per group, however large it is.
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_copies").alias("_rows"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias(total),
    )
    last = F.col("_before") + F.col("_upto")
    starts, equal = same(upto, starts, [*keys, "_range"])
    numbered = upto.join(starts, equal)
    if distinct:
        return numbered.withColumn(number, last).select(*df.columns, number, total)
    # Copies are spread again in blocks, so that many of one row do not come out of one task.
    numbered = numbered.withColumn("_first", last - F.col("_copies") + 1)
    blocks = numbered.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {COPY_BLOCK}")))
    ).repartition(*keys, "_first", "_block")
    start = F.col("_first") + F.col("_block") * COPY_BLOCK
    end = F.least(start + (COPY_BLOCK - 1), F.col("_first") + F.col("_copies") - 1)
    return blocks.withColumn(number, F.explode(F.sequence(start, end))).select(*df.columns, number, total)
