"""Attribute lookups by key: vectors, dense ids, weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from xmseq.model import IID, ITEM, MARKET, VECTOR
from xmseq.operators.matrix import to_lists
from xmseq.operators.vector_store import Source, write_ranges
from xmseq.storage import BROADCAST_BYTES, SMALL_ROWS, fits, pin, vector_table_bytes

HOT_KEYS = 1024
CELLS = 1 << 21


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", small: bool | None = None) -> DataFrame:
    """Join a table of one row per key. Broadcast if rows and bytes are few (checked).

    Larger tables of numbers are mapped from the shared folder by the tasks of `df`, others, or where that cannot be, are
    shuffled with hot keys apart.
    """
    small = fits(table, SMALL_ROWS, BROADCAST_BYTES) if small is None else small
    if small:
        return df.join(F.broadcast(table), list(on), how)
    mapped = mapped_rows(df, table, on, how)
    return spread_lookup(df, table, on, how) if mapped is None else mapped


def mapped_rows(df: DataFrame, table: DataFrame, on: Sequence[str], how: str) -> DataFrame | None:
    """`df` with the numbers that `table` holds for its keys, read by the tasks of `df`; None if they cannot be mapped.

    The dictionary lies in files sorted by the hash of the key, with the key itself beside it: an unknown key is told from a
    known one even if their hashes are equal. Whole numbers up to 2^53 and doubles come back as they were, nulls as nulls.
    """
    values = [f for f in table.schema.fields if f.name not in on]
    if how not in ("left", "inner") or not values or not all(isinstance(f.dataType, T.NumericType) for f in values):
        return None
    if any(isinstance(f.dataType, T.DecimalType) for f in values) or {f.name for f in values} & set(df.columns):
        return None
    key = key_text(on)
    numbers = F.array(*(F.coalesce(F.col(f.name).cast("double"), F.lit(float("nan"))) for f in values))
    source = write_ranges(table.select(key.alias("_key"), numbers.alias("_row")).dropna(subset=["_key"]), "_key", "_row")
    if source is None:
        return None
    found = mapped_lookup(df.withColumn("_key", key), source, "_key", T.StructField("_row", T.ArrayType(T.DoubleType())))
    found = found.where("_row is not null") if how == "inner" else found
    read = [F.get("_row", F.lit(i)) for i in range(len(values))]
    columns = [F.when(~F.isnan(x), x).cast(f.dataType).alias(f.name) for x, f in zip(read, values, strict=True)]
    rest = [c for c in df.columns if c not in on]
    return found.select(*on, *rest, *columns)


def key_text(on: Sequence[str]) -> Column:
    """A key as one text. Its parts are told apart by their lengths; a key with a missing part has none and is found nowhere."""
    texts = [F.col(c).cast("string") for c in on]
    return F.concat(*(x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)))


def lookup_vectors_by(df: DataFrame, table: DataFrame, on: Sequence[str], vector: str, small: bool) -> DataFrame:
    """`lookup` of a table of (key, vector): above the broadcast limit the tasks of `df` map the vectors, and no row is moved.

    Keys that occur twice, and vectors that differ in width or lack a number, cannot be mapped and are joined.
    """
    if small or not one_per_key(table, on, vector):
        return lookup(df, table, on, "left", small)
    filed = table.select(key_text(on).alias("_key"), vector)
    source = write_ranges(filed.dropna(), "_key", vector)
    if source is None:
        return lookup(df, table, on, "left", False)
    return mapped_lookup(df.withColumn("_key", key_text(on)), source, "_key", table.schema[vector]).drop("_key")


def one_per_key(table: DataFrame, on: Sequence[str], vector: str) -> bool:
    known = table.dropna()
    lacks = F.max(F.exists(vector, lambda x: x.isNull()))
    narrow, wide, lacking = known.agg(F.min(F.size(vector)), F.max(F.size(vector)), lacks).first()
    return narrow == wide and not lacking and table.dropna(subset=list(on)).groupBy(*on).count().where("count > 1").isEmpty()


def lookup_vectors(
    df: DataFrame, vectors: DataFrame, on: str = ITEM, vector: str = VECTOR, limit_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Vector of the id in `on`; NULL if it has none.

    Above the broadcast limit the tasks of `df` map the vectors from the shared folder, where that can be; ids then must
    not occur twice.
    """
    table = vectors.select(F.col(ITEM).alias(on), F.col(VECTOR).alias(vector))
    small = vector_table_bytes(table, vector) <= limit_bytes
    source = None if small else write_ranges(table.dropna(), on, vector)
    return lookup(df, table, [on], "left", small) if source is None else mapped_lookup(df, source, on, table.schema[vector])


def side_by_side(df: DataFrame, on: str) -> DataFrame:
    """`df` with the rows of an id behind one another, for a result that repeats what a lookup finds for it.

    Files then hold such values next to each other and pack them; strewn over the files each row takes their full size. An id
    with very many rows is spread over several tasks. Stored, since Spark drops a sort that it finds beneath a join.
    """
    return pin(df.hint("rebalance", on).sortWithinPartitions(on), "side-by-side")


def mapped_lookup(df: DataFrame, source: Source, on: str, field: T.StructField) -> DataFrame:
    """`df` and the vector of the id in `on`, read by the tasks of `df` where they are."""
    schema = T.StructType([*df.schema.fields, T.StructField(field.name, field.dataType)])
    kind = to_arrow_schema(schema).field(field.name).type

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = source.reader()
        step = max(1, CELLS // max(source.width, 1))
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                values, known = read(part.column(on))
                rows = np.cumsum(known) - 1
                found = to_lists(values[known]).cast(kind) if known.any() else pa.array([], kind)
                column = found.take(pa.array(rows, mask=~known))
                yield pa.RecordBatch.from_arrays([*part.columns, column], schema.names)

    return df.mapInArrow(add, schema)


def spread_lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Shuffled lookup in which no key can fill a task.

    A key with more than 1/hot_keys of the rows is hot; there are fewer than `hot_keys` of them, so their table rows are
    broadcast, and their rows and those with a missing key stay where they are. The rest are shuffled.
    """
    on = list(on)
    counts = pin(df.groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") * hot_keys > total).dropna(subset=on).select(*on)
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    stays = F.col("_hot").isNotNull() | missing
    hot_table = table.join(F.broadcast(hot), on, "left_semi")
    kept = marked.where(stays).drop("_hot").join(F.broadcast(hot_table), on, how)
    moved = marked.where(~stays).drop("_hot").join(table, on, how)
    return kept.unionByName(moved)


def padding_rows(ids: DataFrame) -> DataFrame:
    """Id 0 of each market, without an item."""
    nothing = F.lit(None).cast(ids.schema[ITEM].dataType)
    return ids.select(MARKET).distinct().select(MARKET, nothing.alias(ITEM), F.lit(0).cast("bigint").alias(IID))


def dense_items(ids: DataFrame, vectors: DataFrame, include_padding: bool = False) -> DataFrame:
    """Features by dense id: every id of every market with its vector, NULL where there is none."""
    rows = ids.select(MARKET, ITEM, IID)
    if include_padding:
        rows = rows.unionByName(padding_rows(ids))
    return rows.join(vectors.select(ITEM, VECTOR), ITEM, "left").select(MARKET, IID, ITEM, VECTOR)
