"""Scores of candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.functions.vectors import dot
from xmseq.model import IID, ITEM, MARKET, PHASE, USER, VECTOR
from xmseq.operators.lookup import dense_items, lookup_vectors
from xmseq.operators.matrix import collect_id_rows, collect_matrix, to_lists, to_matrix, with_zeros
from xmseq.operators.vector_store import write_ranges
from xmseq.storage import BROADCAST_BYTES, at_most, numbered, vector_table_bytes

SEQ_VECTOR = "seq_emb"
CANDIDATES = "candidates"
SCORES = "scores"
DIGITS = 9
CELLS = 1 << 21
#: Numbers of mapped vectors that are multiplied at once: they stay in a core's cache.
MAPPED_CELLS = 1 << 17
ROW_BLOCK = 50_000
BLOCK_BYTES = 1 << 20
ROW = "_row"
#: Markets whose first numbers travel with the job.
MOST_MARKETS = 10_000


def score_pairs(pairs: DataFrame, vectors: DataFrame, on: str = ITEM, digits: int | None = DIGITS) -> DataFrame:
    """Score of each (sequence vector, item) row: dot product in double, NULL for an item without vector."""
    found = lookup_vectors(pairs, vectors, on, "_vector")
    score = dot(SEQ_VECTOR, "_vector")
    return found.withColumn("score", score if digits is None else F.round(score, digits)).drop("_vector")


def score_candidates(
    rows: DataFrame,
    ids: DataFrame,
    vectors: DataFrame,
    key: Sequence[str] = (MARKET, USER, PHASE),
    digits: int = DIGITS,
    limit_bytes: int = BROADCAST_BYTES,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """Scores parallel to the array of candidates, dense ids of the row's market.

    A candidate scores 0 if its market or id is unknown or its item has no vector; a null array of candidates has a null
    one of scores. Small dictionary and vectors (checked) are broadcast and the candidates never leave their row. Beyond
    that the tasks map the vectors, filed once by item, and a dictionary of their places by dense id from the shared folder,
    and no row is shuffled. Where that cannot be, the items are cut into blocks by dense id: a row sends its vector once to each block that holds candidates of it,
    and only scores come back. Rows keep a number of their own, so `key` need not tell them apart.
    """
    matrix = collect_matrix(vectors, limit_bytes=limit_bytes)
    id_rows = matrix and collect_id_rows(ids, matrix, limit_bytes // 64)
    if id_rows is None:
        mapped = _score_mapped(rows, ids, vectors, digits)
        return _score_by_blocks(rows, dense_items(ids, vectors), digits, limit_bytes, row_block) if mapped is None else mapped
    shared = rows.sparkSession.sparkContext.broadcast((id_rows, with_zeros(matrix[1])))
    schema = T.StructType([*rows.schema.fields, T.StructField(SCORES, T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_rows, values = shared.value
        for batch in batches:
            lists = batch.column(CANDIDATES)
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            wanted = lists.flatten().fill_null(-1).to_numpy()
            found = np.full(len(owner), -1)
            code, markets = pd.factorize(batch.column(MARKET).to_pandas())
            for m, market in enumerate(markets):
                known = id_rows.get(market, np.zeros(0, np.int64))
                at = np.flatnonzero((code[owner] == m) & (wanted >= 0) & (wanted < len(known)))
                found[at] = known[wanted[at]]
            scores = row_dots(to_matrix(batch.column(SEQ_VECTOR)), owner, values, found)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            column = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.round(scores, digits) + 0.0), mask=pa.array(~np.asarray(lists.is_valid()))
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, SCORES])

    return rows.mapInArrow(score, schema)


def row_dots(left: np.ndarray, left_rows: np.ndarray, right: np.ndarray, right_rows: np.ndarray) -> np.ndarray:
    """Dot products in double of chosen rows of two matrices, piece by piece."""
    out = np.empty(len(left_rows))
    step = max(1, CELLS // max(left.shape[1], 1))
    for at in range(0, len(out), step):
        piece = slice(at, at + step)
        out[piece] = np.einsum("ij,ij->i", left[left_rows[piece]], right[right_rows[piece]].astype(np.float64))
    return out


def _score_mapped(rows: DataFrame, ids: DataFrame, vectors: DataFrame, digits: int) -> DataFrame | None:
    """By vectors mapped from the shared folder, filed once however many markets hold the item.

    A dictionary beside them has the place of each vector under the number of the market's first item plus the dense id.
    """
    markets = ids.where(F.col(MARKET).isNotNull()).groupBy(MARKET).agg(F.max(IID).alias("n"))
    if not at_most(markets, MOST_MARKETS):
        return None
    counts = sorted((r[MARKET], r["n"]) for r in markets.collect())
    ends = np.cumsum([n + 1 for _, n in counts]).tolist()
    first = {m: (end - n - 1, n) for (m, n), end in zip(counts, ends, strict=True)}
    used = vectors.select(ITEM, VECTOR).dropna().join(ids.select(ITEM), ITEM, "left_semi")
    source = write_ranges(used, ITEM, VECTOR)
    if source is None:
        return None
    table = rows.sparkSession.createDataFrame([(m, a) for m, (a, _) in first.items()], f"{MARKET} string, _at bigint")
    keyed = ids.join(F.broadcast(table), MARKET).select((F.col("_at") + F.col(IID)).cast("bigint").alias("_key"), ITEM)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, _ = source.finder()
        for batch in batches:
            places = find(batch.column(ITEM))
            known = pa.array(places >= 0)
            yield pa.record_batch([batch.column("_key").filter(known), to_lists(places[:, None]).filter(known)], ["_key", "_place"])

    dictionary = write_ranges(keyed.dropna().mapInArrow(place, "_key bigint, _place array<bigint>"), "_key", "_place")
    schema = T.StructType([*rows.schema.fields, T.StructField(SCORES, T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (entry, places), (_, take) = dictionary.finder(), source.finder()
        step = max(1, MAPPED_CELLS // max(source.width, 1))

        def located(keys: np.ndarray) -> np.ndarray:
            found = entry(pa.array(keys))
            some = np.flatnonzero(found >= 0)
            some = some[np.argsort(found[some])]
            found[some] = places(found[some]).ravel()
            return found

        for batch in batches:
            lists = batch.column(CANDIDATES)
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            wanted = lists.flatten().fill_null(-1).to_numpy()
            own = [first.get(m, (0, -1)) for m in batch.column(MARKET).to_pylist()]
            start, last = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 2
            left = to_matrix(batch.column(SEQ_VECTOR))
            scores = np.zeros(len(owner))
            some = np.flatnonzero((wanted >= 0) & (wanted <= last[owner])) if left.shape[1] else np.zeros(0, np.int64)
            at = located(start[owner[some]] + wanted[some])
            # In the order of the files, so that a page is read once a batch.
            order = np.argsort(at)
            order = order[np.searchsorted(at[order], 0) :]
            for part in (order[i : i + step] for i in range(0, len(order), step)):
                scores[some[part]] = np.einsum("ij,ij->i", left[owner[some[part]]], take(at[part]).astype(np.float64))
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(np.round(scores, digits) + 0.0), mask=pa.array(~np.asarray(lists.is_valid())))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema.names)

    return rows.mapInArrow(score, schema)


def _score_by_blocks(rows: DataFrame, features: DataFrame, digits: int, limit_bytes: int, row_block: int) -> DataFrame:
    rows = numbered(rows, ROW)
    features = features.where(F.col(MARKET).isNotNull() & F.col(VECTOR).isNotNull()).select(MARKET, IID, VECTOR)
    size = vector_table_bytes(features, VECTOR)
    blocks = max(1, -(-size // max(limit_bytes // 4, BLOCK_BYTES)))
    row_blocks = max(1, -(-rows.count() // row_block))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Once per row and block of its candidates: their places and ids, and the row's vector."""
        for batch in batches:
            lists = batch.column(CANDIDATES)
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            wanted = lists.flatten().fill_null(-1).to_numpy()
            block = wanted % blocks
            order = np.lexsort((place, block, owner))
            owner, block = owner[order], block[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))) if len(owner) else order
            cut = pa.array(np.append(first, len(owner)).astype(np.int32))
            own = pa.array(owner[first])
            columns = [batch.column(c).take(own) for c in (ROW, MARKET, SEQ_VECTOR)]
            parts = [pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in (place, wanted)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(block[first]), *parts], names)

    names = [ROW, MARKET, SEQ_VECTOR, "_ib", "_places", "_wanted"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (ROW, MARKET, SEQ_VECTOR)}
    schema = ", ".join([*(f"{c} {kind}" for c, kind in kinds.items()), "_ib bigint, _places array<bigint>, _wanted array<bigint>"])
    asked = rows.select(ROW, MARKET, SEQ_VECTOR, F.col(CANDIDATES).cast("array<bigint>").alias(CANDIDATES))
    left = asked.where(F.col(MARKET).isNotNull()).mapInArrow(send, schema).withColumn("_rb", F.pmod(F.xxhash64(ROW), F.lit(row_blocks)))
    right = features.withColumn("_ib", F.pmod(F.col(IID).cast("bigint"), F.lit(blocks))).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint")))
    )

    def score(some: pa.Table, items: pa.Table) -> pa.Table:
        if not some.num_rows:
            return pa.table({ROW: pa.array([], pa.int64()), "_found": pa.array([], pair)})
        some = some.combine_chunks()
        lists, places = some["_wanted"].combine_chunks(), some["_places"].combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        names = items[MARKET].to_pandas()
        known = pd.MultiIndex.from_arrays([names, items[IID].to_pandas()])
        wanted = pd.MultiIndex.from_arrays([some[MARKET].to_pandas().to_numpy()[owner], lists.flatten().to_numpy()])
        values = to_matrix(items[VECTOR])
        left = to_matrix(some[SEQ_VECTOR])
        values = with_zeros(values) if len(values) else np.zeros((1, left.shape[1]))
        scores = np.round(row_dots(left, owner, values, known.get_indexer(wanted)), digits) + 0.0
        found = pa.StructArray.from_arrays([places.flatten(), pa.array(scores)], ["at", "s"])
        return pa.table({ROW: some[ROW], "_found": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), found)})

    pair = pa.list_(pa.struct([("at", pa.int64()), ("s", pa.float64())]))
    pieces = left.groupBy("_rb", "_ib").cogroup(right.groupBy("_rb", "_ib"))
    pieces = pieces.applyInArrow(score, f"{ROW} bigint, _found array<struct<at: bigint, s: double>>")
    whole = pieces.groupBy(ROW).agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("_all"))
    zeros = F.transform(CANDIDATES, lambda c: F.lit(0.0))
    scores = F.coalesce(F.transform("_all", lambda x: x["s"]), zeros)
    return rows.join(whole, ROW, "left").withColumn(SCORES, scores).drop(ROW, "_all")
