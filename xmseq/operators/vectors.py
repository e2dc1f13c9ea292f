"""Item texts as vectors, and attention over a sequence in plain DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.functions.text import tokens
from xmseq.functions.vectors import dot, matvec, weighted_sum
from xmseq.model import ITEM, SEQ, TEXT, TEXT_BATCH, USER_KEY, VECTOR
from xmseq.operators.lookup import lookup_vectors
from xmseq.operators.matrix import to_lists
from xmseq.operators.scoring import CELLS
from xmseq.operators.vector_store import Source, vector_source
from xmseq.storage import BROADCAST_BYTES

BatchEncoder = Callable[[list[str]], np.ndarray]


def hashed_texts(
    texts: DataFrame, dim: int, key: str = ITEM, text: str = TEXT, max_tokens: int | None = None
) -> DataFrame:
    """(key, weights): tokens hashed into `dim` buckets, counted, scaled to unit length; zeros for a text without tokens.

    A token's bucket is the number in the first eight hex digits of its MD5, modulo `dim`. The whole text counts;
    `max_tokens` keeps the first tokens only, as encoders of limited length do. Spark cuts the texts into tokens; each
    Arrow batch then hashes its distinct tokens once and counts all in one pass. Nothing is shuffled.
    """
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    if max_tokens is not None:
        words = F.slice(words, 1, max_tokens)
    schema = T.StructType([texts.schema[key], T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // dim)
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                lists = part.column("_w")
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                encoded = lists.flatten().dictionary_encode()
                buckets = np.array([_bucket(w, dim) for w in encoded.dictionary.to_pylist()], dtype=np.int64)
                cells = owner * dim + buckets[encoded.indices.to_numpy()]
                counts = np.bincount(cells, minlength=len(lists) * dim).reshape(-1, dim).astype(np.float64)
                norm = np.sqrt((counts**2).sum(axis=1, keepdims=True))
                weights = counts / np.where(norm > 0, norm, 1.0)
                yield pa.RecordBatch.from_arrays([part.column(key), to_lists(weights)], [key, "weights"])

    return texts.select(key, words.alias("_w")).mapInArrow(count, schema)


def _bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def text_weights(
    texts: DataFrame, dim: int, key: str = ITEM, text: str = TEXT, max_tokens: int | None = None
) -> DataFrame:
    """Long form (key, bucket, weight) without the zeros."""
    hashed = hashed_texts(texts, dim, key, text, max_tokens)
    return hashed.select(key, F.posexplode("weights").alias("bucket", "weight")).where(F.col("weight") > 0)


def text_vectors(
    texts: DataFrame,
    dim: int | None = None,
    encoder: Callable[[], BatchEncoder] | None = None,
    key: str = ITEM,
    text: str = TEXT,
    max_tokens: int | None = None,
    batch: int = TEXT_BATCH,
) -> DataFrame:
    """One vector per text: hashed tokens, or the caller's encoder.

    `encoder` is called once per task (it loads the model) and gives a function from texts to a matrix.
    """
    if encoder is not None:
        return _encoded(texts.select(key, text), encoder, key, text, batch)
    hashed = hashed_texts(texts, dim, key, text, max_tokens)
    return hashed.select(key, F.col("weights").cast("array<float>").alias(VECTOR))


def _encoded(texts: DataFrame, encoder: Callable[[], BatchEncoder], key: str, text: str, batch: int) -> DataFrame:
    schema = T.StructType([texts.schema[key], T.StructField(VECTOR, T.ArrayType(T.FloatType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for rows in batches:
            run = run or encoder()
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                matrix = np.asarray(run(part.column(text).to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(key), to_lists(matrix)], [key, VECTOR])

    return texts.mapInArrow(encode, schema)


def project_vectors(vectors: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Vectors times a weight matrix (rows = outputs): done once per item, not once per occurrence."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in matrix])
    return vectors.select(ITEM, matvec(rows, F.col(VECTOR)).alias(VECTOR))


def attention_weights(
    seqs: DataFrame,
    queries: DataFrame,
    keys: DataFrame | None = None,
    key: Sequence[str] = tuple(USER_KEY),
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key.., place, item, score, weight): softmax of the last item's query with every item of the sequence.

    `queries` and `keys` are item vector tables, already projected. Items without a vector take no part. Sequences are
    bounded in length, so the softmax runs in a window.
    """
    key = list(key)
    # Ids are spread over the places, vectors are looked up there, and only scores go on.
    placed = seqs.select(*key, F.element_at(SEQ, -1).alias("_last"), F.posexplode(SEQ).alias("place", ITEM))
    asked = lookup_vectors(placed, queries, "_last", "_q", limit_bytes)
    both = lookup_vectors(asked, queries if keys is None else keys, ITEM, "_k", limit_bytes)
    score = dot("_q", "_k") / F.sqrt(F.size("_q"))
    scored = both.where("_q is not null and _k is not null").select(*key, "place", ITEM, score.alias("score"))
    group = Window.partitionBy(*key)
    shifted = scored.withColumn("_e", F.exp(F.col("score") - F.max("score").over(group)))
    return shifted.withColumn("weight", F.col("_e") / F.sum("_e").over(group)).drop("_e")


def attention_pool(
    seqs: DataFrame,
    queries: DataFrame,
    keys: DataFrame | None = None,
    values: DataFrame | None = None,
    key: Sequence[str] = tuple(USER_KEY),
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key.., pooled): the weighted sum of the items' value vectors of each sequence.

    Tasks read the vectors where the sequences are, and each row of `seqs` passes on one sum. Where tables have an item twice,
    vectors of several widths or with gaps, or cannot be mapped, the vectors are joined to the places instead.
    """
    key = list(key)
    keys, values = (queries if x is None else x for x in (keys, values))
    stores = {id(x): _store(x, limit_bytes) for x in (queries, keys, values)}
    q, k, v = (stores[id(x)] for x in (queries, keys, values))
    if q is None or k is None or v is None or q.width != k.width:
        return _joined_pool(seqs, queries, keys, values, key, limit_bytes)
    parts = [("_peak", T.DoubleType()), ("_total", T.DoubleType()), ("_sum", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*(seqs.schema[c] for c in key), *(T.StructField(*x) for x in parts)])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_q, read_k, read_v = (x.reader() for x in (q, k, v))
        step = max(1, CELLS // (256 * max(q.width, v.width)))
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                lists = part.column(SEQ)
                lengths = lists.value_lengths().fill_null(0).to_numpy()
                some, items = np.flatnonzero(lengths), lists.flatten()
                owner = np.repeat(np.arange(len(some)), lengths[some])
                asked, asks = read_q(items.take(pa.array(np.cumsum(lengths)[some] - 1)))
                found, known = read_k(items)
                at = np.flatnonzero(known & asks[owner])
                if not len(at):
                    continue
                row, first, own = np.unique(owner[at], return_index=True, return_inverse=True)
                scores = np.einsum("ij,ij->i", asked[owner[at]], found[at]) / np.sqrt(q.width)
                peak = np.maximum.reduceat(scores, first)
                e = np.exp(scores - peak[own])
                given, there = read_v(items.take(pa.array(at)))
                sums = to_lists(np.add.reduceat(e[:, None] * given, first))
                # Without the vector of an item there is no sum.
                whole = np.logical_and.reduceat(there, first)
                sums = sums.take(pa.array(np.arange(len(row)), mask=~whole))
                mine = [part.column(c).take(pa.array(some[row])) for c in key]
                yield pa.RecordBatch.from_arrays([*mine, pa.array(peak), pa.array(np.add.reduceat(e, first)), sums], schema.names)

    # Rows of one key are one sequence: their sums are brought to the highest peak.
    partial = F.collect_list(F.struct("_peak", "_total", "_sum")).alias("_p")
    merged = seqs.select(*key, SEQ).mapInArrow(pool, schema).groupBy(*key).agg(partial, F.max("_peak").alias("_top"))
    raised = F.transform("_p", lambda p: F.struct(F.exp(p["_peak"] - F.col("_top")).alias("scale"), p["_total"].alias("total"), p["_sum"].alias("v")))
    merged = merged.select(*key, raised.alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["scale"] * p["total"])
    merged = merged.select(*key, "_p", total.alias("_all"))
    shares = F.transform("_p", lambda p: F.struct((p["scale"] / F.col("_all")).alias("weight"), p["v"].alias("v")))
    return merged.select(*key, weighted_sum(shares, "weight", "v", F.lit(v.width)).alias("pooled"))


def _store(vectors: DataFrame, limit_bytes: int) -> Source | None:
    """Where tasks find vectors of one width without gaps, one for each item; None if that is not what the table holds."""
    known = vectors.where(F.col(ITEM).isNotNull() & F.col(VECTOR).isNotNull())
    gap = F.max(F.exists(VECTOR, lambda x: x.isNull()))
    low, high, gaps = known.agg(F.min(F.size(VECTOR)), F.max(F.size(VECTOR)), gap).first()
    if not low or low != high or gaps:
        return None
    source = vector_source(vectors, limit_bytes=limit_bytes)
    if source is not None and source.matrix is not None:
        ids = source.matrix.value[0]
        return None if (ids[1:] == ids[:-1]).any() else source
    return source


def _joined_pool(seqs: DataFrame, queries: DataFrame, keys: DataFrame, values: DataFrame, key: list[str], limit_bytes: int) -> DataFrame:
    weights = attention_weights(seqs, queries, keys, key, limit_bytes)
    found = lookup_vectors(weights, values, ITEM, "_v", limit_bytes)
    parts = F.array_sort(F.collect_list(F.struct("place", "weight", F.col("_v").alias("v"))))
    width = F.size(F.get("_p", F.lit(0))["v"])
    return found.groupBy(*key).agg(parts.alias("_p")).select(
        *key, weighted_sum(F.col("_p"), "weight", "v", width).alias("pooled")
    )
