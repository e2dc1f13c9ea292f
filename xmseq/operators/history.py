"""What users have seen, as compressed bitmaps that travel with a row.

Dense ids are cut into chunks of 65,536. Of a chunk that a user knows up to 4,095 items of, the places are kept as sorted
16-bit numbers; of a fuller one, a bit for every place. A user's history thus takes two bytes an item at most and a bit for
each item of the market at most, however often anything was bought.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.model import IID, USER_KEY

CHUNK = 1 << 16
#: One place more would be as long as a bit for each.
MOST_PLACES = 4095
SEEN = "_seen"


def container(places: np.ndarray) -> bytes:
    """Distinct places of a chunk, ascending."""
    if len(places) <= MOST_PLACES:
        return places.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def seen_items(inter_ids: DataFrame) -> DataFrame:
    """(user key, seen): each user's chunks in order, from rows of (user key, dense id), repeated or not.

    Rows without user, market or id are nobody's history. Counts are reduced before they move, by user and chunk; only
    compressed chunks are brought together.
    """
    known = inter_ids.select(*USER_KEY, F.col(IID).cast("bigint").alias("_c")).dropna()
    chunk = F.expr(f"_c div {CHUNK}").alias("chunk")
    places = F.collect_set((F.col("_c") % CHUNK).cast("int")).alias("places")
    parts = known.groupBy(*USER_KEY, chunk).agg(places)
    schema = T.StructType([*(parts.schema[c] for c in USER_KEY), T.StructField("chunk", T.LongType()), T.StructField("bits", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            bits = [container(np.sort(flat[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*USER_KEY, "chunk")), pa.array(bits, pa.binary())], schema.names)

    packed = parts.mapInArrow(pack, schema)
    return packed.groupBy(*USER_KEY).agg(F.array_sort(F.collect_list(F.struct("chunk", "bits"))).alias(SEEN))


def among_seen(owner: np.ndarray, ids: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether the row `owner` has seen each id; `lists` holds the chunks of each row, null for none."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    chunks = lists.flatten()
    number, bits = chunks.field("chunk").to_numpy(), chunks.field("bits")
    out = np.zeros(len(ids), bool)
    if not len(row) or not len(ids):
        return out
    # Where each id's chunk stands among all chunks of the batch, which are in the order of row and chunk.
    span = int(max(number.max(), ids.max() // CHUNK)) + 1
    key, wanted = row * span + number, owner * span + ids // CHUNK
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    there = (key[at] == wanted) & (ids >= 0)
    bits = pa.concat_arrays([bits.cast(pa.large_binary())])
    offsets = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1]
    data = np.frombuffer(bits.buffers()[2], np.uint8)
    full = np.diff(offsets) == CHUNK // 8
    # Full chunks: one bit.
    some = np.flatnonzero(there & full[at])
    place = ids[some] % CHUNK
    out[some] = data[offsets[at[some]] + place // 8] >> (7 - place % 8) & 1
    # Lists of places: all of them in one ascending row.
    lists_ = np.flatnonzero(~full)
    lengths = np.diff(offsets)[lists_]
    spot = np.repeat(offsets[lists_], lengths // 2) + 2 * (np.arange(int((lengths // 2).sum())) - np.repeat(np.cumsum(lengths // 2) - lengths // 2, lengths // 2))
    values = np.repeat(lists_, lengths // 2) * CHUNK + data[spot] + 256 * data[spot + 1].astype(np.int64)
    some = np.flatnonzero(there & ~full[at])
    if len(values) and len(some):
        asked = at[some] * CHUNK + ids[some] % CHUNK
        found = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        out[some] = values[found] == asked
    return out
