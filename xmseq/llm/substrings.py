"""Removal of long passages that repeat, by prefix-partitioned suffix trees over words.

Every word starts a suffix, cut off at `window` words. Prefixes of 1, 2, 4 and 8 words split the suffixes into groups that
fit into memory: a short prefix where it is rare enough, a longer one where it is not. Within a group, the suffixes that
agree over the whole window would hang below one node of its tree at that depth; sorting the hashes of the windows brings
them together, and no tree is built. All but the earliest of them are repeats.

Suffixes travel as packed arrays, one row for a slice of the input and a task, and a passage repeated within a slice is
sent once, however often it occurs. Texts are shuffled once, compressed, to meet the repeats found in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.llm.groups import by_group
from xmseq.llm.words import bounds, hashes, mix, rolling, slices, text_bytes

WINDOW = 20
PREFIXES = (1, 2, 4, 8)
BITS = 16
TASK_WINDOWS = 2_000_000
SLICE = 5 << 20


def windows_of(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: doc_id, number of windows by row, first windowed word of each row, word hashes, window starts.

    Rows are in the order of doc_id; rows without one are left out.
    """
    batch = batch.filter(batch.column("doc_id").is_valid())
    ids = batch.column("doc_id").to_numpy().astype(np.int64)
    if len(ids) > 1 and (ids[1:] < ids[:-1]).any():
        by = np.argsort(ids, kind="stable")
        batch, ids = batch.take(pa.array(by)), ids[by]
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in slices(offsets, SLICE):
        h, counts = [], []
        for a, b in slices(offsets[lo : hi + 1]):
            own = offsets[lo + a : lo + b + 1]
            part = data[own[0] : own[-1]]
            starts, ends, n = bounds(part, own - own[0])
            h.append(hashes(part, starts, ends))
            counts.append(n)
        h, counts = np.concatenate(h), np.concatenate(counts)
        n = np.maximum(counts - window + 1, 0)
        first = np.cumsum(counts) - counts
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield ids[lo:hi], n, first, h, at


def prefix_bin(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return (mix(rolling(h, k)[at]) >> np.uint64(64 - BITS)).astype(np.int64)


def grouped(h: np.ndarray) -> np.ndarray:
    """An order of the places of `h` that brings equal hashes together, in ascending places."""
    mask = np.uint64((1 << max(1, int(len(h)).bit_length())) - 1)
    order = np.sort((h & ~mask) | np.arange(len(h), dtype=np.uint64)) & mask
    found = h[order]
    top = found & ~mask
    if ((top[1:] == top[:-1]) & (found[1:] != found[:-1])).any():
        return np.argsort(h, kind="stable")
    return order.astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte with as many bytes as the largest needs: planes of zeros are left to compress."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(x: bytes) -> np.ndarray:
    out = np.zeros(((len(x) - 1) // x[0], 8), np.uint8)
    out[:, : x[0]] = np.frombuffer(x, np.uint8, offset=1).reshape(x[0], -1).T
    return out.view("<i8").ravel()


def pack(x: np.ndarray) -> bytes:
    """A sequence of integers by its steps; steps down are odd."""
    step = np.diff(x.astype(np.int64), prepend=0)
    return planes(((step << 1) ^ (step >> 63)).view(np.uint64))


def unpack(x: bytes) -> np.ndarray:
    step = from_planes(x).view(np.uint64)
    return np.cumsum((step >> np.uint64(1)).astype(np.int64) ^ -(step & np.uint64(1)).astype(np.int64))


def packed(doc: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(doc, start) rows, sorted: docs, rows of each, and starts as steps within a doc; one that starts again is listed again."""
    first = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] < start[:-1])) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(first)
    step = np.diff(start, prepend=0)
    step[first] = start[first]
    return pack(doc[first]), planes(np.diff(np.append(first, len(doc)))), planes(step)


def unpacked(docs: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts, total = from_planes(counts), np.cumsum(from_planes(starts))
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, total[first - 1], 0)
    return np.repeat(unpack(docs), counts), total - np.repeat(before, counts)


def plan_groups(docs: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Per prefix length and bin: whether the prefix must be longer, and its task; and the number of tasks.

    Counts all windows. The tables have 2^BITS entries per length, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(PREFIXES), 1 << BITS), np.int64)
        for batch in batches:
            for _, _, _, h, at in windows_of(batch, window):
                for i, k in enumerate(PREFIXES):
                    if len(at):
                        total[i] += np.bincount(prefix_bin(h, at, k), minlength=1 << BITS)
        level, place = np.nonzero(total)
        yield pa.record_batch([pa.array(level), pa.array(place), pa.array(total[level, place])], ["level", "bin", "n"])

    table = np.zeros((len(PREFIXES), 1 << BITS), np.int64)
    each = docs.mapInArrow(count, "level bigint, bin bigint, n bigint").groupBy("level", "bin").agg(F.sum("n").alias("n"))
    found = each.toPandas()
    table[found["level"], found["bin"]] = found["n"]
    spark = docs.sparkSession
    total = int(table[0].sum())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WINDOWS))
    longer = table > max(1, total // (8 * tasks))
    longer[-1] = False
    # Largest groups first, each to the task that has least, going back and forth over the tasks.
    size = np.where(longer, 0, table).ravel()
    turn = np.arange(size.size) % (2 * tasks)
    task = np.zeros(size.size, np.int32)
    task[np.argsort(-size, kind="stable")] = np.where(turn < tasks, turn, 2 * tasks - 1 - turn)
    return longer, task.reshape(table.shape), tasks


def repeats(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Windows that occur earlier: packed rows by bucket of doc_id."""
    longer, task_of, _ = plan_groups(docs, window)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, first, h, at in windows_of(batch, window):
                if not len(at):
                    continue
                whole = mix(rolling(h, window)[at])
                order = grouped(whole)
                again = np.zeros(len(at), bool)
                again[order[1:]] = whole[order[1:]] == whole[order[:-1]]
                doc = np.repeat(ids, n)
                start = at - np.repeat(first, n)
                # Rows of one doc_id may share a start; the place then is no earlier one.
                place = np.flatnonzero(again)
                if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
                    lead = order[np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order))))]
                    back = np.empty(len(order), np.int64)
                    back[order] = lead
                    place = place[(doc[place] != doc[back[place]]) | (start[place] != start[back[place]])]
                rows = [(-1 - b, *packed(doc[x], start[x]), b"") for b, x in by_bucket(doc, place, buckets)]
                task = np.full(len(at), -1, np.int32)
                for i, k in enumerate(PREFIXES):
                    left = np.flatnonzero(task < 0)
                    bins = prefix_bin(h, at[left], k)
                    task[left] = np.where(longer[i][bins], -1, task_of[i][bins])
                del order
                new = np.flatnonzero(~again)
                new = new[np.argsort(task[new].astype(np.uint16 if task_of.max() < 1 << 16 else np.int32), kind="stable")]
                cuts = np.flatnonzero(np.append(True, task[new][1:] != task[new][:-1]))
                for lo, hi in zip(cuts, [*cuts[1:], len(new)], strict=True):
                    x = new[lo:hi]
                    rows.append((int(task[x[0]]), *packed(doc[x], start[x]), whole[x].tobytes()))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], ["task", "docs", "counts", "starts", "hashes"])

    def meet(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = table.slice(lo, hi - lo)
            key, columns = part.column("task")[0].as_py(), [part.column(c).to_pylist() for c in ("docs", "counts", "starts")]
            if key < 0:
                out += [(-1 - key, *r) for r in zip(*columns, strict=True)]
                continue
            places = [unpacked(*r) for r in zip(*columns, strict=True)]
            doc, start = (np.concatenate([p[i] for p in places]) for i in (0, 1))
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()])
            order = grouped(h)
            same = h[order[1:]] == h[order[:-1]]
            order = order[np.append(same, False) | np.append(False, same)]
            order = order[np.lexsort((start[order], doc[order], h[order]))]
            first = np.append(True, h[order[1:]] != h[order[:-1]]) if len(order) else np.zeros(0, bool)
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
            late = order[(doc[order] != doc[lead]) | (start[order] != start[lead])]
            late = late[np.lexsort((start[late], doc[late]))]
            out += [(b, *packed(doc[x], start[x])) for b, x in by_bucket(doc, late, buckets)]
        columns = [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3))]
        return pa.table(dict(zip(("bucket", "docs", "counts", "starts"), columns, strict=True)))

    sent = docs.mapInArrow(send, "task bigint, docs binary, counts binary, starts binary, hashes binary")
    return by_group(sent, ["task"], meet, "bucket int, docs binary, counts binary, starts binary")


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def by_bucket(doc: np.ndarray, rows: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """`rows` by the bucket of their document, each in the order given."""
    b = bucket_of(doc[rows], buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.append(True, b[order][1:] != b[order][:-1])) if len(b) else []
    return [(int(b[order[lo]]), rows[order[lo:hi]]) for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True)] if len(b) else []


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a window of `window` words whose sequence also starts earlier.

    docs: doc_id, text; other columns are ignored. Earlier is a smaller doc_id, or the same one and an earlier start. Words
    are runs other than space and \\x09-\\x0D, unchanged. Returns per row doc_id, n_words, n_removed, text (the words kept,
    joined by one space) and removed, the runs of covered words as (start, end); repeated passages that touch make one run. A null or empty text has no
    words; texts shorter than the window are kept, and so are rows without doc_id, which are nobody's earlier copy.
    Windows are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(3)
        for batch in batches:
            blobs = [small.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id")
            where = bucket_of(ids.cast(pa.int64()).fill_null(0).to_numpy(), buckets)
            yield pa.record_batch([pa.array(where), ids, pa.array(blobs, pa.binary())], ["bucket", "doc_id", "z"])

    texts = docs.mapInArrow(squeeze, f"bucket int, doc_id {kind}, z binary")
    found = repeats(docs, window, buckets)
    both = found.unionByName(texts, allowMissingColumns=True).repartitionById(buckets, F.col("bucket"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = zstandard.ZstdDecompressor()
        held, index = [], None
        for batch in batches:
            flags = batch.filter(batch.column("z").is_null())
            held += [unpacked(*r) for r in zip(*(flags.column(c).to_pylist() for c in ("docs", "counts", "starts")), strict=True)]
            rows = batch.filter(batch.column("z").is_valid())
            if not rows.num_rows:
                continue
            if index is None:  # all repeats of a partition come before its texts
                doc, start = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in held)]) for i in (0, 1))
                held, order = [], np.lexsort((start, doc))
                doc, start = doc[order], start[order]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(doc))[: len(first)]
                index = dict(zip(doc[first].tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True))
            for at in range(0, rows.num_rows, 1024):
                part = rows.slice(at, 1024)
                out = []
                for i, z in zip(part.column("doc_id").to_pylist(), part.column("z").to_pylist(), strict=True):
                    words = big.decompress(z).split()
                    n, spans = len(words), []
                    if i in index:
                        lo, hi = index[i]
                        s = start[lo:hi]
                        s = s[s + window <= n]
                        gap = np.flatnonzero(np.append(True, s[1:] > s[:-1] + window)) if len(s) else np.zeros(0, np.int64)
                        spans = [(int(s[a]), int(s[b - 1]) + window) for a, b in zip(gap, [*gap[1:], len(s)], strict=True)] if len(s) else []
                        for a, b in reversed(spans):
                            del words[a:b]
                    out.append((i, n, n - len(words), b" ".join(words).decode(), spans))
                yield pa.record_batch([part.column("doc_id"), *(pa.array([r[j] for r in out], t) for j, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))))], ["doc_id", "n_words", "n_removed", "text", "removed"])

    return both.sortWithinPartitions(F.col("z").isNotNull()).mapInArrow(
        cut, f"doc_id {kind}, n_words bigint, n_removed bigint, text string, removed array<struct<start: bigint, end: bigint>>"
    )
