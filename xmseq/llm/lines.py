"""Removal of repeated runs of lines, by winnowing over line hashes.

Every window of `run` consecutive lines selects its smallest line hash as a fingerprint, so two texts that share a run of that
length are sure to share a fingerprint at the same place of it. Only fingerprints that recur go on: they are extended to the
windows around them that selected them, equal windows meet, and all but the earliest are marked. Marked windows that touch
make up a repeated run, which is deleted. Where a number of words is given, fewer lines that hold as many are windows, too,
so that a long line, or a pair of them, counts by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.llm.groups import releasing
from xmseq.llm.store import unused
from xmseq.llm.words import bounds, hashes, mix, rolling, runs, slices, text_bytes
from xmseq.storage import pin

RUN = 3
#: Words that make a window of fewer lines, where long lines count by themselves.
LONG = 50


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each line, whether it has anything but white space, and the lines of each row."""
    breaks = np.flatnonzero(data == 10)
    row_ends = offsets[1:]
    ends = np.append(breaks, row_ends)
    # A break right behind the end of a row belongs to the next one.
    order = np.argsort(ends * 2 + np.append(np.ones(len(breaks), np.int64), np.zeros(len(row_ends), np.int64)), kind="stable")
    ends = ends[order]
    is_last = order >= len(breaks)
    counts = np.diff(np.flatnonzero(is_last), prepend=-1)
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + np.where(is_last[:-1], 0, 1)
    starts[:1] = 0
    ink = np.append(0, np.cumsum(~((data == 32) | ((data >= 9) & (data <= 13)))))
    return starts, ends, ink[ends] > ink[starts], counts


def window_lines(n: list[int], start: int, run: int, words: int | None) -> int:
    """Lines of the window that begins at line `start`, for lines of `n` words."""
    if words is not None:
        total = 0
        for i, x in enumerate(n[start : start + run], 1):
            total += x
            if total >= words:
                return i
    return run


def windows(column: pa.Array, run: int, words: int | None = None) -> Iterator[tuple[int, *tuple[np.ndarray, ...]]]:
    """For slices of a text column: first row, and of each window the row, the start, its hash, the line it selects and the hash of that.

    Starts are doubled; odd ones are those of fewer than `run` lines, which end where they hold `words` words.
    """
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, ink, lines = line_bounds(part, own)
        row = np.repeat(np.arange(hi - lo), lines)[ink]
        h = hashes(part, starts[ink], ends[ink])
        counts = np.bincount(row, minlength=hi - lo)
        n = np.maximum(counts - run + 1, 0)
        at = np.repeat(np.cumsum(counts) - counts, n) + runs(n)
        yield lo, row[at], runs(counts)[at] * 2, *selected(h, at, np.full(len(at), run))
        if words is None or not len(h):
            continue
        held = np.diff(np.searchsorted(bounds(part, own)[0], np.stack([starts[ink], ends[ink]])), axis=0)[0]
        total = np.append(0, np.cumsum(held))
        length = np.searchsorted(total, total[:-1] + words) - np.arange(len(h))
        at = np.flatnonzero((length < run) & (runs(counts) + length <= counts[row]))
        yield lo, row[at], runs(counts)[at] * 2 + 1, *selected(h, at, length[at])


def selected(h: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows of `length` lines from `at` on: hash, the line each selects, and the hash of that."""
    # The leftmost smallest hash, so that equal windows select the same place of themselves.
    whole, least = h[at], at.copy()
    for i in range(1, int(length.max(initial=1))):
        more = np.flatnonzero(length > i)
        least[more] = np.where(h[at[more] + i] < h[least[more]], at[more] + i, least[more])
    for k in np.unique(length).tolist():
        own = length == k
        whole[own] = mix(rolling(h, k)[at[own]])
    return whole, least, h[least]


def repeated_windows(docs: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(doc_id, starts): the windows of `run` lines, or fewer with `words` words, that also start earlier; starts as in `windows`."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, row, start, whole, least, chosen in windows(batch.column("text"), run, words):
                # Windows next to each other that select the same line share a row.
                first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 2))) if len(row) else np.zeros(0, np.int64)
                cut = pa.array(np.append(first, len(row)).astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(lo + row[first])),
                        pa.array(chosen[first].view(np.int64)),
                        pa.array(start[first]),
                        pa.ListArray.from_arrays(cut, pa.array(whole.view(np.int64))),
                    ],
                    ["doc_id", "fingerprint", "start", "windows"],
                )

    prints = docs.where("doc_id is not null").mapInArrow(releasing(select), f"doc_id {kind}, fingerprint bigint, start bigint, windows array<bigint>")
    prints = pin(prints, "line-fingerprints")
    # Joins with stored tables, not windows over a key: Spark splits what a frequent line brings together.
    again = pin(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "line-repeats")
    met = prints.join(again, "fingerprint").select("doc_id", "start", F.posexplode("windows").alias("i", "whole"))
    met = pin(met.select("whole", "doc_id", (F.col("start") + 2 * F.col("i")).alias("start")), "line-windows")
    first = met.groupBy("whole").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    first = pin(first.where("n > 1"), "line-firsts")
    late = met.join(first, "whole").where(F.struct("doc_id", "start") > F.col("first"))
    return late.groupBy("doc_id").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """All columns of `docs` with repeated runs of lines deleted from text, and n_lines, n_removed.

    A line is what stands between line feeds; lines of white space are not counted, break no run, and stay. A line is
    deleted if a window of `run` counted lines that covers it also starts earlier: in a smaller doc_id, or in the same one
    further up. With `words`, the fewest lines from a line on that hold so many words are a window as well: a line of that length
    is deleted wherever it repeats, and shorter ones only as parts of a window, because headings and set phrases recur in
    texts that are no copies. A null text stays null, with no lines. Rows without doc_id stay as they are and are nobody's earlier copy;
    rows that share a doc_id count as one document. Lines are compared by 64-bit hashes.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*names)
    extra = unused(docs, "starts")
    late = repeated_windows(docs.select("doc_id", "text"), run, words).withColumnRenamed("starts", extra)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column(extra).to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    total.append(0)
                    gone.append(0)
                    continue
                lines = text.split("\n")
                held = [len(x.encode().split()) for x in lines]
                counted = [i for i, n in enumerate(held) if n]
                n = [held[i] for i in counted]
                drop = {i for s in starts or [] for i in counted[s // 2 : s // 2 + window_lines(n, s // 2, run, words if s % 2 else None)]}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                total.append(len(counted))
                gone.append(len(drop))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"])

    added = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")]
    schema = T.StructType([*docs.schema.fields, *added])
    # Texts are shuffled at every size: whether the starts could be broadcast depends on the data.
    return docs.join(late.hint("merge"), "doc_id", "left").select(*names, extra).mapInArrow(releasing(cut), schema)
