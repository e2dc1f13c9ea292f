"""Whole groups of rows handed to numpy, many small groups at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def release() -> None:
    """Give freed memory back to the system: workers that wait for their next task would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over the batches of a task, and `release` behind it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def by_group(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, order: Sequence[str] = ()
) -> DataFrame:
    """Shuffle by the integer columns `keys`, sort by them and `order`, and call fn(table, starts) on runs of whole groups.

    `starts` holds the first row of each group and the number of rows. The caller bounds the groups; a task holds the
    groups of one Arrow batch, plus the one that goes on in the next.
    """
    # A fixed number of partitions: rows here are few but costly, and would be merged by their bytes.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            change[0] = last is None or last != tuple(c[0] for c in columns)
            last = tuple(c[-1] for c in columns)
            cuts = np.flatnonzero(change)
            if len(cuts):
                if cuts[-1] or held:
                    done = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
                    if done.num_rows:
                        yield from fn(done, group_starts(done, keys)).to_batches()
                held = [batch.slice(cuts[-1])]
            else:
                held.append(batch)
        if held:
            done = pa.Table.from_batches(held)
            yield from fn(done, group_starts(done, keys)).to_batches()

    return dealt.mapInArrow(releasing(run), schema)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


class Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart until now."""
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
