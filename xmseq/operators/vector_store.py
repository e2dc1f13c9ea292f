"""Vectors that tasks look up without a shuffle, however many there are.

A table below the broadcast limit (checked) is a broadcast matrix. A larger one is written once to the shared folder, as
files of sorted ids and their vectors, each an id range of about 64 MB, and tasks map the ranges they ask for: pages are
read on demand and shared by the workers of a machine. The list of files, one line per range, travels with the job. A file
that is absent or has another size is an error, never an unknown id. A folder that is no mounted path, such as an object
store, cannot be mapped; callers then join.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmseq.model import ITEM, VECTOR
from xmseq.operators.matrix import collect_matrix
from xmseq.storage import BROADCAST_BYTES, shared_path, vector_table_bytes

RANGE_BYTES = 64 << 20
#: Seed of the session's own hash of texts, so that ids can be hashed on either side.
SEED = 42
WHOLE = ("tinyint", "smallint", "int", "bigint")

# Ids of an Arrow column -> their vectors in double, zeros where there is none, and whether there is one.
Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
# Ids of an Arrow column -> their places among all filed vectors, -1 where there is none.
Finder = Callable[[pa.Array], np.ndarray]
# Places, ascending -> the vectors there, in the type they are filed in.
Taker = Callable[[np.ndarray], np.ndarray]


@dataclass
class Source:
    """Where tasks find vectors: a broadcast (ids, matrix), or a folder and its ranges as (file, first key, rows, bytes)."""

    width: int
    matrix: Any = None
    folder: str = ""
    ranges: tuple[tuple[str, int, int, int], ...] = ()

    def reader(self) -> Reader:
        """Call in a task."""
        if self.matrix is not None:
            return matrix_reader(*self.matrix.value, self.width)
        return range_reader(self.folder, self.ranges, self.width)

    def finder(self) -> tuple[Finder, Taker]:
        """The same in two steps; of files only. Call in a task."""
        return range_finder(self.folder, self.ranges, self.width)


def mounted_path(spark: SparkSession, name: str) -> str | None:
    """A new folder in the shared one as a path of the file system; None if it is none."""
    path = shared_path(spark, name)
    found = urlparse(path)
    # A path without a scheme is one of the session's default file system.
    scheme = found.scheme or urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").scheme
    if scheme != "file":
        return None
    os.makedirs(found.path, exist_ok=True)
    return found.path


def vector_source(
    vectors: DataFrame, key: str = ITEM, vector: str = VECTOR, limit_bytes: int = BROADCAST_BYTES, range_bytes: int = RANGE_BYTES
) -> Source | None:
    """Where tasks find the vectors of (key, vector); None if they are neither few nor can be mapped.

    Rows without key or vector are not there. A key that occurs twice is an error in files, as it is in a matrix.
    """
    vectors = vectors.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    matrix = collect_matrix(vectors, key, vector, limit_bytes)
    if matrix is not None:
        return Source(matrix[1].shape[1], vectors.sparkSession.sparkContext.broadcast(matrix))
    return write_ranges(vectors, key, vector, range_bytes)


def write_ranges(vectors: DataFrame, key: str = ITEM, vector: str = VECTOR, range_bytes: int = RANGE_BYTES) -> Source | None:
    spark = vectors.sparkSession
    folder = mounted_path(spark, "vectors")
    if folder is None:
        return None
    whole = vectors.schema[key].dataType.simpleString() in WHOLE
    named = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    named = named.withColumn("key", F.col("id").cast("bigint") if whole else F.xxhash64(F.col("id").cast("string")))
    parts = max(1, -(-vector_table_bytes(vectors, vector) // range_bytes))
    ranged = named.repartitionByRange(parts, "key").sortWithinPartitions("key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        keys, lists = table["key"].to_numpy(), table["v"].combine_chunks()
        widths = np.unique(lists.value_lengths().to_numpy())
        repeats = int((keys[1:] == keys[:-1]).sum())
        if len(widths) > 1 or repeats:
            yield pa.record_batch([pa.array([""]), pa.array([int(keys[0])]), pa.array([repeats]), pa.array([0]), pa.array([-1])], names)
            return
        columns = {"key": keys, "v": pa.FixedSizeListArray.from_arrays(lists.flatten(), int(widths[0]))}
        out = pa.table(columns if whole else {**columns, "id": table["id"].combine_chunks().cast(pa.large_string())})
        # A name of its own for each attempt: a task that runs twice leaves a file that nobody lists.
        name = f"{uuid.uuid4().hex}.arrow"
        with pa.OSFile(f"{folder}/{name}", "wb") as file, pa.ipc.new_file(file, out.schema) as writer:
            writer.write_table(out)
        size = os.path.getsize(f"{folder}/{name}")
        yield pa.record_batch([pa.array([name]), pa.array([int(keys[0])]), pa.array([len(keys)]), pa.array([size]), pa.array([int(widths[0])])], names)

    names = ["file", "first", "rows", "size", "width"]
    found = ranged.mapInArrow(write, "file string, first bigint, rows bigint, size bigint, width bigint").collect()
    if any(r["width"] < 0 for r in found) or len({r["width"] for r in found}) > 1:
        raise ValueError(f"vectors differ in width, or a {key} occurs twice")
    ranges = tuple(sorted(((r["file"], r["first"], r["rows"], r["size"]) for r in found), key=lambda r: r[1]))
    for name, _, _, size in ranges:
        check_file(f"{folder}/{name}", size)
    return Source(found[0]["width"] if found else 0, None, folder, ranges)


def check_file(path: str, size: int) -> None:
    found = os.path.getsize(path) if os.path.exists(path) else -1
    if found != size:
        raise FileNotFoundError(f"{path}: expected {size} bytes, found {found}; all workers must see the folder of spark.checkpoint.dir")


def one_batch(path: str) -> pa.RecordBatch:
    """The only batch of a file, mapped: `combine_chunks` of a column would copy all of it at every call."""
    file = pa.ipc.open_file(pa.memory_map(path))
    if file.num_record_batches != 1:
        raise ValueError(f"{path}: expected one batch, found {file.num_record_batches}")
    return file.get_batch(0)


def matrix_reader(ids: np.ndarray, values: np.ndarray, width: int) -> Reader:
    index = pd.Index(ids)

    def read(wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = index.get_indexer(wanted.to_pandas().to_numpy())
        out = np.zeros((len(at), width))
        out[at >= 0] = values[at[at >= 0]]
        return out, at >= 0

    return read


def range_finder(folder: str, ranges: tuple[tuple[str, int, int, int], ...], width: int) -> tuple[Finder, Taker]:
    """Where the ids stand in the files, and what stands there: who asks for many vectors can go through the files in order."""
    firsts = np.array([r[1] for r in ranges], np.int64)
    ends = np.cumsum([0, *(r[2] for r in ranges)])
    mapped: dict[int, pa.RecordBatch] = {}

    def table(i: int) -> pa.RecordBatch:
        if i not in mapped:
            path = f"{folder}/{ranges[i][0]}"
            check_file(path, ranges[i][3])
            mapped[i] = one_batch(path)
        return mapped[i]

    def find(wanted: pa.Array) -> np.ndarray:
        out = np.full(len(wanted), -1)
        if not len(firsts):
            return out
        valid = np.flatnonzero(np.asarray(wanted.is_valid()))
        texts = None
        if pa.types.is_integer(wanted.type):
            keys = wanted.take(pa.array(valid)).cast(pa.int64()).to_numpy()
        else:
            texts = wanted.take(pa.array(valid)).cast(pa.large_string())
            keys = np.array([xxhash.xxh64_intdigest(t.encode(), SEED) for t in texts.to_pylist()], np.uint64).view(np.int64)
        order = np.argsort(keys)
        cuts = np.searchsorted(keys[order], firsts)
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(order)], strict=True)):
            if a == b:
                continue
            part, mine = table(i), order[a:b]
            own = part["key"].to_numpy()
            at = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
            hit = own[at] == keys[mine]
            if texts is not None and hit.any():
                same = pc.equal(part["id"].take(pa.array(at[hit])), texts.take(pa.array(mine[hit])))
                hit[hit] = same.to_numpy(zero_copy_only=False)
            out[valid[mine[hit]]] = ends[i] + at[hit]
        return out

    def take(places: np.ndarray) -> np.ndarray:
        cuts = np.searchsorted(places, ends)
        parts = [(i, places[a:b] - ends[i]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        found = [table(i)["v"].flatten().to_numpy().reshape(-1, width)[own] for i, own in parts]
        return np.concatenate(found) if found else np.zeros((0, width))

    return find, take


def range_reader(folder: str, ranges: tuple[tuple[str, int, int, int], ...], width: int) -> Reader:
    find, take = range_finder(folder, ranges, width)

    def read(wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        places = find(wanted)
        out, known = np.zeros((len(wanted), width)), places >= 0
        some = np.flatnonzero(known)
        some = some[np.argsort(places[some])]
        out[some] = take(places[some])
        return out, known

    return read
