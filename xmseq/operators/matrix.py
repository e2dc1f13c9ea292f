"""Vectors as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.model import IID, ITEM, MARKET, VECTOR
from xmseq.storage import BROADCAST_BYTES, at_most, vector_table_bytes


def to_matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column; a missing list gives zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=dtype)
    valid = np.asarray(column.is_valid())
    width = len(flat) // max(valid.sum(), 1)
    out = np.zeros((len(column), width), dtype)
    out[valid] = flat.reshape(valid.sum(), width)
    return out


def to_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


# Ids, ascending, and their vectors. Plain arrays: a broadcast must not need this package on the workers.
Matrix = tuple[np.ndarray, np.ndarray]


def sorted_matrix(ids: np.ndarray, values: np.ndarray) -> Matrix:
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def with_zeros(values: np.ndarray) -> np.ndarray:
    """The vectors and, as row -1, zeros for unknown items."""
    return np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)])


def rows_of_ids(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted id, -1 where there is none."""
    return pd.Index(ids).get_indexer(wanted)


def collect_matrix(
    vectors: DataFrame, key: str = ITEM, vector: str = VECTOR, limit_bytes: int = BROADCAST_BYTES
) -> Matrix | None:
    """The vectors as one matrix; None if their table may exceed `limit_bytes`."""
    found = collect_matrices(vectors, None, key, vector, limit_bytes)
    return found and found[None]


def collect_matrices(
    vectors: DataFrame,
    group: str | None,
    key: str = ITEM,
    vector: str = VECTOR,
    limit_bytes: int = BROADCAST_BYTES,
) -> dict[str | None, Matrix] | None:
    """The same, a matrix for each value of `group`; a missing value has none. Numbers keep their type."""
    if vector_table_bytes(vectors, vector) > limit_bytes:
        return None
    columns = [F.col(key).alias("id"), F.col(vector).alias("vector")]
    number = np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    table = vectors.select(*columns, *([F.col(group).alias("group")] if group else [])).toArrow()
    ids, values = table["id"].to_pandas().to_numpy(), to_matrix(table["vector"], number)
    if group is None:
        return {None: sorted_matrix(ids, values)}
    code, names = pd.factorize(table["group"].to_pandas())
    return {name: sorted_matrix(ids[code == g], values[code == g]) for g, name in enumerate(names)}


def collect_id_rows(ids: DataFrame, matrix: Matrix, limit_rows: int) -> dict | None:
    """Per market, the matrix row of each dense id (row -1 for the padding id 0); None above `limit_rows` ids."""
    if not at_most(ids, limit_rows):
        return None
    table = ids.select(MARKET, IID, ITEM).toArrow().to_pandas()
    out = {}
    for market, part in table.groupby(MARKET):
        rows = np.full(part[IID].max() + 1, -1)
        rows[part[IID].to_numpy()] = rows_of_ids(matrix[0], part[ITEM].to_numpy())
        out[market] = rows
    return out
