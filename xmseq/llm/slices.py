"""Slices of the input as rows of a table, and what other tasks answer to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from xmseq.llm.groups import releasing


def by_slice(rows: DataFrame, fn: Callable[[list[dict[str, Any]]], Iterator[pa.RecordBatch]], schema: str, key: str = "slice") -> DataFrame:
    """Bring the rows of each slice together and yield from fn(rows); a task holds one slice and one Arrow batch at a time."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0][key] != row[key]:
                    yield from fn(held)
                    held = []
                held.append(row)
        if held:
            yield from fn(held)

    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(releasing(run), schema)
