"""Prepared tables with typed headers, vector files, parameter tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xmseq.functions.text import text_to_vec
from xmseq.model import INTER_HEADER, ITEM, ITEM_HEADER, MARKET, TIME, USER, VECTOR

PARAMS_SCHEMA = "name string, row int, values array<float>"
# The types a header may name.
CASTS = {
    "token": lambda c: c,
    "float": lambda c: c.cast("double"),
    "float_seq": text_to_vec,
}


def read_typed(
    spark: SparkSession, path: str | list[str], sep: str = "\t", load: Sequence[str] | None = None
) -> DataFrame:
    """A text table whose header names are `name:type`; the columns in `load` (default all), without the type, cast."""
    raw = spark.read.csv(path, sep=sep, header=True)
    chosen: list[Column] = []
    for header in raw.columns:
        name, _, kind = header.partition(":")
        if load is None or name in load:
            if kind not in CASTS:
                raise ValueError(f"{header!r}: the type is not one of {', '.join(CASTS)}")
            chosen.append(CASTS[kind](F.col(f"`{header}`")).alias(name))
    found = {h.partition(":")[0] for h in raw.columns}
    missing = [c for c in load or () if c not in found]
    if missing:
        raise ValueError(f"columns not in the header: {', '.join(missing)}")
    return raw.select(*chosen)


def _plain(headers: dict[str, str]) -> dict[str, str]:
    """Column names by the names in the header."""
    return {header.partition(":")[0]: column for column, header in headers.items()}


def read_inter(spark: SparkSession, directory: str, market: str) -> DataFrame:
    """Interactions of a market from <directory>/<market>/<market>.inter."""
    names = _plain(INTER_HEADER)
    rows = read_typed(spark, f"{directory}/{market}/{market}.inter", load=list(names)).withColumnsRenamed(names)
    return rows.select(F.lit(market).alias(MARKET), USER, ITEM, F.col(TIME).cast("bigint").alias(TIME))


def read_items(spark: SparkSession, directory: str, market: str) -> DataFrame:
    """Item vectors of a market from <directory>/<market>/<market>.item."""
    rows = read_typed(spark, f"{directory}/{market}/{market}.item", load=list(_plain(ITEM_HEADER)))
    return rows.select(F.lit(market).alias(MARKET), ITEM, VECTOR)


def read_prepared(spark: SparkSession, directory: str, market: str) -> tuple[DataFrame, DataFrame]:
    """Interactions and items of a market."""
    return read_inter(spark, directory, market), read_items(spark, directory, market)


def read_vectors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Item vectors from the comma-separated vector file."""
    return read_typed(spark, path, sep=",", load=list(_plain(ITEM_HEADER)))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Model parameters: one row per matrix row."""
    return spark.read.schema(PARAMS_SCHEMA).parquet(path)
