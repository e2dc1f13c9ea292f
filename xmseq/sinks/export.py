"""Outputs: the parquet master, typed text tables per market, the vector file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.functions.text import vec_to_text
from xmseq.model import INTER_HEADER, ITEM_HEADER, MARKET, TIME, VECTOR


def write_master(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, one folder per market, so that reading a market skips the others."""
    df.write.mode(mode).partitionBy(MARKET).parquet(path)


def export_inter(inter: DataFrame, directory: str, market: str, single_file: bool = False) -> str:
    """A market's interactions as tab-separated text with a typed header; returns the path read_prepared looks at.

    A folder of part files with a header each; one file on request, for a market that one task can write.
    """
    rows = inter.where(F.col(MARKET) == market)
    columns = [F.col(c).alias(h) for c, h in INTER_HEADER.items() if c != TIME]
    columns.append(F.col(TIME).cast("bigint").alias(INTER_HEADER[TIME]))
    return _text(rows.select(*columns), f"{directory}/{market}/{market}.inter", "\t", single_file)


def export_items(items: DataFrame, directory: str, market: str, single_file: bool = False) -> str:
    """A market's item vectors as tab-separated text with a typed header."""
    rows = items.where(F.col(MARKET) == market)
    return _text(_item_columns(rows), f"{directory}/{market}/{market}.item", "\t", single_file)


def export_vectors(vectors: DataFrame, path: str, single_file: bool = False) -> str:
    """All item vectors as comma-separated text."""
    return _text(_item_columns(vectors), path, ",", single_file)


def _item_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *[(vec_to_text(c) if c == VECTOR else F.col(c).cast("string")).alias(h) for c, h in ITEM_HEADER.items()]
    )


def _text(df: DataFrame, path: str, sep: str, single_file: bool) -> str:
    (df.coalesce(1) if single_file else df).write.csv(path, sep=sep, header=True)
    return path
