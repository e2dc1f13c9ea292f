"""Raw inputs: item metadata, market files, ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmseq.model import DESCRIPTION, ITEM, MARKET, MARKET_FILE_SUFFIX, MARKETS, TITLE
from xmseq.storage import pin

METADATA_SCHEMA = "asin string, title string, description array<string>"
RATINGS_SCHEMA = "reviewerID string, asin string, ratings double, date string"
CORRUPT = "_corrupt"
FILE_ORDER = ["file", "ord"]


def read_metadata(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Item metadata from JSON lines, gzip or plain, with the file order for `dedup_first` in `file` and `ord`.

    strict=True raises on a broken line; otherwise the line comes as a row with its text in `_corrupt`.
    """
    if strict:
        reader = spark.read.schema(METADATA_SCHEMA).option("mode", "FAILFAST")
    else:
        reader = (
            spark.read.schema(f"{METADATA_SCHEMA}, {CORRUPT} string")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
        )
    rows = reader.json(path)
    # A gzip file is one split, read in line order; plain files are split in order.
    return rows.select(
        F.col("asin").alias(ITEM),
        TITLE,
        DESCRIPTION,
        *([] if strict else [CORRUPT]),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("ord"),
    )


def split_corrupt(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the count of broken lines per file, of metadata read with strict=False.

    The parsed rows are stored first: Spark does not answer for broken lines alone from the raw file.
    """
    meta = pin(meta, "metadata")
    broken = meta.where(F.col(CORRUPT).isNotNull()).groupBy("file").agg(F.count("*").alias("n_broken"))
    return meta.where(F.col(CORRUPT).isNull()).drop(CORRUPT), broken


def read_ratings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless, blank-separated ratings."""
    return spark.read.csv(path, sep=" ", schema=RATINGS_SCHEMA)


def market_files(directory: str, markets: Sequence[str] = MARKETS) -> list[str]:
    return [f"{directory}/{m}{MARKET_FILE_SUFFIX}" for m in markets]


def read_markets(
    spark: SparkSession, directory: str, markets: Sequence[str] = MARKETS, columns: Sequence[str] = ("userId", "itemId", "date")
) -> DataFrame:
    """Interactions of all markets in one frame, the market taken from the name of its file (or folder of files).

    Values stay text, so ids keep leading zeros; columns are chosen by the names in the header.
    """
    rows = spark.read.csv(market_files(directory, markets), sep=" ", header=True)
    pattern = "([^/]+)" + MARKET_FILE_SUFFIX.replace(".", r"\.") + "(/|$)"
    # Paths come percent-encoded; a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(F.regexp_extract(path, pattern, 1).alias(MARKET), *columns)
