"""Shared folder, pinned tables and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 128 << 20
SMALL_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; a temporary one only in local mode, where nothing is named."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="xmseq-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/xmseq/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str = "pinned", by: str | None = None, packed: bool = False) -> DataFrame:
    """Write `df` to the shared folder, one folder per value of `by` if given, and read it back.

    Cuts the lineage like a checkpoint, but stays columnar and survives lost executors. `packed` says that its values are
    large and compressed already: a codec would take buffers of their size outside the heap and gain nothing.
    """
    path = shared_path(df.sparkSession, name)
    out = df.write.option("compression", "uncompressed") if packed else df.write
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` as a stored table with a number of its own for every row, equal rows included."""
    return pin(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def tasks(spark: SparkSession) -> int:
    """Tasks for long work on few bytes: several to a core, so that none waits long for the last."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt to a few tasks for each core by a hash of the columns `by`.

    By the columns themselves it would stay as a step before left it by the same ones, and Spark cuts rows of few bytes into as many
    tasks as there are cores, or one more. Tasks that each read a whole table must not be many.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*by))


def vector_table_bytes(df: DataFrame, column: str) -> int:
    """Upper bound of the size of a table of (id, vector) as float64."""
    rows, width = df.agg(F.count("*"), F.max(F.size(column))).first()
    return rows * (8 * (width or 0) + 64)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows


def fits(df: DataFrame, rows: int, size: int) -> bool:
    """Whether `df` has at most `rows` rows and `size` bytes; reads no further than needed."""
    width = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        elif kind == "array":
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * 8 + 16
        else:
            width = width + 8
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("bigint")).alias("size")).first()
    return found["n"] <= rows and (found["size"] or 0) <= size
