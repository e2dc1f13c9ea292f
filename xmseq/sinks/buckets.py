"""The master by user: each user's events lie in one bucket in order of time, so windows over users need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmseq.model import TIME, USER_KEY


def spec_path(path: str) -> str:
    return path.rstrip("/") + ".buckets"


def write_buckets(inter: DataFrame, path: str, ties: Sequence[str] = (), buckets: int | None = None) -> None:
    """Write interactions to `path`, a file per bucket of user and market, sorted by user, time and `ties`.

    The number of buckets, by default that of shuffle partitions, and the columns go to a table of one row beside it. A user is in one
    file, so one with a large share of all rows makes a large file; its windows are told apart when they are read, like
    those of any other table.
    """
    spark = inter.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*USER_KEY, TIME, *(c for c in ties if c not in (*USER_KEY, TIME))]
    name = f"master_{uuid.uuid4().hex}"
    dealt = inter.repartition(buckets, *USER_KEY)
    dealt.write.bucketBy(buckets, *USER_KEY).sortBy(*order).option("path", path).format("parquet").saveAsTable(name)
    # The files stay; the next reader names them anew.
    spark.sql(f"drop table {name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inter.schema.fields)
    row = spark.range(1).select(F.lit(buckets).alias("buckets"), F.array(*map(F.lit, order)).alias("sorted"), F.lit(columns).alias("columns"))
    row.write.parquet(spec_path(path))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The interactions at `path`, with what the session needs to know about their buckets."""
    spec = spark.read.parquet(spec_path(path)).first()
    name = f"master_{uuid.uuid4().hex}"
    keys, order = ", ".join(f"`{c}`" for c in USER_KEY), ", ".join(f"`{c}`" for c in spec["sorted"])
    spark.sql(
        f"create table {name} ({spec['columns']}) using parquet clustered by ({keys}) sorted by ({order}) "
        f"into {spec['buckets']} buckets location '{path}'"
    )
    return spark.table(name)
