"""Tables in the shared folder, and connected components over any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.storage import pin

MAX_ROUNDS = 64
#: Up to this many links, a few MB, are worked on in one task: rounds then cost no shuffle.
FEW_LINKS = 100_000


def unused(df: DataFrame, name: str) -> str:
    """`name`, or the first name after it that `df` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(links: DataFrame, u: str = "u", v: str = "v", node: str = "node", component: str = "component") -> DataFrame:
    """Smallest node reachable from each node that has a link to another node.

    `links` is a table of two columns of one sortable type. Alternates two star steps: every node sends its larger
    neighbours, then its smaller ones, to the smallest it knows; the longest paths shrink by a factor in each round. A node
    with any number of links is only ever counted or joined, so Spark can split it. Each round is a table in the shared
    folder. Rows with a null end are no links. What is left of the links after a round decides how it is spread.
    """
    edges = pin(
        links.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"), F.col(u).isNull() | F.col(v).isNull())
        .toDF("a", "b", "gap")
        .where("not gap and a > b")
        .select("a", "b")
        .distinct(),
        "links",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == before or seen["n"] == 0:
            break
        before = seen
        few = seen["n"] <= FEW_LINKS
        edges = edges.coalesce(1) if few else edges
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        # A link and its reverse from one row: no union, which would have two partitions.
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        both = edges.select(ends.alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # As a table, so that Spark may split the rows of a node with many links in the join.
        least = least if few else pin(least, "least")
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        )
        large = pin(large, "large-star")
        # Small star: a node and its neighbours below it go to the smallest of them.
        large = large.coalesce(1) if few else large
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        least = least if few else pin(least, "least")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = pin(small.where("a > b").distinct(), "small-star")
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias(node)).distinct().select(node, F.col(node).alias(component))
    return edges.select(F.col("a").alias(node), F.col("b").alias(component)).unionByName(roots)
