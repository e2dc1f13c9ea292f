"""Confirmation of candidate groups on the full shingle sets of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.llm.groups import Sets, by_group
from xmseq.llm.store import components
from xmseq.llm.words import bounds, hashes, shingles, slices, text_bytes
from xmseq.storage import pin

#: Texts compared within one task; larger groups are cut into parts of this size.
GROUP = 256


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    data, offsets = text_bytes(texts)
    for lo, hi in slices(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, counts = bounds(part, own)
        found, n = shingles(hashes(part, starts, ends, lower=True), counts, k)
        at = 0
        for c in n.tolist():
            x = np.sort(found[at : at + c])
            yield x[np.append(True, x[1:] != x[:-1])] if c else x
            at += c


def verified_links(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between documents of a group whose full shingle sets are alike, as far as `joined` doesn't join them.

    members: g1, g2, g3 (the group), rep, text, lead (compared with all), joined (a number: equal ones are joined).
    """

    def verify(table: pa.Table, starts: np.ndarray) -> pa.Table:
        rep, joined = table.column("rep").to_numpy(), table.column("joined").to_numpy()
        lead = table.column("lead").to_numpy(zero_copy_only=False)
        text, out = table.column("text"), []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < 2:
                continue
            sets = list(shingle_sets(text.slice(lo, hi - lo).combine_chunks(), k))
            known, first = Sets(hi - lo), {}
            for i, c in enumerate(joined[lo:hi].tolist()):
                known.join(first.setdefault(c, i), i)
            for i in range(hi - lo):
                for j in range(i):
                    if (lead[lo + i] or lead[lo + j]) and known.find(i) != known.find(j) and alike(sets[i], sets[j], percent):
                        known.join(i, j)
                        out.append((rep[lo + i], rep[lo + j]))
        out = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"u": out[:, 0], "v": out[:, 1]})

    return by_group(members, ["g1", "g2", "g3"], verify, "u bigint, v bigint")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or not len(a):
        return False
    both = int((b[np.searchsorted(b, a).clip(0, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(docs: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the documents that have a link, links being Jaccard of k-word shingle sets >= percent/100.

    docs: doc_id, text. groups: (node, component), such that linked documents share a component. A group above GROUP texts
    is cut into parts that all hold its smallest document. Those that end up joined with it need no more comparing; the
    others meet all parts, in blocks.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    sized = groups.join(sizes, "component")
    # Texts are shuffled at every size: whether the groups could be broadcast depends on the data.
    texts = docs.withColumnRenamed("doc_id", "node").join(sized.hint("merge"), "node")
    members = pin(texts.select(F.col("component").alias("g1"), F.col("node").alias("rep"), "text", "n"), "group-texts")
    parts = F.ceil(F.col("n") / GROUP)
    own = F.pmod(F.xxhash64("rep"), parts)
    # The smallest member is the center: it goes to every part.
    center = F.when(F.col("rep") == F.col("g1"), F.sequence(F.lit(0).cast("bigint"), parts - 1)).otherwise(F.array(own))
    split = members.select("g1", F.explode(center).alias("g2"), F.lit(0).alias("g3"), "rep", "text", F.lit(True).alias("lead"), F.col("rep").alias("joined"))
    links = pin(verified_links(split, k, percent), "verified-links")
    joined = pin(components(links), "joined")
    large = members.where(F.col("n") > GROUP)
    if not large.isEmpty():
        named = large.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("joined", F.coalesce("component", "rep"))
        named = named.withColumn("apart", F.col("joined") != F.col("g1"))
        rest = named.where("apart").groupBy("g1").agg(F.count("*").alias("others"))
        named = named.join(rest, "g1")  # a group without others is done
        blocks = F.ceil(F.col("others") / GROUP)
        block = F.pmod(F.xxhash64("rep"), blocks)
        lead = named.where("apart").select("g1", block.alias("g2"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("g3"), "rep", "text", F.lit(True).alias("lead"), "joined")
        rows = named.select("g1", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("g2"), own.alias("g3"), "rep", "text", F.lit(False).alias("lead"), "joined", "apart", block.alias("b"))
        rows = rows.where("not (apart and b = g2)").drop("apart", "b")
        more = pin(verified_links(lead.unionByName(rows), k, percent), "verified-links")
        if not more.isEmpty():
            joined = pin(components(links.unionByName(more)), "joined")
    return joined
