"""Centroid clustering of whole-number vectors, the nearest centroid found by the threshold algorithm.

Each dimension has its list of centroids sorted by value. A vector starts in every list at its own value and walks
outward, always to the nearer of the two neighbours not yet seen. A centroid met in any list has its exact distance
computed. No centroid still unseen can be nearer than the sum of the squared distances at the frontiers of all lists, so
the walk ends when that sum strictly exceeds the best exact distance; at equality an unseen centroid of a smaller number
could still tie.

Vectors stay in their partitions. A task sends only sums and counts by centroid and dimension, and only the centroids,
`k` times `width` whole numbers, go to the driver and back. All arithmetic is in whole numbers: 64 bits where they provably
hold every distance, Python's otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.storage import pin

SCALE = 1024
ROWS = 4096
#: Larger components could not be summed in a decimal of 38 digits.
LARGEST = 1e24
LONG = 2**63 - 1
NUMBER = pa.decimal128(38, 0)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly, in 64 bits where a distance of such numbers fits, in Python's integers otherwise."""
    scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0.0) < narrow(values.shape[-1]):
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object).reshape(values.shape)


def narrow(width: int) -> int:
    """Components below this have squared distances, and sums of ROWS of them, within 64 bits."""
    return int((2**62 / max(1, width)) ** 0.5 / 2)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the centroid nearest to each row of `x`; ties go to the smaller number."""
    n, width = x.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    dims = np.arange(width)
    cluster, best = np.full(n, k), np.zeros(n, x.dtype)
    seen = np.zeros((n, k), bool)
    right = np.sum(values[None] < x[:, None, :], axis=1) if k else np.zeros((n, width), np.int64)
    left = right - 1
    active = np.arange(n)
    for _ in range(k):
        here, lo, hi = x[active], left[active], right[active]
        down = np.where(lo >= 0, here - values[np.maximum(lo, 0), dims], -1)
        up = np.where(hi < k, values[np.minimum(hi, k - 1), dims] - here, -1)
        back = (down >= 0) & ((up < 0) | (down <= up))
        back = back.astype(bool)
        met = order[np.where(back, np.maximum(lo, 0), np.minimum(hi, k - 1)), dims]
        left[active] -= back
        right[active] += ~back
        fresh = np.zeros((len(active), k), bool)
        fresh[np.repeat(np.arange(len(active)), width), met.ravel()] = True
        fresh &= ~seen[active]
        seen[active] |= fresh
        for c in range(k):
            rows = np.flatnonzero(fresh[:, c])
            if len(rows):
                d = ((here[rows] - centroids[c]) ** 2).sum(axis=1)
                at = active[rows]
                better = (cluster[at] == k) | (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
                best[at[better.astype(bool)]], cluster[at[better.astype(bool)]] = d[better.astype(bool)], c
        frontier = np.where(back, down, up)
        active = active[((frontier**2).sum(axis=1) <= best[active]).astype(bool)]
        if not len(active):
            break
    return cluster, best


def blocks(batches: Iterator[pa.RecordBatch], column: str, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, whole(part.column(column).flatten().to_numpy().reshape(-1, width), scale)


def same_kind(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in one kind of number, 64 bits only if both fit."""
    width = x.shape[1]
    if x.dtype == np.int64 and all(abs(v) < narrow(width) for row in centroids for v in row):
        return x, np.array(centroids, np.int64).reshape(-1, width)
    wide = np.empty((len(centroids), width), object)
    wide[:] = centroids
    return x.astype(object), wide


def next_centroids(kept: DataFrame, column: str, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    width = len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * width for _ in centroids]
        count = [0] * len(centroids)
        for _, x in blocks(batches, column, width, scale):
            x, centers = same_kind(x, centroids)
            cluster, _ = nearest(x, centers)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                total[c] = [a + b for a, b in zip(total[c], own.sum(axis=0).tolist(), strict=True)]
                count[c] += len(own)
        rows = [(c, d, Decimal(total[c][d]), count[c]) for c in range(len(centroids)) if count[c] for d in range(width)]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.int32(), pa.int32(), NUMBER, pa.int64())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["cluster", "dim", "total", "n"])

    sums = kept.select(column).mapInArrow(add, "cluster int, dim int, total decimal(38,0), n bigint")
    out = [list(c) for c in centroids]
    for row in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[row["cluster"]][row["dim"]] = int(row["total"]) // row["n"]
    return out


def clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = SCALE, seed: str = "3", id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Cluster vectors around `k` centroids after `rounds` rounds of assignment and exact floored means.

    vectors: an id and an array of numbers; other columns are ignored, whatever their names. Kept are arrays of exactly
    `width` components, none null, none non-finite and none beyond 1e24 once scaled, where sums would leave 38 digits;
    each component becomes floor(scale * x). Centroids start as the kept vectors with the smallest sha256 of
    `seed:id` (equal ids by their components), so rows without an id, which are kept and clustered too, never start one.
    Fewer than `k` ids start fewer centroids; none gives an empty result. Rows that share an id or a vector are all returned.

    Returns per kept row: id, cluster int, distance long (squared), cluster_inertia and inertia long (distances summed over
    the cluster and over all), centroid array of decimal(38,0). A distance or sum beyond 64 bits is null.
    """
    ok = F.col(column).isNotNull() & (F.size(column) == width)
    doubles = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LARGEST / scale), F.lit(False)))
    kept = vectors.select(F.col(id_column).alias("id"), F.when(ok & fine, doubles).alias("x")).where("x is not null")
    kept = pin(kept, "vectors")
    hashed = kept.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    start = hashed.orderBy("h", "x").limit(k).select("x").collect()
    schema = f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance decimal(38,0)"
    centroids = [whole(np.array([row["x"]], np.float64), scale)[0].tolist() for row in start]
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(kept, "x", centroids, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, "x", width, scale):
            cluster, distance = nearest(*same_kind(x, centroids))
            squared = [Decimal(d) if d < 10**38 else None for d in distance.tolist()]
            yield pa.record_batch([part.column("id"), pa.array(cluster, pa.int32()), pa.array(squared, NUMBER)], ["id", "cluster", "distance"])

    if not centroids:
        kept = kept.limit(0)
    found = pin(kept.mapInArrow(assign, schema), "clusters")
    one = F.when(F.count("*") == F.count("distance"), F.try_sum("distance"))
    # At most k rows, one per centroid.
    sums = found.groupBy("cluster").agg(one.alias("part")).collect()
    parts = [(r["cluster"], r["part"]) for r in sums]
    total = None if any(p is None for _, p in parts) else sum((int(p) for _, p in parts), 0)
    long = [(c, [Decimal(v) for v in centroids[c]], None if p is None or p > LONG else int(p), None if total is None or total > LONG else total) for c, p in parts]
    table = vectors.sparkSession.createDataFrame(long, "cluster int, centroid array<decimal(38,0)>, cluster_inertia bigint, inertia bigint")
    out = found.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id_column),
        "cluster",
        F.when(F.col("distance") <= LONG, F.col("distance")).cast("bigint").alias("distance"),
        "cluster_inertia",
        "inertia",
        "centroid",
    )
    return out
