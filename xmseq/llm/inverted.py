"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document has a MinHash signature. It is posted under (coordinate, value) pairs: two documents that agree in at least
m of K coordinates share a pair among the first K-m+1 of each, in any order common to all. The order puts frequent pairs
last, so most lists are short. Documents of a list are candidates when m coordinates agree; the groups that candidates
form are then checked on the full shingle sets. The answer needs components only, so within a list or group a link between
documents already joined is not looked for, and nothing is emitted for each pair.

Lists and groups of any size are cut into blocks. Their members first meet one of them, the center. Those that agree with
it are joined by that; only the others are compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.llm.groups import Sets, by_group, releasing
from xmseq.llm.minhash import signatures
from xmseq.llm.store import components
from xmseq.llm.verify import confirmed, shingle_sets
from xmseq.storage import pin

COORDINATES = 64
#: More frequent pairs than a share of 1/HOT_PAIRS are listed on the driver: at most COORDINATES * HOT_PAIRS / 64.
HOT_PAIRS = 100_000
HOT_LEAST = 64
BLOCK = 512
CHUNK = 2048
SEED = 7


def least_matches(percent: int, coordinates: int = COORDINATES) -> int:
    """Coordinates that must agree: four standard deviations below what is expected at the threshold."""
    p = percent / 100
    return max(1, int(coordinates * p - 4 * (coordinates * p * (1 - p)) ** 0.5))


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """Per row: id, size of its shingle set, two hashes of the set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = list(shingle_sets(part.column("text"), k))
                n = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                sums = np.zeros((2, len(n)), np.uint64)
                full = n > 0
                if full.any():
                    first = (np.cumsum(n) - n)[full]
                    sums[0, full] = np.add.reduceat(flat, first)
                    sums[1, full] = np.add.reduceat(flat * flat, first)
                s = signatures(flat, n, COORDINATES, SEED)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n), *(pa.array(x.view(np.int64)) for x in sums),
                     pa.array([r.tobytes() for r in s], pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "signature"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        releasing(run), f"doc_id {kind}, n_shingles bigint, s1 bigint, s2 bigint, signature binary"
    )


def unpack(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of fixed width as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width)


def pairs_of(signature: np.ndarray) -> np.ndarray:
    """(coordinate, value) of each place as one number."""
    return (np.arange(signature.shape[1], dtype=np.int64) << 32) | signature.astype(np.int64)


class Order:
    """The common order of pairs: frequent ones last. Plain arrays of the frequent pairs, sorted."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, m: int):
        self.pairs, self.counts, self.m = pairs, counts, m

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """Place among the frequent pairs, -1 for others."""
        if not len(self.pairs):
            return np.full(pairs.shape, -1)
        at = np.searchsorted(self.pairs, pairs).clip(0, len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, at, -1)

    def prefix(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first K-m+1 pairs of each row in the common order, and their places among the frequent ones."""
        places = self.places(pairs)
        often = np.where(places < 0, 0, self.counts[places] if len(self.counts) else 0)
        # Places are in the order of the pairs, so a stable sort by frequency is one order for all rows.
        first = np.argsort(often, axis=1, kind="stable")[:, : pairs.shape[1] - self.m + 1]
        return np.take_along_axis(pairs, first, 1), np.take_along_axis(places, first, 1)


def frequent_pairs(classes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs above a share of the rows and their counts; bounded by COORDINATES * HOT_PAIRS / 64 whatever n is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.sort(pairs_of(unpack(batch.column("signature"), "<u4", COORDINATES)), axis=None)
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(pairs[first]), pa.array(np.diff(np.append(first, len(pairs))))], ["pair", "n"])

    least = max(HOT_LEAST, COORDINATES * n // HOT_PAIRS)
    counts = classes.select("signature").mapInArrow(releasing(run), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = sorted((r["pair"], r["n"]) for r in counts.where(F.col("n") > least).collect())
    return np.array([p for p, _ in found], np.int64), np.array([c for _, c in found], np.int64)


def centers_of(classes: DataFrame, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """For each frequent pair the smallest document whose prefix has it, and the low bytes of its signature."""
    n = len(order.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = unpack(batch.column("signature"), "<u4", COORDINATES)
            pairs, places = order.prefix(pairs_of(s))
            row, col = np.nonzero(places >= 0)
            rep = batch.column("rep").to_numpy()[row]
            by = np.lexsort((rep, places[row, col]))
            row, place, rep = row[by], places[row, col][by], rep[by]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
            low = [x.tobytes() for x in s[row[first]].astype(np.uint8)]
            yield pa.record_batch([pa.array(place[first]), pa.array(rep[first]), pa.array(low, pa.binary())], ["p", "rep", "low"])

    best = classes.select("rep", "signature").mapInArrow(releasing(run), "p bigint, rep bigint, low binary")
    reps, lows = np.full(n, -1, np.int64), np.zeros((n, COORDINATES), np.uint8)
    if n:
        for r in best.groupBy("p").agg(F.min(F.struct("rep", "low")).alias("x")).select("p", "x.*").collect():
            reps[r["p"]], lows[r["p"]] = r["rep"], np.frombuffer(r["low"], np.uint8)
    return reps, lows


def others_of(classes: DataFrame, order: Order, centers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each frequent pair: its rows in prefixes, and those of them that don't agree with the center."""
    _, lows = centers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = unpack(batch.column("signature"), "<u4", COORDINATES)
            _, places = order.prefix(pairs_of(s))
            row, col = np.nonzero(places >= 0)
            place = places[row, col]
            apart = agree(s[row].astype(np.uint8), lows[place]) < order.m
            each = np.unique(place)
            total, other = np.bincount(place, minlength=1), np.bincount(place[apart], minlength=int(place.max(initial=0)) + 1)
            yield pa.record_batch([pa.array(each), pa.array(total[each]), pa.array(other[each])], ["p", "n", "other"])

    sizes, others = np.zeros(len(order.pairs), np.int64), np.zeros(len(order.pairs), np.int64)
    if len(order.pairs):
        found = classes.select("rep", "signature").mapInArrow(releasing(run), "p bigint, n bigint, other bigint")
        for r in found.groupBy("p").agg(F.sum("n").alias("n"), F.sum("other").alias("other")).collect():
            sizes[r["p"]], others[r["p"]] = r["n"], r["other"]
    return sizes, others


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal places of the rows of two byte matrices, a few MB at a time."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 1 << 15):
        out[at : at + (1 << 15)] = (a[at : at + (1 << 15)] == b[at : at + (1 << 15)]).sum(1)
    return out


def spread(pair: np.ndarray, rep: np.ndarray, low: np.ndarray, new: np.ndarray, n: np.ndarray, other: np.ndarray):
    """Copies of the rows of frequent pairs: each block of rows apart from the center meets each chunk of the list.

    Yields key columns (pair, block, chunk), the row, and whether it stands for its block (compared with all) or chunk.
    """
    some = other > 0
    pair, rep, low, new, n, other = (x[some] for x in (pair, rep, low, new, n, other))
    blocks, chunks = -(-other // BLOCK), -(-n // CHUNK)
    at = (rep * 0x9E3779B1) & 0x7FFFFFFF
    for copies, mine, fixed, lead in ((np.where(new, chunks, 0), "chunk", at % blocks, True), (blocks, "block", at % chunks, False)):
        i = np.repeat(np.arange(len(pair)), copies)
        step = np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
        block, chunk = (fixed[i], step) if mine == "chunk" else (step, fixed[i])
        keep = np.ones(len(i), bool) if lead else ~(new[i] & (at[i] % blocks[i] == block))
        i, block, chunk = i[keep], block[keep], chunk[keep]
        yield pair[i], block, chunk, rep[i], low[i], np.full(len(i), lead)


def candidate_links(classes: DataFrame, m: int) -> DataFrame:
    """Links (u, v) whose components hold every pair of documents that agree in at least m coordinates."""
    n = classes.count()
    order = Order(*frequent_pairs(classes, n), m)
    centers = centers_of(classes, order)
    sizes, others = others_of(classes, order, centers)
    names = ["pair", "block", "chunk", "rep", "low", "lead", "center"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                s = unpack(part.column("signature"), "<u4", COORDINATES)
                reps, lows = part.column("rep").to_numpy(), s.astype(np.uint8)
                pairs, places = order.prefix(pairs_of(s))
                row, col = np.nonzero(places < 0)
                parts = [(pairs[row, col], 0 * row, 0 * row, reps[row], lows[row], np.ones(len(row), bool))]
                row, col = np.nonzero(places >= 0)
                place = places[row, col]
                new = agree(lows[row], centers[1][place]) < m
                parts += spread(pairs[row, col], reps[row], lows[row], new, sizes[place], others[place])
                joined = [np.concatenate([p[i] for p in parts]) for i in range(6)]
                none = np.full(len(joined[0]), -1)
                met = pairs_with(reps[row][~new], centers[0][place[~new]])
                columns = [pa.array(np.append(x, np.full(len(met), y)).astype(t)) for x, y, t in (
                    (joined[0], -1, np.int64), (joined[1], 0, np.int64), (joined[2], 0, np.int64))]
                columns[0] = pa.array(np.append(joined[0], -1 - met[:, 0] % (1 << 20)))
                rep = np.append(joined[3], met[:, 0])
                low = [x.tobytes() for x in joined[4]] + [b""] * len(met)
                lead = np.append(joined[5], np.zeros(len(met), bool))
                yield pa.record_batch(
                    [*columns, pa.array(rep), pa.array(low, pa.binary()), pa.array(lead), pa.array(np.append(none, met[:, 1]))], names
                )

    def match(table: pa.Table, starts: np.ndarray) -> pa.Table:
        center, rep = table.column("center").to_numpy(), table.column("rep").to_numpy()
        links = [np.stack([rep, center], 1)[center >= 0]]
        rows = np.flatnonzero(center < 0)
        if len(rows):
            table = table.take(pa.array(rows))
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[rows]
            rep, lead = rep[rows], table.column("lead").to_numpy(zero_copy_only=False)
            low = unpack(table.column("low"), "u1", COORDINATES)
            known = Sets(len(rep))
            for d in range(1, len(rep)):
                i = np.flatnonzero(group[d:] == group[:-d])
                if not len(i):
                    break
                i = i[(lead[i] | lead[i + d]) & (rep[i] != rep[i + d])]
                i = i[agree(low[i], low[i + d]) >= m]
                new = [known.join(a, a + d) for a in i.tolist()]
                links.append(np.stack([rep[i], rep[i + d]], 1)[np.array(new, bool)])
        links = np.unique(np.concatenate(links), axis=0) if sum(map(len, links)) else np.zeros((0, 2), np.int64)
        return pa.table({"u": links[:, 0], "v": links[:, 1]})

    rows = classes.select("rep", "signature").mapInArrow(
        releasing(post), "pair bigint, block bigint, chunk bigint, rep bigint, low binary, lead boolean, center bigint"
    )
    return by_group(rows, ["pair", "block", "chunk"], match, "u bigint, v bigint")


def pairs_with(rep: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Distinct (document, center) rows, a document with itself left out."""
    both = np.stack([rep, center], 1)[rep != center]
    return np.unique(both, axis=0) if len(both) else both.reshape(0, 2)


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links documents whose sets of k-word shingles have Jaccard of at least percent/100; component_id is the smallest doc_id
    reachable. A null or empty text has no shingle and links with nothing; a row without doc_id is kept, with a null
    component. Rows that share a doc_id are one document. Other columns are ignored. Every link is confirmed on the full
    sets; a pair is missed when its signatures agree four standard deviations less than expected.
    """
    m = least_matches(percent)
    docs = docs.select("doc_id", "text")
    sets = pin(document_sets(docs, k), "shingle-sets")
    some = sets.where("n_shingles > 0 and doc_id is not null")
    classes = pin(
        some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "set-classes"
    )
    groups = pin(components(candidate_links(classes.select("rep", "signature"), m)), "candidate-groups")
    joined = confirmed(docs, groups, k, percent)
    named = classes.select("s1", "s2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    linked = some.drop("signature").join(named, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    alone = sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
