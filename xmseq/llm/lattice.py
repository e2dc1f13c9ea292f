"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the lattice E8.

A table projects a direction to eight dimensions and takes the nearest E8 point as its cell. A vector is posted at its own
cell and at the neighbouring cells whose points come next in distance; two vectors meet where one is at home and the other
is posted. Those that meet are compared by cosine, as blocks of matrix products. A pair may meet in several cells and
tables; every posting carries all cells of its vector, so the pair is counted in one of them, without a shuffle of pairs.
Equal vectors are one posting with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.llm.groups import Sets, by_group
from xmseq.llm.store import components
from xmseq.llm.words import mix
from xmseq.storage import pin

TABLES = 8
PROBES = 2
SCALE = 1.0
SEED = 5
#: Cells above this many postings are cut into blocks. Those above a share of 1/HOT_CELLS of all are known by name.
BLOCK = 1024
HOT_CELLS = 100_000


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            x = np.zeros(8)
            x[i], x[j] = a, b
            rows.append(x)
    rows += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(rows)


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest point with integer entries of even sum."""
    p = np.rint(y)
    odd = np.flatnonzero(p.sum(1) % 2)
    gap = y[odd] - p[odd]
    worst = np.abs(gap).argmax(1)
    p[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return p


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point: of integers of even sum, or of such points moved by 1/2."""
    a, b = nearest_even(y), nearest_even(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Cell codes of unit vectors: for each table the own cell, then `probes` neighbours; tables * (1 + probes) columns."""
    r, out = neighbours(), []
    for t in range(tables):
        project = np.random.default_rng((SEED, t, unit.shape[1])).normal(size=(unit.shape[1], 8))
        y = unit @ project * scale
        home = nearest_e8(y)
        near = np.argsort(-((y - home) @ r.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None], home[:, None] + r[near]], 1)
        code = np.full(points.shape[:2], t, np.uint64)
        for i in range(8):
            code = mix(code ^ (np.rint(points[:, :, i] * 2).astype(np.int64) + 0x7A3D5).view(np.uint64))
        out.append(code.view(np.int64))
    return np.concatenate(out, 1) if out else np.zeros((len(unit), 0), np.int64)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; divided by their largest number first, so that no square leaves the range."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def postings(batch: pa.RecordBatch, tables: int, probes: int, scale: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For the vectors of each length in a batch: rows, unit vectors in double precision, codes salted by label."""
    lengths = np.asarray(batch.column("embedding").value_lengths())
    for d in np.unique(lengths).tolist():
        for part in np.array_split(rows := np.flatnonzero(lengths == d), -(-len(rows) // 1024)):
            x = unit_vectors(batch.column("embedding").take(pa.array(part)).flatten().to_numpy().reshape(-1, d))
            label = batch.column("label").to_numpy()[part].astype(np.int64).view(np.uint64)
            codes = cells(x, tables, probes, scale).view(np.uint64)
            yield part, x, mix(codes ^ mix(label + np.uint64(d << 32))[:, None]).view(np.int64)


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE
) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Links two rows of equal label, not null, whose cosine in double precision is at least `cosine`; n_links counts the other
    rows linked directly, component_id is the smallest vec_id reachable. A vector that is null, empty, zero, or holds a null
    or a non-finite number links with nothing, nor does one of another length. Links are found by lattice cells and all
    confirmed; `tables`, `probes` and `scale` (cells shrink as it grows) set how few are missed.

    Rows that share a vec_id are rows of their own, with links of their own. A row without vec_id links with nothing, has no
    component and is kept. Other columns are ignored, whatever their names; no rows give no rows.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("label").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "embedding", "label", F.coalesce(fit, F.lit(False)).alias("fit"))
    kinds = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # Distinct vectors have numbers of their own: one vec_id may come with several.
    kinds = pin(kinds.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")
    width = tables * (1 + probes)
    home = np.zeros(width, bool)
    home[:: 1 + probes] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, codes in postings(batch, tables, probes, scale):
                each, n = np.unique(codes, return_counts=True)
                yield pa.record_batch([pa.array(each), pa.array(n)], ["code", "n"])

    least = max(BLOCK, width * kinds.count() // HOT_CELLS)
    sizes = kinds.mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    found = sorted((r["code"], r["n"]) for r in sizes.where(F.col("n") > least).collect())
    hot, hot_blocks = np.array([c for c, _ in found], np.int64), np.array([-(-n // BLOCK) for _, n in found], np.int64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            for part, x, codes in postings(batch, tables, probes, scale):
                row = np.repeat(np.arange(len(part)), width)
                code, blocks = codes.ravel(), np.ones(codes.size, np.int64)
                if len(hot):
                    at = np.searchsorted(hot, code).clip(0, len(hot) - 1)
                    blocks = np.where(hot[at] == code, hot_blocks[at], 1)
                own = (rep[part][row] * 0x9E3779B1 & 0x7FFFFFFF) % blocks
                again = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                lo, hi = np.minimum(own[again], other), np.maximum(own[again], other)
                for to in np.array_split(np.arange(len(again)), -(-len(again) // 8192)):
                    i = row[again[to]]
                    yield pa.record_batch(
                        [
                            pa.array(code[again[to]]),
                            pa.array(lo[to]),
                            pa.array(hi[to]),
                            pa.array(own[again[to]]),
                            pa.array(rep[part][i]),
                            pa.array(copies[part][i]),
                            batch.column("embedding").take(pa.array(part[i])).cast(pa.list_(pa.float64())) if wide else batch.column("embedding").take(pa.array(part[i])),
                            pa.array([c.tobytes() for c in codes[i]], pa.binary()),
                        ],
                        ["code", "lo", "hi", "own", "rep", "copies", "embedding", "codes"],
                    )

    def meet(table: pa.Table, starts: np.ndarray) -> pa.Table:
        counts, links = [], []
        big = np.flatnonzero(np.diff(starts) > 1)
        columns = {c: table.column(c).to_numpy() for c in ("code", "lo", "hi", "own", "rep", "copies")}
        for lo, hi in zip(starts[big].tolist(), starts[big + 1].tolist(), strict=True):
            part = table.slice(lo, hi - lo)
            x = unit_vectors(part.column("embedding").combine_chunks().flatten().to_numpy().reshape(hi - lo, -1))
            code, first, second = (columns[c][lo] for c in ("code", "lo", "hi"))
            own, rep, copies = (columns[c][lo:hi] for c in ("own", "rep", "copies"))
            codes = np.array([np.frombuffer(b, np.int64) for b in part.column("codes").to_pylist()])
            here = (codes[:, home] == code).any(1)
            known = Sets(hi - lo)
            left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
            for a in np.array_split(left, -(-len(left) // 256)) if len(left) and len(right) else []:
                i, j = np.nonzero(x[a] @ x[right].T >= cosine)
                i, j = a[i], right[j]
                keep = (here[i] | here[j]) & ((i < j) if first == second else True)
                i, j = i[keep], j[keep]
                for k in range(0, len(i), 2048):
                    once = first_meeting(codes[i[k : k + 2048]], codes[j[k : k + 2048]], home) == code
                    u, v = i[k : k + 2048][once], j[k : k + 2048][once]
                    counts += [(rep[u], copies[v]), (rep[v], copies[u])]
                    links += [(rep[p], rep[q]) for p, q in zip(u.tolist(), v.tolist(), strict=True) if known.join(p, q)]
        u = np.concatenate([np.zeros(0, np.int64), *(c[0] for c in counts)])
        n = np.concatenate([np.zeros(0, np.int64), *(c[1] for c in counts)])
        each, place = np.unique(u, return_inverse=True)
        n = np.bincount(place, n, len(each)).astype(np.int64)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"u": np.append(each, pairs[:, 0]), "v": pa.array([None] * len(each) + pairs[:, 1].tolist(), pa.int64()), "n": np.append(n, pairs[:, 0] * 0)})

    wide = "double" in kinds.schema["embedding"].simpleString()
    schema = f"code bigint, lo bigint, hi bigint, own bigint, rep bigint, copies bigint, embedding array<{'double' if wide else 'float'}>, codes binary"
    met = pin(by_group(kinds.mapInArrow(post, schema), ["code", "lo", "hi"], meet, "u bigint, v bigint, n bigint"), "met")
    counts = met.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(met.where("v is not null")).withColumnRenamed("node", "rep")
    joined = pin(joined, "joined-vectors")
    named = joined.join(kinds.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("smallest"))
    known = kinds.join(counts, "rep", "left").join(joined, "rep", "left").join(named, "component", "left").select(
        "label",
        "embedding",
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("smallest", "least").alias("component_id"),
    )
    linked = rows.where("fit").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def first_meeting(a: np.ndarray, b: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The smallest code at which each pair of rows meets: posted by both, and home to one."""
    most = np.iinfo(np.int64).max
    out = np.full(len(a), most)
    for k in np.flatnonzero(home):
        out = np.minimum(out, np.where((b == a[:, k : k + 1]).any(1), a[:, k], most))
        out = np.minimum(out, np.where((a == b[:, k : k + 1]).any(1), b[:, k], most))
    return out
