"""Steps whose cost must not outgrow their input."""

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from xmseq.model import ITEM, VECTOR
from xmseq.operators import losses
from xmseq.operators.vector_store import vector_source


def test_ranges_are_read_without_copying_them(spark):
    rows = spark.range(40_000).select(F.col("id").alias(ITEM), F.array_repeat(F.col("id").cast("double"), 64).alias(VECTOR))
    source = vector_source(rows, limit_bytes=0)
    read = source.reader()
    read(pa.array([0, 39_999]))
    before = pa.default_memory_pool().max_memory()
    held = [pa.allocate_buffer(max(before - pa.total_allocated_bytes(), 0))]  # so that the pool's peak shows what comes on top
    before = pa.default_memory_pool().max_memory()
    values, known = read(pa.array([5, 39_998, -1]))
    assert held and pa.default_memory_pool().max_memory() - before < 1 << 20
    assert known.tolist() == [True, True, False] and values[:, 63].tolist() == [5.0, 39_998.0, 0.0]


def test_log_softmax_of_a_long_array_sums_once(spark):
    scores = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: x / 3000.0).alias("s"))
    began = time.time()
    found = scores.select(losses.array_log_softmax("s")).first()[0]
    assert time.time() - began < 30
    x = np.arange(1, 3001) / 3000
    assert np.allclose(found, x - math.log(np.exp(x).sum()), atol=1e-9)


def test_sums_over_items_are_tiled():
    """Few rows against many items: scores take no more memory than a tile, and large ones are shifted."""
    import tracemalloc

    from xmseq.operators import item_blocks

    rng = np.random.default_rng(1)
    x, v = rng.normal(size=(20_000, 8)), rng.normal(size=(600, 8))
    v[:50] *= 400
    scores = v @ x.T
    high = scores.max(axis=1)
    expected = high + np.log(np.exp(scores - high[:, None]).sum(axis=1))
    group = item_blocks.Group(files=["f"], high=np.linalg.norm(x, axis=1).max(keepdims=True))
    tracemalloc.start()
    found = item_blocks.all_items_sum(v, group, lambda g, b: (None, x), None)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    assert np.allclose(found, expected, rtol=1e-12)


def test_best_items_order_only_rows_that_a_block_changes(monkeypatch):
    from xmseq.operators import item_blocks

    rng = np.random.default_rng(2)
    x, v = rng.normal(size=(8192, 6)), rng.normal(size=(64, 6))
    parts = [x[i : i + 256] for i in range(0, len(x), 256)]
    center, angle, low, high = (np.array(c) for c in zip(*map(item_blocks.describe, parts), strict=True))
    group = item_blocks.Group([""] * len(parts), [0] * len(parts), [256] * len(parts), center, angle, low, high)
    merged, merge = [], item_blocks.merge_best
    monkeypatch.setattr(item_blocks, "merge_best", lambda s, i, k: merged.append(len(s)) or merge(s, i, k))
    best, who, taken = item_blocks.best_items(v, group, lambda g, b: (np.arange(256) + 256 * b, parts[b]), None, 10, 9)
    scores = np.round(v @ x.T, 9) + 0.0
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), scores.shape), -scores), axis=1)[:, :10]
    assert (who == order).all() and (best == np.take_along_axis(scores, order, axis=1)).all()
    assert sum(merged) < 0.8 * taken.sum() / 256


def test_select_weights_takes_a_highest_layer_that_is_not_full(spark, tmp_path):
    from catalog.queries import QUERIES

    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (x + F.col("vec_id")).cast("float"))
    spark.range(200).select(F.col("id").alias("vec_id")).withColumn("embedding", vector).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["select_weights"](spark, str(tmp_path)).collect()
    assert sorted((r["weight"], r["row"]) for r in found) == [("query", n) for n in range(8)]
    assert all(r["v"].startswith(f"{193 + r['row']}000000 ") for r in found)


def test_erf_takes_little_beside_its_result():
    """The expansion of a large array is looked up piece by piece."""
    import tracemalloc

    from xmseq.operators import encoder

    x = np.linspace(-7, 7, 1 << 20).reshape(1024, 8, 128)
    tracemalloc.start()
    found = encoder.erf(x)
    assert tracemalloc.get_traced_memory()[1] < 1.5 * x.nbytes
    tracemalloc.stop()
    some = np.arange(0, x.size, 997)
    assert np.abs(found.ravel()[some] - [math.erf(v) for v in x.ravel()[some]]).max() < 1e-15


def test_equal_vectors_meet_the_items_once(spark, monkeypatch):
    from xmseq.model import MARKET, USER
    from xmseq.operators import blocks
    from xmseq.operators.scoring import SEQ_VECTOR

    rng = np.random.default_rng(3)
    x = [v.tolist() for v in rng.normal(size=(12, 4))]
    items = spark.createDataFrame([(m, i, x[i]) for m in "ab" for i in range(12)], f"{MARKET} string, {ITEM} bigint, {VECTOR} array<double>")
    told = [("ab"[n % 2], n, n % 12, x[n % 3]) for n in range(60)] + [("a", 60, 1, None), ("c", 61, 1, x[0]), (None, 62, 1, x[0]), ("b", 63, 99, x[1])]
    rows = spark.createDataFrame(told * 2, f"{MARKET} string, {USER} bigint, {ITEM} bigint, {SEQ_VECTOR} array<double>")
    met, sums = [], blocks.all_item_logsumexp
    monkeypatch.setattr(blocks, "all_item_logsumexp", lambda each, *a, **k: met.append(each.count()) or sums(each, *a, **k))
    for limit in (1 << 20, 0):
        plain, shared = (losses.all_item_nll(rows, items, [USER], shared=s, limit_bytes=limit).collect() for s in (False, True))
        plain, shared = ([r.asDict() for r in sorted(found, key=lambda r: r[USER])] for found in (plain, shared))
        assert len(plain) == len(shared) == 124
        for p, s in zip(plain, shared, strict=True):
            assert p.keys() == s.keys() and all(p[c] == s[c] or (c == "nll" and abs(p[c] - s[c]) < 1e-12) for c in p)
    # Three vectors in either market, the missing one and the one of a market without items.
    assert met == [9, 9] or met == [8, 8]


def test_pooled_vectors_are_not_shuffled_by_place(spark):
    """A row of a sequence passes on one sum, and rows of one key are one sequence, as where vectors are joined."""
    from xmseq.model import SEQ, USER
    from xmseq.operators import vectors

    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], f"{ITEM} bigint, {VECTOR} array<double>")
    told = [(1, [0, 1, 2, 1]), (2, [8, 77, 3]), (2, [4, 5]), (3, [1, 77]), (None, [6]), (None, [7, 2]), (4, []), (5, None), (6, [2, None, 4])]
    seqs = spark.createDataFrame(told, f"{USER} bigint, {SEQ} array<bigint>")
    few = table.where(f"{ITEM} <> 5")
    for values in (None, few):
        expected = vectors._joined_pool(seqs, table, table, table if values is None else values, [USER], 1 << 20).collect()
        for limit in (1 << 20, 0):
            found = vectors.attention_pool(seqs, table, None, values, [USER], limit)
            assert "Window" not in found._jdf.queryExecution().toString()
            found = {r[USER]: r["pooled"] for r in found.collect()}
            assert found.keys() == {r[USER] for r in expected}
            for r in expected:
                mine = found[r[USER]]
                assert (mine is None) == (r["pooled"] is None) and (mine is None or np.allclose(mine, r["pooled"], rtol=1e-12))


def test_log_softmax_of_few_groups_moves_no_row(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") / 100).alias("score"))
    rows = rows.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    found = losses.log_softmax(rows, ["g"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    totals = found.groupBy("g").agg(F.sum(F.exp("log_p")).alias("p"), F.count("*").alias("n")).collect()
    assert {r["g"]: r["n"] for r in totals} == {None: 334, 1: 333, 2: 333} and all(abs(r["p"] - 1) < 1e-9 for r in totals)


def test_best_items_take_few_products_in_double():
    """Single precision tells which rows a block cannot change; scores closer than it can tell are still put in order."""
    from xmseq.operators import item_blocks

    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 16))
    parts = [rng.normal(size=(64, 16)) for _ in range(40)]
    # Copies that differ by less than single precision can tell, the better ones in blocks that come later.
    for n in range(1, 40):
        parts[n][:8] = parts[0][:8] * (1 + n * 1e-8)
    taken = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            taken.append((self.dtype, len(self)))
            return np.asarray(self) @ other

    center, angle, low, high = (np.array(c) for c in zip(*map(item_blocks.describe, parts), strict=True))
    group = item_blocks.Group([""] * len(parts), [0] * len(parts), [64] * len(parts), center, angle, low, high)
    best, who, _ = item_blocks.best_items(v.view(Counted), group, lambda g, b: (np.arange(64) + 64 * b, parts[b]), None, 10, 9)
    scores = np.round(v @ np.concatenate(parts).T, 9)
    order = [sorted(range(scores.shape[1]), key=lambda i: (-s[i], i))[:10] for s in scores]
    assert np.asarray(who).tolist() == order
    assert np.allclose(best, np.take_along_axis(scores, np.array(order), axis=1), rtol=0, atol=2e-9)
    rows = {kind: sum(n for t, n in taken if t == kind) for kind in (np.float32, np.float64)}
    assert rows[np.float32] > 0.9 * 300 * 40 and rows[np.float64] < rows[np.float32] * 0.8


def test_best_items_of_lengths_beyond_single_precision():
    from xmseq.operators import item_blocks

    parts = [np.array([[-1e200, 1.0], [-2e200, 1.0]]), np.array([[-1e199, 1.0], [-3e200, 1.0]])]
    center, angle, low, high = (np.array(c) for c in zip(*map(item_blocks.describe, parts), strict=True))
    group = item_blocks.Group([""] * 2, [0] * 2, [2] * 2, center, angle, low, high)
    _, who, _ = item_blocks.best_items(np.array([[1.0, 0.0]]), group, lambda g, b: (np.arange(2) + 2 * b, parts[b]), None, 2, 0)
    assert who.tolist() == [[2, 0]]


def test_gelu_takes_no_space_beside_its_result():
    import tracemalloc

    from xmseq.operators import encoder

    x = np.random.default_rng(6).normal(size=(2000, 500)) * 3
    tracemalloc.start()
    found = encoder.ACTIVATIONS["gelu"](x)
    assert tracemalloc.get_traced_memory()[1] < 1.3 * x.nbytes
    tracemalloc.stop()
    expected = [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x[:3].ravel()]
    assert np.abs(found[:3].ravel() - expected).max() < 1e-14
