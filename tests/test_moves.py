"""What is moved, read and written by the work of a row: as little as the result asks for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from xmseq.model import ITEM, MARKET, TIME, USER, VECTOR
from xmseq.operators import causal, item_blocks, lookup, losses
from xmseq.operators.scoring import SEQ_VECTOR

RNG = np.random.default_rng(8)
ITEMS = f"{MARKET} string, {ITEM} bigint, {VECTOR} array<float>"


def vector(width=4):
    return RNG.normal(size=width).tolist()


def test_targets_meet_their_vectors_where_they_are(spark, monkeypatch):
    """Above the broadcast limit no row is shuffled, so that what makes it runs once; keys may repeat or be missing."""
    told = [("ab"[n % 2], n, n % 9, vector()) for n in range(40)] + [(None, 41, 1, vector()), ("a", None, None, vector()), ("c", 42, 1, vector())]
    rows = spark.createDataFrame(told, f"{MARKET} string, {USER} bigint, {ITEM} bigint, {SEQ_VECTOR} array<double>")
    once = [(m, i, vector()) for m in "ab" for i in range(7)] + [("a", 7, None), (None, 1, vector()), (None, 1, vector())]
    for told, moved in ((once, False), ([*once, ("a", 3, vector())], True)):
        items = spark.createDataFrame(told, ITEMS)
        found = losses.all_item_nll(rows, items, [USER], limit_bytes=0)
        assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == moved
        with monkeypatch.context() as joined:
            joined.setattr(losses, "lookup_vectors_by", lambda rows, table, on, *_: losses.lookup(rows, table, on, "left", False))
            joined.setattr(lookup, "mapped_rows", lambda *_: None)
            expected = losses.all_item_nll(rows, items, [USER], limit_bytes=0)
        found, expected = (rows_of(x, MARKET, USER, ITEM, F.round("nll", 9)) for x in (found, expected))
        assert found == expected and len(found) == (43 if moved else 41)


def test_items_of_small_blocks_are_read_together(spark):
    items = spark.createDataFrame([("ab"[n % 2], n, vector()) for n in range(200)], ITEMS)
    stored = item_blocks.write_blocks(items, block_rows=4)
    joined = stored.joined()
    for name, group in stored.groups.items():
        some = joined.groups[name]
        assert len(group.files) > 20 and len(some.files) == len(set(group.files)) and sum(some.rows) == sum(group.rows) == 100
        assert max(some.high) == max(group.high)
        ids = [np.concatenate([s.open()(name, b)[0] for b in range(len(g.files))]) for s, g in ((stored, group), (joined, some))]
        assert sorted(ids[0]) == sorted(ids[1]) == list(range("ab".index(name), 200, 2))


def test_histories_are_dealt_to_many_tasks(spark, monkeypatch):
    from xmseq.storage import tasks

    dealt = []
    histories = causal.histories
    monkeypatch.setattr(causal, "histories", lambda *a: histories(*a).coalesce(1))
    monkeypatch.setattr(causal, "vector_source", lambda vectors, **k: dealt.append(1))
    monkeypatch.setattr(causal, "with_vectors", lambda rows, *a: dealt.append(rows.rdd.getNumPartitions()) or rows)
    monkeypatch.setattr(causal, "collect_params", lambda *a: {causal.POSITION: np.zeros((50, 8))})
    inter = spark.createDataFrame([("a", u, i, i) for u in range(5) for i in range(4)], f"{MARKET} string, {USER} bigint, {ITEM} bigint, {TIME} bigint")
    causal.encode_targets(inter, inter, inter, heads=2)
    assert dealt == [1, tasks(spark)] and tasks(spark) >= 4 * spark.sparkContext.defaultParallelism


def test_vectors_are_written_with_their_own_digits(spark, tmp_path):
    """A number of single precision takes some ten digits, not the twenty of the same one widened to double."""
    from xmseq.functions.text import text_to_vec, vec_to_text
    from xmseq.sources import typed

    exact = RNG.normal(size=(40, 64)) * 10.0 ** RNG.integers(-20, 20, size=(40, 64))
    values = [*exact.astype(np.float32).tolist(), [], None, [1.0, 1e7, 16777216.0]]
    typed.register(spark)
    for kind, most in (("float", 16), ("double", 26)):
        frame = spark.createDataFrame(list(enumerate(values)), f"n bigint, v array<{kind}>")
        told = frame.select("n", vec_to_text("v").alias("t"))
        frame.coalesce(2).write.format("typed_table").mode("append").save(path := str(tmp_path / kind))
        lines = [line.split("\t") for f in typed.part_files(path) for line in open(f, encoding="utf-8").read().splitlines()[1:]]
        for texts in (dict(rows_of(told)), {int(n): t for n, t in lines}):
            assert all(len(texts[n]) < most * 64 for n in range(40)) and (kind == "double" or max(len(texts[n]) for n in range(40)) < 14.5 * 64)
        again = rows_of(told.select("n", text_to_vec("t")))
        stored = rows_of(spark.read.format("typed_table").load(path).select(F.col("n").cast("bigint"), "v"))
        assert [v for _, v in sorted(stored)] == values
        assert [v for _, v in sorted(again)] == [v or None for v in values]
    with pytest.raises(Exception):
        spark.createDataFrame([(1, [1.0, None])], "n bigint, v array<float>").write.format("typed_table").mode("append").save(str(tmp_path / "gap"))
