"""Sums over all items: nothing is moved or filed more often than the result asks for, and every core has work."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows_of
from xmseq.model import ITEM, MARKET, USER, VECTOR
from xmseq.operators import blocks, item_blocks, losses, prep
from xmseq.operators.scoring import SEQ_VECTOR
from xmseq.storage import dealt

RNG = np.random.default_rng(18)
INTER = f"{MARKET} string, {USER} bigint, {ITEM} bigint, last bigint"


def vector(width=4):
    return RNG.normal(size=width).tolist()


def test_rows_are_dealt_to_all_cores(spark):
    """Few bytes and long work: a few tasks a core, although the step before has left the rows by the same columns."""
    few = spark.range(4000).groupBy((F.col("id") % 500).alias(USER)).count()
    found = dealt(few, USER).mapInArrow(lambda batches: batches, f"{USER} bigint, count bigint")
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert rows_of(found) == rows_of(few)


@pytest.mark.parametrize("held", [1 << 20, 1])
def test_spans_hold_every_item_and_no_vector_is_shuffled(spark, monkeypatch, held):
    told = [("ab"[n % 2], n, vector()) for n in range(50)] + [(None, 1, vector()), ("a", None, vector()), ("b", 3, None), ("c", 7, vector())]
    items = spark.createDataFrame(told, f"{MARKET} string, {ITEM} bigint, {VECTOR} array<float>")
    monkeypatch.setattr(type(items), "repartitionByRange", None)
    stored = item_blocks.write_spans(items, span_rows=8, held_bytes=held)
    read = stored.open()
    for name, group in stored.groups.items():
        parts = [read(name, b) for b in range(len(group.files))]
        assert [len(x) for _, x in parts] == group.rows and max(group.rows) <= 8
        found = sorted((int(i), *x.tolist()) for ids, some in parts for i, x in zip(ids.to_pylist(), some.astype(float), strict=True))
        own = [(i, *np.float32(v).astype(float).tolist()) for m, i, v in told if m == name and i is not None and v is not None]
        assert found == sorted(own)
        assert np.allclose(max(group.high), max(np.linalg.norm(x[1:]) for x in own))
    assert sorted(stored.groups) == ["a", "b", "c"]
    rows = spark.createDataFrame([(m, n, vector()) for n in range(3) for m in ("a", "b", "c", "d", None)], f"{MARKET} string, {USER} bigint, {SEQ_VECTOR} array<double>")
    few, many = (rows_of(blocks.all_item_logsumexp(rows, items.dropna(), limit_bytes=x), MARKET, USER, F.round("lse", 8)) for x in (1 << 20, 0))
    assert few == many and len(few) == 9


def test_vectors_of_several_widths_are_no_spans(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], f"{ITEM} bigint, {VECTOR} array<float>")
    with pytest.raises(Exception, match="vectors differ in width"):
        item_blocks.write_spans(items)


def test_exp_from_a_table():
    x = np.concatenate([RNG.uniform(-299, 299, 5000), RNG.normal(size=5000) * 3, [0.0, -300.0, 300.0]])
    steps = x * item_blocks.EXP_STEPS
    item_blocks.exp_from(item_blocks.exp_table(300.0), steps, *np.empty((2, len(x))))
    assert np.allclose(steps / np.exp(x), 1, rtol=0, atol=2e-10)
    some = np.array([np.nan])
    item_blocks.exp_from(item_blocks.exp_table(1.0), some, *np.empty((2, 1)))
    assert np.isnan(some[0])


def test_rows_of_a_market_meet_the_items_together(monkeypatch):
    """Over several batches, as far as few enough rows wait; none is lost."""
    batches = [pa.record_batch({MARKET: ["abc"[(n * k) % 3] for n in range(30)], "n": [100 * k + n for n in range(30)]}) for k in range(1, 9)]
    monkeypatch.setattr(blocks, "MAPPED_ROWS", 16)
    for held, most in ((1 << 20, 8), (20, 40)):
        monkeypatch.setattr(blocks, "HELD_ROWS", held)
        lots = list(blocks._together(iter(batches), [MARKET], {"a", "b"}))
        rows = sorted((name, n) for name, lot in lots for n in lot["n"].to_pylist())
        assert rows == sorted((m, n) for b in batches for m, n in zip(b[MARKET].to_pylist(), b["n"].to_pylist(), strict=True) if m != "c")
        assert max(lot.num_rows for _, lot in lots) == 16
        assert sum(lot.num_rows < 16 for _, lot in lots) <= (2 if held > 1000 else most)
    whole = list(blocks._together(iter(batches), [], {None}))
    assert sum(lot.num_rows for _, lot in whole) == 240


def given(spark, twice=False):
    told = [("abc"[n % 3], n, n % 7, n * n % 11) for n in range(60)] + [(None, 60, 1, 2), ("a", 61, 50, 2), ("a", 62, 2, 50)]
    inter = spark.createDataFrame(told, INTER)
    known = [(i, vector()) for i in range(11)]
    # Items 3 and 4 share a vector.
    known[4] = (4, known[3][1])
    vectors = spark.createDataFrame(known + known[2:4] * twice, f"{ITEM} bigint, {VECTOR} array<float>")
    sets = inter.select(MARKET, ITEM).unionByName(inter.select(MARKET, F.col("last").alias(ITEM)))
    items = prep.market_items(vectors, sets)
    of = vectors.select(F.col(ITEM).alias("last"), F.col(VECTOR).alias(SEQ_VECTOR))
    return inter.join(of, "last", "left"), items, vectors


@pytest.mark.parametrize(("limit", "twice"), [(0, False), (1 << 20, False), (0, True)])
def test_targets_are_filed_once_for_all_markets(spark, monkeypatch, limit, twice):
    """Also where an item comes twice, and where rows of one vector meet the items together."""
    from xmseq.operators import lookup

    rows, items, vectors = given(spark, twice)
    filed, write = [], lookup.write_ranges
    monkeypatch.setattr(lookup, "write_ranges", lambda table, *a: filed.append(table.count()) or write(table, *a))
    columns = (MARKET, USER, ITEM, F.round("nll", 8))
    plain = rows_of(losses.all_item_nll(rows, items, [USER], limit_bytes=limit), *columns)
    once = rows_of(losses.all_item_nll(rows, items, [USER], vectors=vectors, limit_bytes=limit), *columns)
    assert once == plain and len(plain) == (62 if not twice else len(plain)) and any(x[3] for x in plain)
    assert filed == ([] if limit or twice else [items.where(f"{MARKET} is not null").count(), vectors.count()])
    shared = losses.all_item_nll(rows, items, [USER], shared=True, vectors=vectors, last="last", limit_bytes=limit)
    assert rows_of(shared, *columns) == plain


def test_a_batch_without_any_vector(spark):
    """Its rows count as zeros, beside few items as beside many."""
    rows = spark.createDataFrame([("a", 1, None)], f"{MARKET} string, {USER} bigint, {SEQ_VECTOR} array<double>")
    items = spark.createDataFrame([("a", n, vector()) for n in range(4)], f"{MARKET} string, {ITEM} bigint, {VECTOR} array<float>")
    for limit in (0, 1 << 20):
        assert np.isclose(blocks.all_item_logsumexp(rows, items, limit_bytes=limit).first()["lse"], np.log(4))


def test_an_item_travels_in_place_of_its_vector(spark, monkeypatch):
    rows, items, vectors = given(spark)
    moved, deal = [], blocks.dealt
    monkeypatch.setattr(blocks, "dealt", lambda df, *by: moved.append(df) or deal(df, *by))
    losses.all_item_nll(rows, items, [USER], shared=True, vectors=vectors, last="last", limit_bytes=0)
    (each,) = moved
    assert not any(isinstance(f.dataType, T.ArrayType) for f in each.schema)
    # Of two items with one vector, one stands for both.
    assert each.where(f"{MARKET} = 'a' and last in (3, 4)").count() == 1
