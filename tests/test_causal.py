"""Outputs for every target against the encoder on each target's own sequence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from test_encoder import HEADS, LONGEST, WIDTH, random_model
from xmseq.model import EVENTS, ITEM, MARKET, POS, TIME, USER, USER_KEY, VECTOR
from xmseq.operators import causal, vector_store
from xmseq.operators.encoder import encode_last, encode_sequences
from xmseq.operators.scoring import SEQ_VECTOR
from xmseq.operators.sequences import build_sequences

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module", params=["bigint", "string"])
def tables(spark, request):
    kind = request.param
    users = [("us", "a", 40), ("us", "b", 7), ("ca", "a", 2), ("ca", "c", 1), ("ca", "d", 13), (None, "e", 9)]
    rows = [(m, u, int(RNG.integers(0, 12)), int(t // 2)) for m, u, n in users for t in range(n)]
    inter = spark.createDataFrame(rows, f"{MARKET} string, {USER} string, i int, {TIME} bigint")
    inter = inter.select(MARKET, USER, F.col("i").cast(kind).alias(ITEM), TIME)
    vectors = spark.createDataFrame([(i, RNG.normal(size=WIDTH).tolist()) for i in range(10)], "i int, v array<double>")
    vectors = vectors.select(F.col("i").cast(kind).alias(ITEM), F.col("v").alias(VECTOR))
    return inter, vectors


@pytest.fixture(scope="module")
def params(spark):
    p = random_model(True)
    return p, spark.createDataFrame([(n, i, r.tolist()) for n, m in p.items() for i, r in enumerate(m)], "name string, row int, values array<double>")


def test_causal_pass_is_each_prefix(params):
    p, _ = params
    x = RNG.normal(size=(4, LONGEST, WIDTH))
    whole = causal.encode_causal(x, p, HEADS, "gelu")
    for n in range(1, LONGEST + 1):
        assert whole[:, n - 1] == pytest.approx(encode_last(x[:, :n], np.full(4, n), p, HEADS, "gelu"), abs=1e-12)


@pytest.mark.parametrize("way", ["broadcast", "mapped", "joined"])
@pytest.mark.parametrize(("piece", "hot_rows"), [(512, None), (LONGEST, 5), (8, None)])
def test_against_single_sequences(spark, monkeypatch, tables, params, way, piece, hot_rows):
    inter, vectors = tables
    limit = 1 << 20 if way == "broadcast" else 0
    if way == "joined":
        monkeypatch.setattr(vector_store, "mounted_path", lambda *_: None)
    found = causal.encode_targets(inter, vectors, params[1], max_len=LONGEST, heads=HEADS, piece=piece, hot_rows=hot_rows, limit_bytes=limit)
    rows = build_sequences(inter, max_len=LONGEST)
    want = encode_sequences(rows, vectors, params[1], HEADS)
    columns = [*USER_KEY, POS, EVENTS, ITEM, SEQ_VECTOR]
    got, want = rows_of(found, *columns), rows_of(want, *columns)
    assert len(got) == len(want) == 39 + 6 + 1 + 12 + 8
    for a, b in zip(got, want, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=1e-9)


def test_no_events_and_wrong_arguments(spark, tables, params):
    inter, vectors = tables
    assert causal.encode_targets(inter.limit(0), vectors, params[1], max_len=LONGEST, heads=HEADS).count() == 0
    none = causal.encode_targets(inter, vectors.limit(0), params[1], max_len=LONGEST, heads=HEADS, limit_bytes=-1)
    assert none.count() == 66
    for wrong in ({"act": "sine"}, {"heads": 3}, {"max_len": LONGEST + 1}, {"piece": 2}):
        with pytest.raises(ValueError):
            causal.encode_targets(inter, vectors, params[1], **({"max_len": LONGEST, "heads": HEADS} | wrong))


def test_store_reads_what_was_written(spark, tables):
    _, vectors = tables
    stored = vector_store.vector_source(vectors, limit_bytes=0, range_bytes=200)
    assert stored.matrix is None and len(stored.ranges) > 3
    table = vectors.toArrow()
    ids = table[ITEM].combine_chunks()
    values, known = stored.reader()(ids)
    assert known.all() and values.tolist() == table[VECTOR].to_pylist()
    asked = ids.take(np.array([3, 3, 0])).to_pylist()
    import pyarrow as pa

    unknown = {int: 77, str: "zz"}[type(asked[0])]
    values, known = stored.reader()(pa.array([unknown, *asked, None]))
    assert known.tolist() == [False, True, True, True, False] and not values[0].any() and not values[4].any()


def test_store_misses_nothing_silently(spark, tables):
    _, vectors = tables
    stored = vector_store.vector_source(vectors, limit_bytes=0)
    with open(f"{stored.folder}/{stored.ranges[0][0]}", "ab") as file:
        file.write(b"more")
    with pytest.raises(FileNotFoundError):
        stored.reader()(vectors.toArrow()[ITEM].combine_chunks())
    with pytest.raises(ValueError):
        vector_store.vector_source(vectors.unionByName(vectors), limit_bytes=0)
