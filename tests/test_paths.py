"""The ways below and above the broadcast limit give the same rows, and no query needs this package on the workers."""

import os
import re
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from catalog import tables as t
from xmseq.model import IID, ITEM, MARKET, SEQ, USER, VECTOR
from xmseq.operators import blocks, encoder, item_blocks, lookup, losses, params, sampling, scoring, vector_store
from xmseq.operators.vectors import attention_pool, attention_weights

RNG = np.random.default_rng(3)
SMALL = {"limit_bytes": 0, "row_block": 3, "item_block": 4}


def near(found, expected):
    """Equal but for the last digits of numbers."""
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9)
            else:
                assert x == y or (isinstance(x, list) and x == pytest.approx(y, rel=1e-9, abs=1e-9))


def vector():
    return RNG.normal(size=5).tolist()


@pytest.fixture(scope="module", params=["float", "double"])
def items(spark, request):
    """Market xx has none; ids 1.. by market; the last item of us has no vector."""
    sets = [("us", f"i{n}", n + 1) for n in range(9)] + [("ca", f"i{n}", n // 2 + 1) for n in range(0, 9, 2)]
    names = sorted({i for _, i, _ in sets})
    table = spark.createDataFrame([(i, vector()) for i in names if i != "i8"], f"{ITEM} string, {VECTOR} array<{request.param}>")
    ids = spark.createDataFrame(sets, f"{MARKET} string, {ITEM} string, {IID} bigint").withColumn("n_items", F.lit(9))
    return ids, table


@pytest.fixture(scope="module")
def rows(spark):
    """Repeated keys with other vectors and equal rows, no market, unknown market."""
    found = [(m, f"u{n % 3}", vector()) for n, m in enumerate(["us", "us", "us", "us", "ca", "ca", None, "xx"])]
    found += [found[0], found[0]]
    return spark.createDataFrame(found, f"{MARKET} string, {USER} string, {scoring.SEQ_VECTOR} array<double>")


@pytest.fixture(params=["mapped", "joined"])
def beyond(request, monkeypatch):
    """Beyond the broadcast limit vectors are mapped, or joined where the shared folder cannot be mapped."""
    if request.param == "joined":
        for module in (vector_store, item_blocks):
            monkeypatch.setattr(module, "mounted_path", lambda *_: None)
    return request.param


def test_top_items(items, rows, beyond):
    ids, vectors = items
    own = ids.select(MARKET, ITEM).join(vectors, ITEM)
    small, large = (rows_of(blocks.full_sort_topk(rows, own, 2, [MARKET, USER], **how)) for how in ({}, SMALL))
    near(large, small)
    assert len(small) == 2 * 8  # a row without a market, or of one without items, has none
    whole = [rows_of(blocks.full_sort_topk(rows, vectors, 3, [USER], **how)) for how in ({}, SMALL)]
    near(*whole)
    assert len(whole[0]) == 3 * 10


def test_skipped_blocks(spark):
    """Clustered vectors of different lengths, equal scores, zeros: the same rows, and most products are not computed."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 6))
    found = [(i, (rng.integers(1, 4) * centers[i % 20] + 0.01 * rng.normal(size=6)).tolist()) for i in range(3000)]
    found += [(4000 + i, found[i][1]) for i in range(200)] + [(5000 + i, [0.0] * 6) for i in range(30)]
    items_ = spark.createDataFrame(found, f"{ITEM} bigint, {VECTOR} array<double>")
    asked = [(f"u{i}", (centers[i % 20] * s).tolist()) for i in range(60) for s in (1.0, -2.0)] + [("zero", [0.0] * 6), ("none", None)]
    rows_ = spark.createDataFrame(asked, f"{USER} string, {scoring.SEQ_VECTOR} array<double>")
    want = rows_of(blocks.full_sort_topk(rows_, items_, 7, [USER]))
    stored = item_blocks.write_blocks(items_, block_rows=16, file_bytes=20_000)
    found = blocks.mapped_topk(rows_, items_, stored, 7, [USER], products=True)
    near(rows_of(found.drop("products")), want)
    assert len({f for f in stored.groups[None].files}) > 3
    share = found.where("user_id like 'u%'").agg(F.avg("products")).first()[0] / 3230
    assert share < 0.5
    lse = [rows_of(blocks.all_item_logsumexp(rows_, items_, **how)) for how in ({}, {"limit_bytes": 0})]
    near(*lse)


def test_nll(items, rows, beyond):
    ids, vectors = items
    own = ids.select(MARKET, ITEM).join(vectors, ITEM)
    named = rows.withColumn(ITEM, F.lit("i2"))
    columns = (MARKET, USER, "nll")
    small, large = (rows_of(losses.all_item_nll(named, own, [MARKET, USER], **how), *columns) for how in ({}, SMALL))
    near(large, small)
    assert len(small) == 8


def test_vectors_of_candidates_are_filed_once(spark, monkeypatch):
    """An item of three markets has its vector in the files once; a number is enough for each market, in any of several files."""
    ids = spark.createDataFrame([(m, i, i - 9 * k) for k, m in enumerate("abc") for i in range(9 * k + 1, 9 * k + 15)], f"{MARKET} string, {ITEM} long, {IID} long")
    # Of an item in no market there may be two.
    vectors = spark.createDataFrame([(i, RNG.normal(size=4).tolist()) for i in [*range(1, 33), 50, 50] if i != 12], f"{ITEM} long, {VECTOR} array<double>")
    lists = [(m, str(u), RNG.normal(size=4).tolist(), RNG.integers(0, 17, 20).tolist()) for m in "abcd" for u in range(6)]
    asked = spark.createDataFrame(lists, f"{MARKET} string, {USER} string, {scoring.SEQ_VECTOR} array<double>, {scoring.CANDIDATES} array<long>")
    filed, write = [], scoring.write_ranges

    def small_files(*args):
        filed.append(write(*args, range_bytes=600))
        return filed[-1]

    monkeypatch.setattr(scoring, "write_ranges", small_files)
    ways = ((vectors.where(f"{ITEM} < 50"), {}), (vectors, {"limit_bytes": 0}))
    small, large = (rows_of(scoring.score_candidates(asked, ids, some, **how), MARKET, USER, scoring.SCORES) for some, how in ways)
    assert small == large and any(s for *_, scores in small for s in scores)
    assert [(s.width, sum(r[2] for r in s.ranges)) for s in filed] == [(4, 31), (1, 3 * 14 - 2)] and all(len(s.ranges) > 2 for s in filed)


def test_rows_side_by_side(spark):
    """Rows of an id come out in one piece of a task; none is lost, those without an id neither."""
    rows = spark.range(0, 6000, 1, 12).select(F.when(F.col("id") % 601 != 600, F.col("id") % 601).alias(ITEM), "id")
    ready = lookup.side_by_side(rows, ITEM).join(F.broadcast(spark.range(601).withColumnRenamed("id", ITEM)), ITEM, "left")
    found = ready.select(ITEM, "id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["id"] for r in found) == list(range(6000))
    runs = [(r["p"], r[ITEM]) for r in found]
    assert 1 + sum(a != b for a, b in zip(runs, runs[1:], strict=False)) == 601


def test_candidate_scores(items, rows, beyond):
    """Unknown ids and markets, items without vector, empty and null arrays."""
    ids, vectors = items
    cases = F.element_at(
        F.array(*[F.array(*[F.lit(x).cast("bigint") for x in c]) for c in ([1, 2, 9], [0, 3, 3], [77, -5, 4], [])]),
        (F.ascii(F.substring(USER, 2, 1)) % 3 + 1).cast("int"),
    )
    asked = rows.withColumn(scoring.CANDIDATES, cases)
    asked = asked.unionByName(asked.limit(1).withColumn(scoring.CANDIDATES, F.array().cast("array<bigint>")))
    asked = asked.unionByName(asked.limit(1).withColumn(scoring.CANDIDATES, F.lit(None).cast("array<bigint>")))
    columns = (MARKET, USER, scoring.CANDIDATES, scoring.SCORES)
    small, large = (
        rows_of(scoring.score_candidates(asked, ids, vectors, **how), *columns) for how in ({}, {"limit_bytes": 0, "row_block": 3})
    )
    near(large, small)
    assert len(small) == 12
    for market, _, candidates, scores in small:
        assert (scores is None) == (candidates is None)
        if candidates is not None:
            assert len(scores) == len(candidates)
            assert market in ("us", "ca") or not any(scores)


def no_vector_moves(df):
    """No exchange of the plan carries an array of numbers."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [b for b in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", b.strip())]
    return not any(re.search(r"_emb|_vec|_q|_k|_v\b", b.split("Arguments")[0]) for b in exchanges)


def test_lookup(spark, items, rows, beyond):
    _, vectors = items
    asked = rows.select(MARKET, USER, F.element_at(F.array(*map(F.lit, ("i1", "i8", "unknown", None))), F.ascii(F.substring(USER, 2, 1)) % 4 + 1).alias(ITEM))
    found = [lookup.lookup_vectors(asked, vectors, limit_bytes=n) for n in (1 << 20, 0)]
    near(*(rows_of(f, MARKET, USER, ITEM, VECTOR) for f in found))
    assert found[1].schema[VECTOR].dataType == vectors.schema[VECTOR].dataType
    if beyond == "mapped":
        assert no_vector_moves(found[1])


def test_dictionary(spark, monkeypatch):
    """Ids, counts and weights of a table above the limit, without a join; unknown, missing and look-alike keys."""
    table = spark.createDataFrame(
        [("us", "a", 1, 2.5, 9), ("us", "ab", 2, None, 9), ("usa", "b", 3, 0.5, 9), ("ca", "a", 2**53, -1.5, 4), (None, "a", 7, 7.0, 7)],
        f"{MARKET} string, {ITEM} string, {IID} bigint, weight double, n_items int",
    )
    asked = spark.createDataFrame(
        [("us", "a", 0), ("us", "ab", 1), ("usa", "b", 2), ("us", "sab", 3), ("ca", "a", 4), (None, "a", 5), ("xx", "a", 6), ("us", None, 7), ("us", "a", 8)],
        f"{MARKET} string, {ITEM} string, n int",
    )
    for how in ("left", "inner"):
        small, large = (lookup.lookup(asked, table, [ITEM, MARKET], how, small) for small in (True, False))
        assert small.columns == large.columns and small.schema == large.schema
        assert rows_of(small) == rows_of(large)
        plan = large._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="twice"):
        lookup.lookup(asked, table.unionByName(table), [ITEM, MARKET], "left", False)
    # Keys whose hashes are equal are told apart by the keys themselves.
    stored = vector_store.write_ranges(table.where("market = 'ca'").select(ITEM, F.array("weight").alias(VECTOR)))
    import pyarrow as pa

    read = stored.reader()
    monkeypatch.setattr(vector_store.xxhash, "xxh64_intdigest", lambda b, seed, real=vector_store.xxhash.xxh64_intdigest: real(b"a", seed))
    assert read(pa.array(["a", "other"]))[1].tolist() == [True, False]


def test_attention(spark, items, beyond):
    _, vectors = items
    seqs = spark.createDataFrame([("us", "u", ["i1", "i8", "i3"]), ("us", "v", ["i2"]), ("ca", "u", ["i8"])], f"{MARKET} string, {USER} string, {SEQ} array<string>")
    for fn in (attention_weights, attention_pool):
        near(*(rows_of(fn(seqs, vectors, limit_bytes=n)) for n in (1 << 20, 0)))
    if beyond == "mapped":
        assert no_vector_moves(attention_weights(seqs, vectors, limit_bytes=0))


def test_nothing_moves(spark, items, rows):
    """Above the limit, where the shared folder is mapped: no exchange at all."""
    ids, vectors = items
    asked = rows.withColumn(scoring.CANDIDATES, F.array(F.lit(1).cast("bigint")))
    for found in (
        scoring.score_candidates(asked, ids, vectors, limit_bytes=0),
        blocks.full_sort_topk(rows, vectors, 2, [USER], limit_bytes=0),
        blocks.all_item_logsumexp(rows, vectors, limit_bytes=0),
    ):
        assert "Exchange" not in found._jdf.queryExecution().toString()


def test_encoder(spark, items, beyond):
    """Rows of one key keep their own sequence; an empty or null one has a null vector."""
    _, vectors = items
    width, model = 5, []

    def matrix(name, shape):
        model.extend((name, i, r.tolist()) for i, r in enumerate(RNG.normal(size=shape)))

    att, ff = encoder.ATTENTION, encoder.FEED_FORWARD
    matrix(encoder.POSITION, (4, width))
    for name in ("LayerNorm", att + "LayerNorm", ff + "LayerNorm"):
        matrix(name + ".weight", (1, width))
        matrix(name + ".bias", (1, width))
    for name in (att + "query", att + "key", att + "value", att + "dense"):
        matrix(name + ".weight", (width, width))
        matrix(name + ".bias", (1, width))
    matrix(ff + "dense_1.weight", (7, width))
    matrix(ff + "dense_1.bias", (1, 7))
    matrix(ff + "dense_2.weight", (width, 7))
    matrix(ff + "dense_2.bias", (1, width))
    p = spark.createDataFrame(model, "name string, row int, values array<double>")
    seqs = [["i1"], ["i2", "i1"], ["i1", "i8", "unknown", "i3"], ["i1"], [], None]
    rows = spark.createDataFrame([("us", "u", s) for s in seqs], f"{MARKET} string, {USER} string, {SEQ} array<string>")
    small, large = (
        rows_of(encoder.encode_sequences(rows, vectors, p, heads=1, **how), SEQ, scoring.SEQ_VECTOR) for how in ({}, {"limit_bytes": 0})
    )
    near(large, small)
    assert len(small) == 6 and sum(r[1] is None for r in small) == 2
    with pytest.raises(ValueError, match="bytes"):
        encoder.encode_sequences(rows, vectors, p, heads=1, params_bytes=8)


def test_transfer_replaces_whole_matrices(spark):
    name = "trm_encoder.layer.multi_head_attention.{}.weight"
    target = spark.createDataFrame(
        [(name.format(w), i, [float(i), 0.0]) for w in ("query", "key") for i in range(2)] + [("other", 0, [5.0])],
        "name string, row int, values array<double>",
    )

    def given(*found):
        return spark.createDataFrame([("query", *f) for f in found], "weight string, row int, values array<double>")

    whole = params.transfer(target, given((0, [7.0, 7.0]), (1, [8.0, 8.0])))
    assert rows_of(whole.where("name like '%query%'"), "row", "values") == [(0, [7.0, 7.0]), (1, [8.0, 8.0])]
    assert whole.count() == 5
    for wrong in (given((0, [7.0, 7.0])), given((0, [7.0]), (1, [8.0])), given((0, [7.0, 7.0]), (1, [8.0, 8.0]), (2, [9.0, 9.0]))):
        with pytest.raises(ValueError, match="query"):
            params.transfer(target, wrong)


def test_softmax_of_missing_group(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), (None, 4.0)], "g string, score double")
    found = losses.log_softmax(rows, ["g"])
    assert found.count() == 4
    sums = found.groupBy("g").agg(F.sum(F.exp("log_p")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in sums)


def test_no_draws(spark):
    found = spark.range(2).select(sampling.draws(7, ["id"], 0, F.lit(5)).alias("d")).collect()
    assert [r["d"] for r in found] == [[], []]


def test_erf():
    import math

    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, 1e-300, 6.0]])
    assert np.abs(encoder.erf(x) - np.vectorize(math.erf)(x)).max() < 1e-15


def test_workers_need_no_package(tmp_path):
    """Started elsewhere without PYTHONPATH, so that workers can't import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(t.__file__)))
    script = textwrap.dedent(
        f"""
        import os, sys
        os.environ.pop("PYTHONPATH", None)
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
                 .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
        from catalog.queries import QUERIES
        for name in ("full_sort_top_items", "market_top_items", "ce_loss", "wce_loss", "encode_sequences", "encoder_metrics", "text_vectors"):
            print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
        """
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split("\n")) == 8
