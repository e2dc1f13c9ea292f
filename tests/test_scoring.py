import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from catalog import tables as t
from xmseq.model import IID, ITEM, MARKET, PHASE, TIME, USER, VECTOR
from xmseq.operators import blocks, losses, metrics, sampling, scoring
from xmseq.operators.lookup import spread_lookup
from xmseq.operators.prep import dedup_first
from xmseq.operators.sequences import item_ids, target_rows

RNG = np.random.default_rng(11)


def vector_rows(names, matrix):
    return [(name, row.tolist()) for name, row in zip(names, matrix)]


@pytest.fixture(scope="module")
def items(spark):
    matrix = RNG.normal(size=(40, 6)).astype(np.float32)
    matrix[7] = matrix[3]  # a tie
    names = [f"i{n:02d}" for n in range(40)]
    return spark.createDataFrame(vector_rows(names, matrix), f"{ITEM} string, {VECTOR} array<float>"), names, matrix


@pytest.fixture(scope="module")
def users(spark):
    matrix = RNG.normal(size=(23, 6))
    frame = spark.createDataFrame(
        [(f"u{n}", f"i{n:02d}", row.tolist()) for n, row in enumerate(matrix)],
        f"{USER} string, {ITEM} string, {scoring.SEQ_VECTOR} array<double>",
    )
    return frame, matrix


SMALL_BLOCKS = {"limit_bytes": 0, "row_block": 5, "item_block": 3}


@pytest.mark.parametrize("how", [{}, SMALL_BLOCKS])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_topk(items, users, how, k):
    expected = []
    for u, scores in enumerate(users[1] @ items[2].astype(np.float64).T):
        order = sorted(range(40), key=lambda i: (-round(scores[i], 9), i))[:k]
        expected += [(f"u{u}", items[1][i], r + 1, round(scores[i], 9)) for r, i in enumerate(order)]
    found = rows_of(blocks.full_sort_topk(users[0], items[0], k, [USER], **how), USER, ITEM, "rank", "score")
    assert [f[:3] for f in found] == [e[:3] for e in sorted(expected, key=repr)]
    assert np.allclose([f[3] for f in found], [e[3] for e in sorted(expected, key=repr)])


@pytest.mark.parametrize("how", [{}, SMALL_BLOCKS])
@pytest.mark.parametrize("padding", [False, True])
def test_nll(items, users, how, padding):
    logits = users[1] @ items[2].astype(np.float64).T
    if padding:
        logits = np.hstack([logits, np.zeros((23, 1))])
    own = logits[np.arange(23), np.arange(23)]
    expected = np.log(np.exp(logits).sum(axis=1)) - own
    found = losses.all_item_nll(users[0], items[0], [USER], include_padding=padding, **how)
    by_user = {r[USER]: r["nll"] for r in found.collect()}
    assert np.allclose([by_user[f"u{n}"] for n in range(23)], expected)


@pytest.mark.parametrize("how", [{}, SMALL_BLOCKS])
def test_topk_within_markets(spark, items, users, how):
    placed = users[0].withColumn(MARKET, F.when(F.col(USER) < "u2", "us").otherwise("ca"))
    sets = [("us", f"i{n:02d}") for n in range(0, 40, 2)] + [("ca", f"i{n:02d}") for n in range(0, 40, 3)]
    own = spark.createDataFrame(sets, f"{MARKET} string, {ITEM} string").join(items[0], ITEM)
    found = blocks.full_sort_topk(placed, own, 40, [MARKET, USER], **how)
    n = {(r[MARKET], r[USER]): r["count"] for r in found.groupBy(MARKET, USER).count().collect()}
    assert len(n) == 23 and all(c == {"us": 20, "ca": 14}[m] for (m, _), c in n.items())
    assert found.join(own.select(MARKET, ITEM), [MARKET, ITEM], "left_anti").count() == 0


def test_spread_lookup_equals_join(spark):
    keys = ["hot"] * 500 + [None] * 50 + [f"k{n % 40}" for n in range(200)] + ["absent"] * 7
    df = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "n int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{n}", n) for n in range(40)], "k string, v int")
    for how in ("left", "inner"):
        found = spread_lookup(df, table, ["k"], how, hot_keys=4)
        assert rows_of(found, "n", "k", "v") == rows_of(df.join(table, "k", how), "n", "k", "v")


@pytest.fixture(scope="module")
def small(spark):
    sf = "/root/testdata/sf0.001"
    inter = t.stored_purchases(spark, sf)
    ids = item_ids(inter)
    rows = target_rows(inter, t.TIES).withColumn(PHASE, F.lit("test"))
    return inter, ids, sampling.uniform_negatives(rows, ids), t.item_vectors(spark, sf)


def test_negatives(small):
    _, ids, drawn, _ = small
    n = {r[MARKET]: r["n_items"] for r in ids.collect()}
    for r in drawn.collect():
        assert 60 < len(r["negatives"]) <= 99
        assert len(set(r["negatives"])) == len(r["negatives"])
        assert r[IID] not in r["negatives"]
        assert all(1 <= c <= n[r[MARKET]] for c in r["negatives"])


def test_negatives_of_tiny_markets(spark):
    inter = spark.createDataFrame(
        [("us", "u", f"i{n}", n) for n in (0, 1, 0)] + [("ca", "v", "i0", n) for n in range(3)],
        f"{MARKET} string, {USER} string, {ITEM} string, {TIME} bigint",
    )
    rows = target_rows(inter).withColumn(PHASE, F.lit("test"))
    found = {r[MARKET]: r["negatives"] for r in sampling.uniform_negatives(rows, item_ids(inter)).collect()}
    assert found == {"us": [2], "ca": []} or found == {"us": [1], "ca": []}


def test_exclude_history(small):
    inter, ids, drawn, _ = small
    seen = inter.select(MARKET, USER, ITEM).distinct().join(ids, [MARKET, ITEM])
    kept = sampling.exclude_history(drawn, seen)
    assert kept.count() == drawn.count()
    history = {}
    for r in seen.collect():
        history.setdefault((r[MARKET], r[USER]), set()).add(r[IID])
    before = {(r[MARKET], r[USER]): r["negatives"] for r in drawn.collect()}
    for r in kept.collect():
        key = r[MARKET], r[USER]
        assert r["negatives"] == [c for c in before[key] if c not in history[key]]


def test_candidate_scores_with_and_without_broadcast(small):
    _, ids, drawn, vectors = small
    rows = drawn.select(
        MARKET,
        USER,
        PHASE,
        F.concat(F.array(IID), "negatives").alias(scoring.CANDIDATES),
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i + F.col(USER))).alias(scoring.SEQ_VECTOR),
    )
    some = vectors.where(F.col(ITEM) % 10 != 3)
    near = {r[USER]: r for r in scoring.score_candidates(rows, ids, some).collect()}
    far = {r[USER]: r for r in scoring.score_candidates(rows, ids, some, limit_bytes=0).collect()}
    assert near.keys() == far.keys() and len(near) == rows.count()
    for user, r in near.items():
        assert np.allclose(r[scoring.SCORES], far[user][scoring.SCORES], atol=2e-9)
        assert len(r[scoring.SCORES]) == len(r[scoring.CANDIDATES])


def test_rank_and_metrics(spark):
    rows = spark.createDataFrame(
        [
            ("us", "test", "u1", [5, 2, 9], [0.5, 0.5, 0.7]),  # 2 beats by id, 9 by score
            ("us", "test", "u2", [1, 2, 3], [0.5, 0.5, 0.1]),
            ("ca", "test", "u3", [7], [0.0]),
        ],
        "market string, phase string, user_id string, candidates array<bigint>, scores array<double>",
    )
    ranked = metrics.rank_first(rows)
    assert {r[USER]: r["rank"] for r in ranked.collect()} == {"u1": 3, "u2": 1, "u3": 1}
    pair = F.inline(F.arrays_zip(F.col("candidates").alias("candidate"), F.col("scores").alias("score")))
    first = [F.get("candidates", F.lit(0)).alias("positive"), F.get("scores", F.lit(0)).alias("pos_score")]
    lines = metrics.rank_positive(rows.select(USER, *first, pair), [USER])
    assert rows_of(lines, USER, "rank") == rows_of(ranked, USER, "rank")
    found = {(r[MARKET], r["metric"], r["k"]): r["value"] for r in metrics.ranking_metrics(ranked, [2, 5]).collect()}
    assert found["us", "MRR", 2] == 0.5 and found["us", "MRR", 5] == round((1 + 1 / 3) / 2, 4)
    assert found["us", "NDCG", 5] == 0.75 and found["ca", "NDCG", 2] == 1.0
    report = {r[MARKET]: r["line"] for r in metrics.report_line(metrics.ranking_metrics(ranked, [5])).collect()}
    assert report["us"] == "0.6667 0.75"


def test_best_run(spark):
    runs = spark.createDataFrame(
        [("b", "MRR", 10, 0.5), ("a", "MRR", 10, 0.5), ("c", "MRR", 10, 0.1), ("c", "MRR", 5, 0.9), ("d", "NDCG", 10, 1.0)],
        "run string, metric string, k int, value double",
    )
    assert rows_of(metrics.best_run(runs)) == [("a", 0.5)]
    assert rows_of(metrics.best_run(runs, bigger=False)) == [("c", 0.1)]


def test_known_evaluation(spark):
    """Rank and metrics on a fixed draw recipe with known outcome: 1,500 users, 146,340 candidates with the positives."""
    sf = "/root/testdata/sf0.01"
    inter, vectors = t.stored_purchases(spark, sf), t.item_vectors(spark, sf)
    one_market = inter.withColumn(MARKET, F.lit("all"))
    rows = target_rows(one_market, t.TIES).withColumn(PHASE, F.lit("test"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit("7|"), F.col(USER), F.lit("|"), F.col("k"))), 1, 8), 16, 10)
    drawn = (
        rows.select(USER, ITEM, F.explode(F.sequence(F.lit(1), F.lit(120))).alias("k"))
        .select(USER, ITEM, "k", (number.cast("bigint") % 2000).alias("c"))
        .where(F.col("c") != F.col(ITEM))
    )
    first = F.slice(F.array_sort(F.collect_list(F.struct("k", "c"))), 1, 99)
    drawn = drawn.groupBy(USER).agg(F.array_distinct(F.transform(first, lambda x: x["c"])).alias("c"))
    ids = t.table(spark, sf, "part").select(
        F.lit("all").alias(MARKET), F.col("p_partkey").alias(ITEM), F.col("p_partkey").alias(IID)
    )
    ready = rows.join(drawn, USER).select(
        MARKET, USER, PHASE, "item_id_list", F.concat(F.array(ITEM), "c").alias(scoring.CANDIDATES)
    )
    from xmseq.plans.evaluate import last_item_encoder

    scored = scoring.score_candidates(last_item_encoder(vectors)(ready), ids, vectors)
    found = metrics.rank_first(scored)
    assert found.agg(F.count("*"), F.sum(F.size(scoring.CANDIDATES))).first() == (1500, 146340)
    values = {(r["metric"], r["k"]): r["value"] for r in metrics.ranking_metrics(found, digits=6).collect()}
    assert values["MRR", 10] == 0.029148 and values["NDCG", 10] == 0.044984


def test_weights_and_losses(spark):
    freq = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 5, 100)], "freq int")
    found = [r["weight"] for r in losses.item_weights(freq).orderBy("freq").collect()]
    assert np.allclose(found[:5], [1.957362324, 1.2, 0.442637676, 0.237413020, 0.200726541], atol=1e-9)
    assert all(0.2 - 1e-12 <= w <= 1.2 + np.tanh(0.99) for w in found)
    scores = spark.createDataFrame([(g, s) for g in range(3) for s in (1000.0, 999.0, -5.0 * g)], "g int, score double")
    soft = losses.log_softmax(scores, ["g"])
    assert np.allclose([r[1] for r in soft.groupBy("g").agg(F.sum(F.exp("log_p"))).collect()], 1.0)
    pairs = spark.createDataFrame([(1.0, 0.0), (-800.0, 800.0)], "pos_score double, neg_score double")
    assert np.isclose(losses.bpr_loss(pairs).first()["loss"], (np.log1p(np.exp(-1.0)) + 1600.0) / 2)
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "nll double, weight double")
    assert losses.ce_loss(rows).first()["loss"] == 2.0
    assert np.isclose(losses.wce_loss(rows).first()["loss"], 5 / 3)


def test_dedup_first(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None)], "k string, ord int, t string")
    assert rows_of(dedup_first(rows, ["k"], ["ord"])) == [("a", 1, "early"), ("b", 5, None)]
