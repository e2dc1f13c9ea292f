"""Choice among sets of parameters against one evaluation per set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from test_encoder import HEADS, LONGEST, WIDTH, random_model
from xmseq.model import ITEM, MARKET, TIME, USER, VECTOR
from xmseq.operators.encoder import encode_sequences
from xmseq.plans.evaluate import sampled_evaluation
from xmseq.plans.runs import RUN, run_metrics, selected_run

RNG = np.random.default_rng(21)
SCHEMA = f"{MARKET} string, {USER} string, {ITEM} string, {TIME} bigint"


@pytest.fixture(scope="module")
def given(spark):
    """Sequences no longer than the models; market xx has test rows but no validation rows."""
    rows = [(m, f"u{u}", f"i{RNG.integers(0, 15)}", t) for m in ("us", "ca") for u in range(12) for t in range(int(RNG.integers(2, LONGEST + 1)))]
    rows += [("xx", "short", f"i{t}", t) for t in range(3)]
    inter = spark.createDataFrame(rows, SCHEMA)
    vectors = spark.createDataFrame([(f"i{i}", RNG.normal(size=WIDTH).tolist()) for i in range(14)], f"{ITEM} string, {VECTOR} array<double>")
    models = {name: random_model(True) for name in ("b", "a", "c")}
    lines = [(run, n, i, r.tolist()) for run, p in models.items() for n, m in p.items() for i, r in enumerate(m)]
    return inter, vectors, spark.createDataFrame(lines, f"{RUN} string, name string, row int, values array<double>")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_one_evaluation_each(given, limit):
    inter, vectors, params = given
    found = run_metrics(inter, vectors, params, n=5, top_k=(2, 5), heads=HEADS, limit_bytes=limit)
    want = []
    for run in ("a", "b", "c"):
        own = params.where(F.col(RUN) == run).drop(RUN)
        for which in ("valid", "test"):
            values = sampled_evaluation(inter, vectors, lambda rows: encode_sequences(rows, vectors, own, HEADS), n=5, which=which, top_k=(2, 5))
            want += [(run, *r) for r in values.collect()]
    assert rows_of(found, RUN, MARKET, "phase", "metric", "k", "value") == sorted(map(tuple, want), key=repr)
    tests = {(r[0], r[1], r[3], r[4]): r[5] for r in want if r[2] == "test"}
    best = {}
    for run, market, phase, metric, k, value in sorted(want, key=repr):
        if phase == "valid" and (metric, k) == ("MRR", 5) and value > best.get(market, ("", -1))[1]:
            best[market] = run, value
    chosen = rows_of(selected_run(inter, vectors, params, metric="MRR@5", n=5, top_k=(2, 5), heads=HEADS, limit_bytes=limit))
    assert set(best) == {"us", "ca"}
    assert chosen == sorted(((m, run, v, n, k, tests[run, m, n, k]) for m, (run, v) in best.items() for n in ("MRR", "NDCG") for k in (2, 5)), key=repr)


def test_equal_runs_and_wrong_ones(spark, given):
    inter, vectors, params = given
    one = params.where(f"{RUN} = 'b'")
    twins = one.unionByName(one.withColumn(RUN, F.lit("twin")))
    assert {r[RUN] for r in selected_run(inter, vectors, twins, n=3, heads=HEADS).collect()} == {"b"}
    with pytest.raises(ValueError):
        run_metrics(inter, vectors, params.limit(0), heads=HEADS)
    short = one.where("not (name = 'position_embedding.weight' and row = 0)").withColumn(RUN, F.lit("z"))
    with pytest.raises(ValueError, match="z"):
        run_metrics(inter, vectors, one.unionByName(short), heads=HEADS)
