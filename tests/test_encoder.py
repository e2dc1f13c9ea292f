import math

import numpy as np
import pytest

from xmseq.model import ITEM, PLAIN_WEIGHT, SEQ, USER, VECTOR
from xmseq.operators import params as model
from xmseq.operators.encoder import ADAPTER, ATTENTION, FEED_FORWARD, INPUT_NORM, POSITION, encode_sequences
from xmseq.operators.scoring import SEQ_VECTOR
from xmseq.operators.vectors import attention_pool, attention_weights, project_vectors
from xmseq.functions import activations
from conftest import rows_of
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)
WIDTH, LONGEST, HEADS = 8, 6, 2


def random_model(adapters):
    p = {POSITION: RNG.normal(size=(LONGEST, WIDTH))}
    linear = {ATTENTION + n: (WIDTH, WIDTH) for n in ("query", "key", "value", "dense")}
    linear |= {FEED_FORWARD + "dense_1": (16, WIDTH), FEED_FORWARD + "dense_2": (WIDTH, 16)}
    linear |= {ADAPTER.format(n): (WIDTH, WIDTH) for n in ("query", "key") if adapters}
    for name, shape in linear.items():
        p[name + ".weight"], p[name + ".bias"] = RNG.normal(size=shape), RNG.normal(size=(1, shape[0]))
    for name in (INPUT_NORM, ATTENTION + "LayerNorm", FEED_FORWARD + "LayerNorm"):
        p[name + ".weight"], p[name + ".bias"] = RNG.normal(size=(1, WIDTH)), RNG.normal(size=(1, WIDTH))
    return p


def whole_form(x, p, act, adapters):
    """All positions of one sequence with a causal mask, in plain loops; the last one is returned."""

    def norm(v, name):
        return (v - v.mean()) / math.sqrt(v.var() + 1e-12) * p[name + ".weight"][0] + p[name + ".bias"][0]

    def linear(v, name):
        return p[name + ".weight"] @ v + p[name + ".bias"][0]

    x = [norm(v + p[POSITION][j], INPUT_NORM) for j, v in enumerate(x)]
    q, k, v = ([linear(row, ATTENTION + n) for row in x] for n in ("query", "key", "value"))
    if adapters:
        q = [np.maximum(linear(row, ADAPTER.format("query")), 0) for row in q]
        k = [np.maximum(linear(row, ADAPTER.format("key")), 0) for row in k]
    size = WIDTH // HEADS
    outputs = []
    for i in range(len(x)):
        context = []
        for h in range(HEADS):
            part = slice(h * size, (h + 1) * size)
            scores = np.array(
                [q[i][part] @ k[j][part] / math.sqrt(size) + (0 if j <= i else -10000.0) for j in range(len(x))]
            )
            w = np.exp(scores - scores.max())
            context.append(sum(wj * v[j][part] for j, wj in enumerate(w / w.sum())))
        hidden = norm(linear(np.concatenate(context), ATTENTION + "dense") + x[i], ATTENTION + "LayerNorm")
        inner = np.array([act(a) for a in linear(hidden, FEED_FORWARD + "dense_1")])
        outputs.append(norm(linear(inner, FEED_FORWARD + "dense_2") + hidden, FEED_FORWARD + "LayerNorm"))
    return outputs[-1]


SCALAR = {
    "gelu": lambda x: x * 0.5 * (1 + math.erf(x / math.sqrt(2))),
    "relu": lambda x: max(x, 0.0),
    "swish": lambda x: x / (1 + math.exp(-x)),
    "tanh": math.tanh,
    "sigmoid": lambda x: 1 / (1 + math.exp(-x)),
}


def params_table(spark, p):
    rows = [(name, i, row.tolist()) for name, m in p.items() for i, row in enumerate(m)]
    return spark.createDataFrame(rows, "name string, row int, values array<double>")


@pytest.fixture(scope="module")
def data(spark):
    matrix = RNG.normal(size=(12, WIDTH)).astype(np.float32)
    vectors = spark.createDataFrame(
        [(f"i{n}", row.tolist()) for n, row in enumerate(matrix)], f"{ITEM} string, {VECTOR} array<float>"
    )
    seqs = [[f"i{RNG.integers(12)}" for _ in range(RNG.integers(1, LONGEST + 1))] for _ in range(30)]
    seqs[3] = ["unknown", "i1", "i1"]
    rows = spark.createDataFrame([(f"u{n}", s) for n, s in enumerate(seqs)], f"{USER} string, {SEQ} array<string>")
    lookup = {f"i{n}": row.astype(np.float64) for n, row in enumerate(matrix)} | {"unknown": np.zeros(WIDTH)}
    return vectors, rows, seqs, lookup


@pytest.mark.parametrize(
    "act,adapters,limit", [("gelu", True, 1 << 20), ("gelu", False, 0), ("relu", True, 0)]
    + [(a, False, 1 << 20) for a in ("swish", "tanh", "sigmoid")]
)
def test_encoder_equals_the_whole_masked_form(spark, data, act, adapters, limit):
    vectors, rows, seqs, lookup = data
    p = random_model(adapters)
    found = encode_sequences(rows, vectors, params_table(spark, p), HEADS, act, [USER], limit_bytes=limit)
    by_user = {r[USER]: r[SEQ_VECTOR] for r in found.collect()}
    for n, seq in enumerate(seqs):
        expected = whole_form([lookup[i] for i in seq], p, SCALAR[act], adapters)
        assert np.allclose(by_user[f"u{n}"], expected, atol=1e-9)


def test_encoder_checks(spark, data):
    vectors, rows, _, _ = data
    table = params_table(spark, random_model(False))
    with pytest.raises(ValueError, match="heads"):
        encode_sequences(rows, vectors, table, heads=3, key=[USER])
    with pytest.raises(ValueError, match="activation"):
        encode_sequences(rows, vectors, table, act="step", key=[USER])


def test_attention(spark, data):
    vectors, rows, seqs, lookup = data
    wq, wk = RNG.normal(size=(2, WIDTH, WIDTH))
    q, k = project_vectors(vectors, wq), project_vectors(vectors, wk)
    weights = {}
    for r in attention_weights(rows, q, k, [USER]).collect():
        weights.setdefault(r[USER], {})[r["place"]] = r["weight"]
    pooled = {r[USER]: r["pooled"] for r in attention_pool(rows, q, k, vectors, [USER]).collect()}
    for n, seq in enumerate(seqs):
        if "unknown" in seq:
            continue
        x = np.array([lookup[i] for i in seq])
        scores = (x @ wk.T) @ (wq @ x[-1]) / math.sqrt(WIDTH)
        expected = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
        assert np.allclose([weights[f"u{n}"][j] for j in range(len(seq))], expected)
        assert np.allclose(pooled[f"u{n}"], expected @ x)


def named(spark, names):
    return spark.createDataFrame(
        [(name, r, [float(len(name) + r)]) for name in names for r in range(2)], "name string, row int, values array<double>"
    )


def layer(n, w):
    return f"trm_encoder.layer.{n}.multi_head_attention.{w}.weight"


def test_select_weights(spark):
    plain = [PLAIN_WEIGHT.format(w) for w in ("query", "key", "value")]
    found = model.select_weights(named(spark, plain + [layer(3, "query")]))
    assert {r["weight"] for r in found.collect()} == {"query", "key"}
    numbered = [layer(n, w) for n in (0, 2, 11) for w in ("query", "key")]
    found = model.select_weights(named(spark, numbered + ["position_embedding.weight"]))
    assert rows_of(found, "weight", "values") == rows_of(
        named(spark, [layer(11, "query"), layer(11, "key")]).select(
            F.regexp_extract("name", r"attention\.(\w+)", 1).alias("weight"), "values"
        )
    )
    with pytest.raises(ValueError, match="value"):
        model.select_weights(named(spark, numbered), ["query", "value"])
    with pytest.raises(ValueError, match="key"):
        model.select_weights(named(spark, plain[:1]))


def test_transfer(spark):
    target = named(spark, [PLAIN_WEIGHT.format(w) for w in ("query", "key", "value")])
    source = spark.createDataFrame([("query", r, [-1.0]) for r in range(2)], "weight string, row int, values array<double>")
    found = {(r["name"], r["row"]): r["values"] for r in model.transfer(target, source).collect()}
    assert len(found) == 6
    assert found[PLAIN_WEIGHT.format("query"), 1] == [-1.0]
    assert found[PLAIN_WEIGHT.format("key"), 1] != [-1.0]


def test_params_size_is_checked(spark):
    with pytest.raises(ValueError, match="bytes"):
        model.collect_params(named(spark, ["a"]), limit_bytes=1)


def test_activation_columns(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "x double")
    x = F.col("x")
    found = df.select(
        activations.sigmoid(x), activations.relu(x), activations.leaky_relu(x), activations.swish(x), activations.softplus(x)
    ).collect()
    for (v,), row in zip([(-2.0,), (0.0,), (3.0,)], found):
        s = 1 / (1 + math.exp(-v))
        assert np.allclose(row, [s, max(v, 0), v if v > 0 else 0.01 * v, v * s, math.log1p(math.exp(v))])
