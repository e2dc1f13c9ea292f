"""The text encoder against plain loops over one text at a time."""

import math

import numpy as np
import pytest

from xmseq.model import ITEM, TEXT, VECTOR
from xmseq.operators import text_encoder as te

RNG = np.random.default_rng(2)
WIDTH, HEADS, LAYERS, LONGEST = 8, 2, 2, 12
PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "una", "b", "##b", "##ble", "##l", "##le", "able", "aff", "##aff", "##ord", "-", "cafe", "漢", "字", "1", "##2"]


def model():
    p = {te.WORDS: RNG.normal(size=(len(PIECES), WIDTH)), te.PLACES: RNG.normal(size=(LONGEST, WIDTH)), te.KINDS: RNG.normal(size=(2, WIDTH))}
    norms, linear = [te.INPUT_NORM], {}
    for n in range(LAYERS):
        at = te.LAYER.format(n)
        linear |= {at + x: (WIDTH, WIDTH) for x in (te.QUERY, te.KEY, te.VALUE, te.MIXED)}
        linear |= {at + te.INNER: (12, WIDTH), at + te.OUTER: (WIDTH, 12)}
        norms += [at + te.MIXED_NORM, at + te.OUTER_NORM]
    for name, shape in linear.items():
        p[name + ".weight"], p[name + ".bias"] = RNG.normal(size=shape), RNG.normal(size=(1, shape[0]))
    for name in norms:
        p[name + ".weight"], p[name + ".bias"] = RNG.normal(size=(1, WIDTH)), RNG.normal(size=(1, WIDTH))
    return p


def by_hand(ids, p):
    def linear(v, name):
        return p[name + ".weight"] @ v + p[name + ".bias"][0]

    def norm(v, name):
        return (v - v.mean()) / math.sqrt(v.var() + 1e-12) * p[name + ".weight"][0] + p[name + ".bias"][0]

    x = [norm(p[te.WORDS][n] + p[te.PLACES][i] + p[te.KINDS][0], te.INPUT_NORM) for i, n in enumerate(ids)]
    for n in range(LAYERS):
        at, size, out = te.LAYER.format(n), WIDTH // HEADS, []
        for own in x:
            context = []
            for h in range(HEADS):
                part = slice(h * size, (h + 1) * size)
                w = np.array([math.exp(linear(own, at + te.QUERY)[part] @ linear(o, at + te.KEY)[part] / math.sqrt(size)) for o in x])
                context.append(sum(a * linear(o, at + te.VALUE)[part] for a, o in zip(w / w.sum(), x, strict=True)))
            hidden = norm(linear(np.concatenate(context), at + te.MIXED) + own, at + te.MIXED_NORM)
            inner = np.array([a * 0.5 * (1 + math.erf(a / math.sqrt(2))) for a in linear(hidden, at + te.INNER)])
            out.append(norm(linear(inner, at + te.OUTER) + hidden, at + te.OUTER_NORM))
        x = out
    return x[0]


#: Texts and their pieces without the special ones.
CASES = [
    ("unaffordable", ["una", "[UNK]"][1:]),
    ("unable", ["una", "##ble"]),
    ("UNaffordb", ["[UNK]"]),
    ("affaffordble un-able", ["aff", "##aff", "##ord", "##ble", "un", "-", "able"]),
    ("Café\tCAFÉ\ncafé", ["cafe"] * 3),
    ("漢字b", ["漢", "字", "b"]),
    ("12 1​2 1\x002", ["1", "##2"] * 3),
    ("b" * 101, ["[UNK]"]),
    ("b" * 100, ["b"] + ["##b"] * 99),
    ("", []),
    ("  \n ", []),
    (None, []),
    ("zz - zz", ["[UNK]", "-", "[UNK]"]),
    ("un " * 40, ["un"] * 40),
]


@pytest.fixture(scope="module")
def given(spark):
    p = model()
    params = spark.createDataFrame([(n, i, r.tolist()) for n, m in p.items() for i, r in enumerate(m)], "name string, row int, values array<double>")
    vocabulary = spark.createDataFrame(list(enumerate(PIECES)), "id int, piece string")
    return p, params, vocabulary


@pytest.mark.parametrize("most", [LONGEST, 5, 2])
def test_against_plain_loops(spark, given, most):
    p, params, vocabulary = given
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0]), (None, "unable")]
    texts = spark.createDataFrame(rows, f"{ITEM} int, {TEXT} string").repartition(2)
    found = te.encode_texts(texts, vocabulary, params, heads=HEADS, max_tokens=most).collect()
    assert len(found) == len(rows)
    for row in found:
        pieces = CASES[row[ITEM]][1] if row[ITEM] is not None else ["una", "##ble"]
        ids = [PIECES.index(x) for x in ["[CLS]", *pieces[: most - 2], "[SEP]"]]
        assert row[VECTOR] == pytest.approx(by_hand(ids, p), abs=1e-5)


def test_empty_table_and_wrong_arguments(spark, given):
    _, params, vocabulary = given
    texts = spark.createDataFrame([], f"{ITEM} int, {TEXT} string")
    assert te.encode_texts(texts, vocabulary, params, heads=HEADS, max_tokens=LONGEST).count() == 0
    one = vocabulary.where("piece <> '[CLS]'")
    for bad in ({"heads": 3}, {"act": "sine"}, {"max_tokens": 1}, {"max_tokens": LONGEST + 1}, {"vocabulary": one}, {"params_bytes": 10}):
        how = {"vocabulary": vocabulary, "params": params, "heads": HEADS, "max_tokens": LONGEST} | bad
        with pytest.raises(ValueError):
            te.encode_texts(texts, **how)
