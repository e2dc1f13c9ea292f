"""Suffix arrays against sorting, and removal of repeated bytes against a plain version of its definition."""

import random

import numpy as np
import pytest
from corpus_fixtures import documents, prose

from xmseq.llm import suffixes

SCHEMA = "doc_id bigint, text string"


def arrays(texts):
    symbols = np.concatenate([np.array([*t, 0]) for t in texts])
    offsets = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    return suffixes.suffix_arrays(symbols, offsets), symbols, offsets


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_arrays(letters):
    rng = random.Random(letters)
    texts = [[rng.randrange(1, letters + 1) for _ in range(rng.randrange(0, 60))] for _ in range(200)]
    texts += [[1] * 50, [1, 2] * 25, [2, 1] * 25, [1, 1, 2] * 20, [3, 2, 1] * 9, []]
    found, symbols, offsets = arrays(texts)
    for t, a in enumerate(offsets[:-1]):
        own = symbols[a : offsets[t + 1]].tolist()
        assert (found[a : offsets[t + 1]] - a).tolist() == sorted(range(len(own)), key=lambda i: own[i:])


def test_groups_are_lyndon_prefixes():
    rng = random.Random(5)
    text = [rng.randrange(1, 3) for _ in range(300)]
    s = [*text, 0]
    found, _, _ = arrays([text])
    rank = np.empty(len(s), np.int64)
    rank[found] = np.arange(len(s))
    n = len(s)
    sa = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.append(True, np.array(s)[sa][1:] != np.array(s)[sa][:-1]))
    size, place, group = np.zeros(n + 1, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    place[sa], group[sa] = np.arange(n), np.repeat(first, size[first])
    before = np.arange(n) - 1
    suffixes.point(sa, place, group, size, before, np.array([0, n]))
    lyndon = [tuple(s[i : next((j for j in range(i + 1, n) if rank[j] < rank[i]), n)]) for i in range(n)]
    for i in range(n - 1):
        assert [j for j in range(n) if group[j] == group[i]] == [j for j in range(n) if lyndon[j] == lyndon[i]]


def by_hand(rows, window):
    least = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - window + 1) if i is not None else ():
            x = raw[p : p + window]
            least[x] = min(least.get(x, i), i)
    out = []
    for i, raw in raws:
        gone = [False] * len(raw)
        for p in range(len(raw) - window + 1) if i is not None else ():
            if least[raw[p : p + window]] < i:
                gone[p : p + window] = [True] * window
        edges = [j for j in range(len(raw) + 1) if (gone[j - 1] if j else False) != (gone[j] if j < len(raw) else False)]
        out.append((i, len(raw), sum(gone), bytes(b for b, g in zip(raw, gone, strict=True) if not g), list(zip(edges[::2], edges[1::2], strict=True))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r[1], r[2], bytes(r[3]), [tuple(x) for x in r[4]]) for r in df.collect()), key=repr)


def awkward():
    rng = random.Random(9)
    rows = [(i, t) for i, t in documents(4, 48) if len(t or "") < 5000]
    shared = prose(rng, 15)
    rows += [(2000 + i, f"{prose(rng, rng.randrange(6))} {shared}{prose(rng, rng.randrange(6))}") for i in range(30)]
    rows += [(2100, "x" * 300), (2101, "x" * 120), (2102, "x" * 50), (2103, "x" * 49), (2104, "ab" * 90), (2105, "b" + "ab" * 60)]
    rows += [(2110, "\0" * 60 + "q"), (2111, "q" + "\0" * 55), (2112, "é漢🙂" * 30), (2113, "x漢🙂é" * 30), (-5, shared), (2100, shared + "!"), (2001, shared), (None, "x" * 200)]
    return rows


@pytest.mark.parametrize(("window", "gram", "hot", "step"), [(50, 24, 64, 64), (50, 24, 5, 2), (50, 50, 5, 64), (30, 8, 64, 3), (9, 8, 1, 1)])
def test_against_plain_version(spark, monkeypatch, window, gram, hot, step):
    for name, value in (("HOT", hot), ("IN_STEP", step), ("SLICE", 4000), ("PIECE", 700), ("BATCH", 3000), ("TASK_BYTES", 9000)):
        monkeypatch.setattr(suffixes, name, value)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as slice", "'x' as z", "2 as ids", "3 as kept").repartition(5)
    assert found(suffixes.drop_repeats(df, window, gram)) == by_hand(rows, window)


def test_whole_slices(spark):
    rows = awkward()
    rows += [(5000 + i, rows[1][1]) for i in range(100)]
    assert found(suffixes.drop_repeats(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows, 50)


def test_long_texts(spark):
    rng = random.Random(1)
    long = prose(rng, 400_000, 50_000)
    rows = [(1, long), (2, prose(rng, 100_000)), (3, long[1_000_000:1_900_000] + "!"), (4, None), (5, "")]
    out = {r["doc_id"]: r for r in suffixes.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[3]["n_removed"] == 900_000 and bytes(out[3]["kept"]) == b"!" and out[1]["n_removed"] == 0
    assert out[4]["n_bytes"] == 0 and out[5]["removed"] == []


def test_empty_table(spark):
    out = suffixes.drop_repeats(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "kept", "removed"] and out.count() == 0
