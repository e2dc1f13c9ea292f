"""Near-duplicates of vectors and texts, fingerprints, components: against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpus_fixtures import SCHEMA, documents, folded, prose, smallest_reachable
from xmseq.llm import fingerprints, inverted, lattice, store, verify, words


def shingle_set(text, k):
    w = folded(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups_by_hand(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[:n]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, smallest_reachable(ids, links)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_groups(spark, k, percent):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, rep int, component string")
    found = inverted.near_groups(docs, k=k, percent=percent).collect()
    sets, component = groups_by_hand(rows, k, percent)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), component[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_near_groups_in_blocks(spark, monkeypatch):
    """Every list, group and block is cut: one large group of near copies, and a chain whose ends are far apart."""
    for name, value in {"HOT_LEAST": 2, "HOT_PAIRS": 10**9, "BLOCK": 4, "CHUNK": 8}.items():
        monkeypatch.setattr(inverted, name, value)
    monkeypatch.setattr(verify, "GROUP", 6)
    rng = random.Random(3)
    base = prose(rng, 120, 10_000).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    chain = prose(rng, 150, 10_000).split()
    for i in range(40):
        chain = [*chain[3:], f"a{i}", f"b{i}", f"c{i}"]
        rows.append((100 + i, " ".join(chain)))
    rng.shuffle(rows)
    found = inverted.near_groups(spark.createDataFrame(rows, SCHEMA), k=3, percent=85).collect()
    _, component = groups_by_hand(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in found} == component
    assert len(set(component.values())) == 2


def test_near_documents_by_bands(spark):
    rows = documents(1)
    found = fingerprints.near_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    _, component = groups_by_hand(rows, 5, 80)
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == component | {None: None}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert fingerprints.near_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_groups_repeated_rows_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "")]
    found = sorted((r.doc_id, r.component_id) for r in inverted.near_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert inverted.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 40)] + [(300, 300), (7, None)]
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    real = [(a, b) for a, b in links if b is not None and a != b]
    expect = smallest_reachable({x for e in real for x in e}, real)
    found = store.components(spark.createDataFrame(links, "u bigint, v bigint"))
    assert {r.node: r.component for r in found.collect()} == expect
    assert store.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_order_of_pairs_is_common():
    """Two rows that agree in m places share a pair of their prefixes, whatever is frequent."""
    rng = np.random.default_rng(0)
    m = 40
    for _ in range(50):
        a = rng.integers(0, 3, (1, 64)).astype(np.uint32)
        b = a.copy()
        b[0, rng.choice(64, 64 - m, replace=False)] += 5
        pairs = np.unique(np.concatenate([inverted.pairs_of(a)[0], inverted.pairs_of(b)[0]]))
        hot = np.sort(rng.choice(pairs, 30, replace=False))
        order = inverted.Order(hot, rng.integers(1, 9, len(hot)), m)
        first, second = order.prefix(inverted.pairs_of(a))[0][0], order.prefix(inverted.pairs_of(b))[0][0]
        assert set(first.tolist()) & set(second.tolist())


def vectors():
    rng = np.random.default_rng(4)
    rows, n = [], 0

    def add(x, label):
        nonlocal n
        rows.append((n, None if x is None else [None if v is None else float(v) for v in x], label))
        n += 1

    for label in (0, 1):
        for _ in range(40):
            a = rng.normal(size=16).astype(np.float32)
            add(a, label)
            for noise in (0.03, 0.15, 0.25):
                add((a + rng.normal(size=16) * noise).astype(np.float32), label)
        add(rows[-1][1], label)
        add([2 * v for v in rows[-1][1]], label)
        add(rows[-1][1], 1 - label)
    add(rows[0][1], None)
    for bad in (None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15):
        add(bad, 0)
        add(bad, 0)
    add(rows[0][1][:8], 0)
    add(rows[0][1][:8], 0)
    return rows


def links_by_hand(rows, cosine=0.98):
    good = [(i, np.array(x, np.float64), y) for i, x, y in rows if x and y is not None and None not in x and np.isfinite(x).all() and any(x)]
    out = []
    for n, (i, x, y) in enumerate(good):
        for j, z, w in good[:n]:
            if y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= cosine:
                out.append((i, j))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = vectors()
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    links = links_by_hand(rows)
    component = smallest_reachable([r[0] for r in rows], links)
    degree = dict.fromkeys(component, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(links) > 60
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (degree[i], component[i], i == component[i]) for i in component}


def test_near_vectors_double_and_nothing(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_e8():
    r = lattice.neighbours()
    assert len(r) == 240 and np.allclose((r * r).sum(1), 2)
    y = np.random.default_rng(0).normal(size=(500, 8)) * 3
    p = lattice.nearest_e8(y)
    d = ((y - p) ** 2).sum(1)
    # No neighbouring point is nearer, and none is farther away than the covering radius.
    assert d.max() <= 1 + 1e-9
    assert (((y[:, None] - p[:, None] - r[None]) ** 2).sum(2) >= d[:, None] - 1e-9).all()


def test_near_vectors_of_any_size_and_one_id(spark):
    """Numbers whose squares leave the range of doubles; one id with two unlike vectors, each with its own links."""
    rng = np.random.default_rng(6)
    a, b = (rng.normal(size=16) for _ in range(2))
    rows = [(1, (a * 1e-200).tolist()), (2, (a * 1e200).tolist()), (3, a.tolist()), (4, (b * 1e-200).tolist()), (5, (b * 1e-300).tolist())]
    rows += [(7, b.tolist()), (7, rng.normal(size=16).tolist()), (None, a.tolist())]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label bigint, rep string")
    found = sorted((tuple(r) for r in lattice.near_vectors(frame).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 4, True), (5, 2, 4, False), (7, 0, 7, True), (7, 2, 4, False), (None, 0, None, True)]
    assert found == sorted(want, key=repr)


def test_lattice_recall():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    d = rng.normal(size=a.shape)
    d -= (d * a).sum(1)[:, None] * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * d / np.linalg.norm(d, axis=1)[:, None]
    cells = [lattice.cells(x, lattice.TABLES, lattice.PROBES, lattice.SCALE).reshape(len(a), lattice.TABLES, -1) for x in (a, b)]
    met = (cells[0][:, :, :1] == cells[1]).any((1, 2)) | (cells[1][:, :, :1] == cells[0]).any((1, 2))
    assert met.mean() > 0.995


def test_edit_report(spark):
    rows = [r for r in documents() if r[0] is not None]
    random.Random(5).shuffle(rows)
    found = {r.doc_id: r for r in fingerprints.edit_report(spark.createDataFrame(rows, SCHEMA), parts=7).collect()}
    rows.sort()
    assert len(found) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for other, estimate in ((changed, r.near_edited), (following, r.near_next)):
            a, b = shingle_set(text, 5), shingle_set(other, 5)
            assert abs(estimate - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    by_text = {}
    for doc_id, text in rows:
        assert by_text.setdefault(text or "", found[doc_id].fingerprint) == found[doc_id].fingerprint


def test_edit_report_edges(spark):
    one = fingerprints.edit_report(spark.createDataFrame([(5, "abcd")], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.edit_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "ab"), (1, "cd"), (1, "cd"), (2, None)]
    found = fingerprints.edit_report(spark.createDataFrame(rows, SCHEMA), parts=3)
    assert sorted(r.n_chars for r in found.collect()) == [0, 2, 2, 2]
    assert fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_word_hashes():
    texts = ["a b  c\t d", "", None, "héllo wörld ÄB", "x" * 30 + " y", " lead ", "\x1cz \x85"]
    import pyarrow as pa

    data, offsets = words.text_bytes(pa.array(texts))
    starts, ends, counts = words.bounds(data, offsets)
    expect = [[w.encode() for w in (t or "").encode().split() and __import__("re").findall(r"[^\x20\x09-\x0D]+", t)] if t else [] for t in texts]
    assert counts.tolist() == [len(e) for e in expect]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for e in expect for w in e]
    many = [bytes(random.Random(i).choices(range(33, 126), k=i % 40 + 1)) for i in range(3000)]
    joined = np.frombuffer(b"".join(many), np.uint8)
    at = np.cumsum([0, *map(len, many)])
    assert len(set(words.hashes(joined, at[:-1], at[1:]).tolist())) == len(set(many))
