"""Scoring, mixing, URLs, packing, language, repeated passages and lines: against brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_fixtures import SCHEMA, documents, folded, prose, words
from xmseq.llm import kneser_ney, language, lines, mixing, packing, substrings, urls
from xmseq.llm.queries import RULES

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_kneser_ney(spark):
    rows = documents(2)
    found = kneser_ney.held_out_scores(spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, score string")).collect()
    begin, end = ("begin",), ("end",)
    tokens = [(i, [*folded(t), end]) for i, t in rows]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    single, pair = Counter(), Counter()
    for i, t in tokens:
        if not held[i]:
            single.update(t)
            pair.update(zip([begin, *t[:-1]], t, strict=True))
    n, v = sum(single.values()), len(single)
    before, after, kinds = Counter(w for _, w in pair), Counter(), defaultdict(Counter)
    for (a, _), c in pair.items():
        after[a] += c
        kinds[a][min(c, 3)] += 1

    def discount(counts):
        k = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        return [0, *(max(0, i - (i + 1) * y * k[i] / k[i - 1]) for i in (1, 2, 3))]

    dp, dw = discount(pair), discount(before)
    free = sum(dw[min(c, 3)] for c in before.values()) / len(pair)

    def lower(w):
        return (before[w] - dw[min(before[w], 3)]) / len(pair) + free / (v + 1)

    def probability(a, w):
        if not after[a]:
            return lower(w)
        c = pair[a, w]
        return (c - dp[min(c, 3)] + sum(dp[k] * m for k, m in kinds[a].items()) * lower(w)) / after[a]

    assert abs(sum(probability(begin, w) for w in single) + probability(begin, "never seen") - 1) < 1e-9
    by_id = dict(tokens)
    assert len(found) == len(rows)
    for r in found:
        t = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(t), n)
        assert r.n_known == sum(w in single for w in t)
        assert math.isclose(r.base_score, sum(math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(probability(a, w)) for a, w in zip([begin, *t[:-1]], t, strict=True)), rel_tol=1e-9)


def test_kneser_ney_edges(spark):
    assert kneser_ney.held_out_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    r = kneser_ney.held_out_scores(spark.createDataFrame([(1, None)], SCHEMA)).collect()[0]
    assert (r.n_tokens, math.isfinite(r.score)) == (1, True)
    # Counts above 254 have an array of their own.
    model = kneser_ney.train(spark.createDataFrame([(1, "a b " * 400)], SCHEMA))
    r = kneser_ney.score(spark.createDataFrame([(2, "a b a b")], SCHEMA), model).collect()[0]
    assert r.perplexity < 4
    with pytest.raises(ValueError, match="mounted"):
        kneser_ney.mounted("hdfs://store/folder")


def test_kneser_ney_missing_files(spark, tmp_path):
    """A file that a worker or the driver cannot see is an error, not unseen words."""
    docs = spark.createDataFrame([(1, "a b c a b d " * 50)], SCHEMA)
    model = kneser_ney.train(docs)
    names = sorted(os.listdir(model.folder))
    rows = {"pair": model.pairs, "word": model.words}
    kneser_ney.files_of(model.folder, model.bits, rows)
    gone = next(n for n in names if n.startswith("pair-") and n.endswith("-0.npy"))
    os.rename(f"{model.folder}/{gone}", tmp_path / gone)
    with pytest.raises(Exception, match="all workers must see"):
        kneser_ney.score(docs, model).collect()
    with pytest.raises(FileNotFoundError):
        kneser_ney.files_of(model.folder, model.bits, rows)
    with pytest.raises(FileNotFoundError):
        kneser_ney.files_of(str(tmp_path / "none"), model.bits, rows)


def test_kneser_ney_frequent_words(spark, monkeypatch):
    """The pairs of a frequent word are shared out over the buckets, and scores stay."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"the n{rng.randrange(4000)}" for _ in range(500)) + " of the of a") for i in range(20)]
    rows.append((30, prose(rng, 3000)))
    train, asked = spark.createDataFrame(rows[1:], SCHEMA).repartition(3), spark.createDataFrame([*rows, (40, "the a the unseen")], SCHEMA)
    found = []
    for most in (1 << 40, 400):
        monkeypatch.setattr(kneser_ney, "MOST_PAIRS", most, raising=False)
        model = kneser_ney.train(train)
        sizes = [len(np.load(p)) for p in Path(model.folder).glob("pair-*-0.npy")]
        found.append(sorted(map(tuple, kneser_ney.score(asked, model).collect())))
    assert sum(sizes) == model.pairs and max(sizes) < 0.4 * model.pairs
    assert len(found[0]) == len(found[1]) == 22
    for a, b in zip(*found, strict=True):
        assert a[:4] == b[:4] and all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a[4:], b[4:], strict=True))


def removed_by_hand(rows, window):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize(("window", "bits", "most"), [(20, 16, 2_000_000), (20, 3, 200), (2, 4, 500)])
def test_drop_repeats(spark, monkeypatch, window, bits, most):
    monkeypatch.setattr(substrings, "BITS", bits)
    monkeypatch.setattr(substrings, "TASK_WINDOWS", most)
    monkeypatch.setattr(substrings, "SLICE", 4000)
    if window < 8:
        monkeypatch.setattr(substrings, "PREFIXES", (1, 2))
    rows = documents(4) + [(5000, "the same " * 200), (4999, "the same " * 200)]
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame([(*r, 0) for r in rows], f"{SCHEMA}, n_words int").repartition(5)
    found = substrings.drop_repeats(docs, window).collect()
    expect = removed_by_hand(rows, window)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.text) == expect[r.doc_id]
            assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_drop_repeats_edges(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    same = " ".join(map(str, range(25)))
    found = substrings.drop_repeats(spark.createDataFrame([(1, same), (1, same), (2, same)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (1, 0), (2, 25)]


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 6, 500):
        x = rng.integers(-(2**50), 2**50, n)
        assert (substrings.unpack(substrings.pack(x)) == x).all()
        doc, start = np.sort(rng.integers(0, 20, n)), rng.integers(0, 90_000, n)
        back = substrings.unpacked(*substrings.packed(doc, start))
        assert (back[0] == doc).all() and (back[1] == start).all()
    h = rng.integers(0, 50, 1000).astype(np.uint64) << np.uint64(1)
    order = substrings.grouped(h)
    assert sorted(order.tolist()) == list(range(1000)) and (np.diff(np.flatnonzero(np.diff(h[order]))) > 0).all()


def lines_by_hand(rows, run):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if t is None:
            out[i] = (0, 0, None)
            continue
        every = t.split("\n")
        counted = [j for j, x in enumerate(every) if words(x)]
        gone = set()
        for s in range(len(counted) - run + 1):
            key = tuple(every[j] for j in counted[s : s + run])
            if key in seen:
                gone.update(counted[s : s + run])
            seen.add(key)
        out[i] = (len(counted), len(gone), "\n".join(x for j, x in enumerate(every) if j not in gone))
    return out


@pytest.mark.parametrize("run", [1, 3, 5])
def test_drop_repeated_lines(spark, run):
    rng = random.Random(run)
    pool = [prose(rng, 4) for _ in range(12)] + ["", "  ", "\t", "x"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x\n" * 30), (104, "x\n" * 30), (105, "long " * 40_000), (None, rows[1][1])]
    docs = spark.createDataFrame([(*r, "kept", 7) for r in rows], f"{SCHEMA}, starts string, n_lines int")
    found = lines.drop_repeated_lines(docs, run)
    assert found.columns == ["doc_id", "text", "starts", "n_lines", "n_removed"]
    expect = lines_by_hand(rows, run)
    rows_found = found.collect()
    assert len(rows_found) == len(rows)
    for r in rows_found:
        assert r.starts == "kept"
        if r.doc_id is None:
            assert r.text == rows[1][1]
        else:
            assert (r.n_lines, r.n_removed, r.text) == expect[r.doc_id]
    assert lines.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def long_lines_by_hand(rows, run, least):
    """Windows of `run` lines, and the fewest lines from each one on that hold `least` words."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        every = t.split("\n")
        counted = [j for j, x in enumerate(every) if words(x)]
        gone = set()
        for s in range(len(counted)):
            sizes = [len(words("\n".join(every[j] for j in counted[s : s + k]))) for k in range(1, run + 1)]
            for k in {run, next((k for k, n in enumerate(sizes, 1) if n >= least), run)}:
                key = tuple(every[j] for j in counted[s : s + k])
                if len(key) == k and key in seen:
                    gone.update(counted[s : s + k])
                seen.add(key if len(key) == k else None)
        out[i] = (len(counted), len(gone), "\n".join(x for j, x in enumerate(every) if j not in gone))
    return out


@pytest.mark.parametrize("run", [1, 3])
def test_long_lines_repeat_by_themselves(spark, run):
    rng = random.Random(run)
    long, pair, short = prose(rng, 50), [prose(rng, 25), prose(rng, 30)], prose(rng, 49)
    rows = [(i, "\n".join([prose(rng, 3), long, prose(rng, 3), *pair, prose(rng, 3), short])) for i in range(3)]
    rows += [(10, long), (11, "\n".join(pair)), (12, short), (13, f"{long}\n\n{long}"), (14, "")]
    pool = [prose(rng, n) for n in (1, 2, 10, 20, 24, 30, 49, 50, 90)] + ["", " \t"]
    beside = [prose(rng, 5), prose(rng, 60), prose(rng, 5)]
    rows += [(15, "\n".join(beside)), (16, "\n".join(beside))]
    rows += [(20 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(60)]
    expect = long_lines_by_hand(rows, run, 50)
    found = lines.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA), run, 50).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == expect
    if run == 3:
        assert long not in expect[1][2] and expect[1][1] == 3 and expect[10][1] == 1 and expect[11][1] == 2 and expect[12][1] == 0 and expect[16][1] == 3


def test_mixing_hands_shortage_to_siblings_first(spark):
    """d0 is short in fr, which en takes; what both lack goes to d1."""
    rows = [(i, "w " * 10, d, lang, s) for i, (d, lang, s) in enumerate(
        [("d0", "en", "a")] * 3 + [("d0", "fr", "a")] * 1 + [("d1", "en", "a")] * 20 + [("d1", None, None)] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, domain string, lang string, source string")
    tokens = docs.withColumn("n_tokens", F.lit(10).cast("bigint"))
    leaves = tokens.groupBy(*mixing.LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = mixing.leaf_budgets(leaves, F.lit(120), {"domain": {"d0": 1, "d1": 1}}, 1).collect()
    budget = {(r.domain, r.lang): r.budget for r in plan}
    assert budget == {("d0", "en"): 30, ("d0", "fr"): 10, ("d1", "en"): 40, ("d1", None): 40}
    found = mixing.mix(docs, F.lit(120), {}, max_epochs=1).groupBy("domain", "lang").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("n"))
    assert {(r.domain, r.lang): r.n for r in found.collect()} == budget


def test_mixing_epochs_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(9)), f"d{i % 2}", "en", f"s{i % 5}", 1, "t") for i in range(300)]
    rows += [(1000, None, None, None, None, 1, "t"), (1001, "", "d0", None, "s1", 1, "t"), (5, "again and again", "d0", "en", "s0", 1, "t"), (None, "a b", "d0", "en", "s0", 1, "t")]
    schema = "doc_id bigint, text string, domain string, lang string, source string, plan_tokens int, n_tokens string"
    docs = spark.createDataFrame(rows, schema)
    found = mixing.mix(docs, F.expr("tokens * 2"), {"source": {"s0": 9}}, max_epochs=3, seed=4)
    assert found.columns == [*docs.columns, "uses"]
    got = found.collect()
    assert len(got) == len(rows)
    total = sum(len(words(r[1])) for r in rows)
    used = sum(r.uses * r.n_tokens for r in got)
    assert total * 2 * 0.9 < used <= total * 2
    leaves = defaultdict(set)
    for r in got:
        leaves[r.domain, r.lang, r.source].add(r.uses)
        assert r.n_tokens == len(words(r.text)) and r.plan_tokens == 1
    # Within a leaf, no row is read more than one epoch ahead of another.
    assert all(max(u) - min(u) <= 1 and max(u) <= 3 for u in leaves.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7), F.expr("tokens * 2"), {"source": {"s0": 9}}, max_epochs=3, seed=4).collect()), key=repr)
    assert mixing.mix(spark.createDataFrame([], schema), F.lit(10)).count() == 0


ALIASES = [
    ('<link rel="canonical" href="../de/2">', "http://b.com/en/x", "b.com/de/2"),
    ('<link rel="canonical" href="http://c.com/a/./b/../../de/?u=1&amp;v=&quot;2">', "http://one.net/", 'c.com/de/?u=1&v="2'),
    ("<meta http-equiv=refresh content='0;url=/p&#47;q&#x2F;..&#38;amp;&amp;lt;'>", "http://d.net/x", "d.net/p/q/..&amp;&lt;"),
    ('<link rel="canonical" href="..">', "http://e.net/a/b/c", "e.net/a/"),
    ('<link rel="canonical" href="./../../../f">', "http://e.net/a/", "e.net/f"),
    ('<link rel="canonical" href="/g/.?q=./../">', "http://e.net/a/", "e.net/g/?q=./../"),
    ('<link rel="canonical" href="&#9999;&#0;&unknown;">', "http://e.net/a/", "e.net/a/&"),
]


def test_url_targets(spark):
    """Entities and dot segments, against plain values; then a chain and a hub of aliases against the SQL."""
    rows = [(i, url, f"<html>{link}</html>") for i, (link, url, _) in enumerate(ALIASES)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    tag = F.get(F.regexp_extract_all("html", F.lit(urls.TAG), F.lit(0)), F.lit(0))
    aimed = urls.with_target(pages.select("page_id", "url", urls.target_of(tag).alias("target")), "to")
    found = aimed.select("page_id", urls.key_of(F.col("to")).alias("key")).orderBy("page_id").collect()
    assert [r["key"] for r in found] == [key for _, _, key in ALIASES], found
    rows += [(100 + i, f"http://h{i}.net/r?u=1&v={i}", f'<link rel="canonical" href="http://h{i + 1}.net/x/../r?u=1&amp;v={i + 1}">') for i in range(60)]
    rows += [(300 + i, f"http://s{i}.net/", "<link rel=canonical href='http://hub.com/./de/1'>") for i in range(200)]
    rows += [(700, "http://h60.net/r?u=1&v=60", "<link rel=canonical href=http://q.com/de/9>"), (701, "http://hub.com/de/1", "")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(map(tuple, urls.judge(frame, urls.rules_table(spark, RULES)).select("page_id", "verdict", "alias").collect()))
    import duckdb

    from xmseq.llm.queries import SQL

    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    want = con.execute(f"SELECT page_id, verdict, alias FROM ({SQL['op5_urls']}) ORDER BY page_id").fetchall()
    assert got == want
    assert sum(v == "block" for _, v, _ in got) >= 2 + 61 + 201


def page(link="", url="http://a.net/"):
    return url, f"<html><head>{link}</head><body><a href='/x'>x</a></body></html>"


def test_urls(spark):
    rows = [
        ("http://x.example.org/es/1", None),
        page('<link rel="canonical" href="http://x.example.org/es/1">', "https://alias.net/1#top"),
        page("<META http-equiv=refresh content='0; URL=/2'>", "http://alias.net/1"),
        page('<link href="//good.org/a" rel="x canonical">', "http://two.net/"),
        page('<link rel="canonical" href="http://b.com/de/">', "http://two.net/"),
        page('<link rel="stylesheet" href="http://b.com/de/1">', "http://plain.net/"),
        page('<link rel="canonical" href="next">', "http://rel.net/dir/page?q=1"),
        page('<link rel="canonical" href="http://example.org/en/1">', "http://rel.net/dir/next"),
        ("http://ORG/", "") , ("http://notexample.org", ""), ("http://sub.EXAMPLE.org/en/12?x#y", ""), ("HTTP://b.COM/fr/x", ""),
        ("no scheme", ""), (None, "<link rel=canonical href=http://b.com/de/>"), ("http://", ""), ("http://q.net?/a#b", ""), ("http://q.net?/a", ""),
    ]
    pages = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(rows)], "page_id bigint, url string, html string, key string")
    found = {r.page_id: r for r in urls.judge(pages, urls.rules_table(spark, RULES)).collect()}
    assert len(found) == len(rows)
    assert [found[i].verdict for i in range(len(rows))] == [
        "block", "block", "block", "allow", "allow", "allow", "block", "block",
        "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow",
    ]
    assert [found[i].rule for i in (0, 1, 8, 9, 10, 11)] == ["example.org/es/", None, "org/", None, "example.org/en/1", "com/fr/"]
    assert (found[10].host, found[10].path, found[12].host, found[13].path) == ("sub.example.org", "/en/12", "", "")
    assert (found[15].host, found[15].path) == ("q.net", "")
    assert found[1].alias == "alias.net/1" and found[2].alias == "alias.net/1" and found[13].alias is None
    assert urls.judge(pages.limit(0), urls.rules_table(spark, RULES)).count() == 0


def test_packing(spark):
    rows = documents(6) + [(2000 + i, prose(random.Random(i), i * 7)) for i in range(150)] + [(3, "again"), (4000, "<|endoftext|> x")]
    found = packing.packed(spark.createDataFrame([(*r, 1) for r in rows], f"{SCHEMA}, ids int"), TOKENIZER, group_rows=64).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    expect = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        pieces[r.doc_id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    whole = Counter()
    for (i, n), parts in pieces.items():
        parts.sort()
        copies = sum(s == 0 for s, _ in parts)
        ids = tuple(x for _, p in parts for x in p)
        assert len(ids) == copies * n
        whole[i, ids] += copies
    assert whole == expect
    padding = tokens = 0
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, length, tier in parts:
            assert offset == at and length > 0
            at += length
        assert at <= tier <= 1024
        padding += tier - at
        tokens += at
    assert padding < 0.02 * tokens
    assert packing.packed(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


def test_pack_group():
    rng = random.Random(0)
    for _ in range(200):
        lengths = [rng.choice([1, 5, 127, 128, 129, 500, 1024, 1025, rng.randrange(1, 4000)]) for _ in range(rng.randrange(40))]
        pieces, sizes = packing.pack_group(lengths)
        cover, fill = Counter(), Counter()
        for row, start, length, window, offset in pieces:
            assert offset == fill[window]
            fill[window] += length
            cover.update((row, start + i) for i in range(length))
        assert cover == Counter((r, i) for r, n in enumerate(lengths) for i in range(n))
        assert sum(fill[w] < size for w, size in enumerate(sizes)) <= 1


def test_steps_are_balanced():
    rng = random.Random(4)
    for n in (0, 1, 5, 3000):
        sizes = [rng.choice(packing.TIERS) for _ in range(n)]
        steps = packing.deal_steps(sizes)
        total, by_tier = Counter(), defaultdict(Counter)
        for size, step in zip(sizes, steps, strict=True):
            total[step] += size
            by_tier[size][step] += size
        if n:
            assert max(total.values()) <= packing.STEP_TOKENS and max(total.values()) - min(total.values()) <= 1024
            for tier, held in by_tier.items():
                assert max(held.values()) - min(held.get(s, 0) for s in total) <= 2 * 1024, tier


def test_rows_of_one_id(spark):
    """Equal rows and rows of one id: several groups, runs of a bounded number of rows, each piece once."""
    rows = [(7, "same text")] * 1500 + [(7, f"other {i}") for i in range(1500)] + [(None, "")] * 900
    found = packing.packed(spark.createDataFrame(rows, SCHEMA), TOKENIZER, group_rows=64).collect()
    assert len({r.sequence_id >> 24 for r in found}) > 20
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    assert Counter(r.doc_id for r in found if r.start == 0) == {7: 3000, None: 900}
    filled = Counter()
    for r in found:
        filled[r.sequence_id] += r.length
    sizes = {r.sequence_id: r.tier for r in found}
    assert all(filled[s] <= sizes[s] for s in sizes)
    assert packing.packed(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    odd = ["", " ", "\n", "  lead", "a b c d", "tail  \n", "x\n\n y", "it's don't I'LL", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x<|endoftext|", "x  <|endoftext|>", "é à　ü", "\x1c a \x1db", "🙂 🙂🙂 a", None, "a\x85b c"]
    odd += ["".join(random.Random(i).choices("ab \n\t'é.1漢", k=40)) for i in range(300)]
    for most in (1_000_000, 3):
        encoder = packing.Encoder(TOKENIZER, most)
        for text, ids in zip(odd, encoder.encode(pa.array(odd)), strict=True):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def letters(rng, alphabet, n):
    return " ".join("".join(rng.choices(alphabet, k=rng.randrange(1, 8))) for _ in range(n))


def test_language(spark):
    rng = random.Random(0)
    alphabets = {"aa": "abcdeé", "bb": "abcdeü", "cc": "стая"}
    rows = [(i, letters(rng, a, rng.randrange(5, 60)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "bb"), (903, rows[0][1], None), (904, letters(rng, "стая", 100_000), "cc"), (None, rows[1][1], "aa")]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, lang string")
    found = language.held_out_languages(docs).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    by_id = {r.doc_id: r for r in found}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903].lang_pred == "aa" and by_id[904].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in found)
    # Labels of held-out rows, sources and ids play no part.
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.held_out_languages(other).collect()}
    assert all(again[r.doc_id] == (r.lang_pred, r.score) for r in found)


def test_language_edges(spark):
    empty = spark.createDataFrame([], f"{SCHEMA}, lang string")
    assert language.held_out_languages(empty).count() == 0
    model = language.train(empty)
    docs = spark.createDataFrame([(1, "abc", "x", 0.5)], f"{SCHEMA}, lang_pred string, score double")
    found = language.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"] and found.collect()[0].lang_pred == "und"


def test_sample_stays_small_in_the_driver(spark, monkeypatch):
    """The sample is views of six bytes a feature; weights are those of widened rows."""
    rng = random.Random(4)
    rows = [(i, letters(rng, a, 30), lang) for i, (lang, a) in enumerate([("aa", "abcdeé"), ("bb", "fghijü")] * 40)]
    taken, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda rows, *a, **b: (taken.extend(rows), fit(rows, *a, **b))[1])
    model = language.train(spark.createDataFrame(rows, f"{SCHEMA}, lang string"))
    assert taken and all((p.dtype, v.dtype) == ("<u2", "<f4") and p.base is not None and v.base is not None for p, v, _ in taken)
    assert (model.weights == fit([(p.astype(np.int64), v.astype(float), y) for p, v, y in taken], 2)).all()


def test_features_of_pieces(monkeypatch):
    text = letters(random.Random(1), "abcdefé ", 400)
    whole = language.counts_of(text)
    monkeypatch.setattr(language, "SLICE", 97)
    assert (language.counts_of(text) == whole).all()
    assert hashlib.sha256(whole.tobytes()).hexdigest() == hashlib.sha256(language.counts_of(text).tobytes()).hexdigest()


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = language.softmax(logits)
    labels = np.array([rng.choice(3, p=q) for q in p])
    flat, ones = np.zeros(3), np.ones(4000)
    assert 0.85 < language.best_temperature(logits, labels, flat, ones) < 1.15
    assert 3.4 < language.best_temperature(logits * 4, labels, flat, ones) < 4.6
    shift = np.array([1.0, 0.0, -1.0])
    assert 0.85 < language.best_temperature(logits - shift, labels, shift, ones) < 1.15


def test_rare_language(spark):
    """A language of 8 rows among 8,000 is learnt, though its hashes are not among the smallest; frequent ones stay right."""
    rng = random.Random(2)
    alphabets = {"aa": "abcdeé", "bb": "fghijü"}
    rows = [(i, letters(rng, alphabets[lang], 25), lang) for i, lang in enumerate(["aa", "bb"] * 4000)]
    rows += [(100_000 + i, letters(rng, "стая", 40), "cc") for i in range(8)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, lang string")
    model = language.train(docs, sample=300)
    assert model.langs == ["aa", "bb", "cc"] and model.prior[2] < -1
    asked = [(i, letters(rng, a, 30), lang) for i, (lang, a) in enumerate([*alphabets.items(), ("cc", "стая")] * 20)]
    found = language.predict(spark.createDataFrame(asked, f"{SCHEMA}, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    assert sum(r.lang_pred == "cc" and r.score > 0.5 for r in found if r.lang == "cc") >= 18


def test_regression_against_plain_loops(monkeypatch):
    """Follow-the-regularised-leader, one number at a time."""
    monkeypatch.setattr(language, "PLACES", 12)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        place = np.sort(rng.choice(12, 4, replace=False))
        rows.append((place, rng.random(4), int(rng.integers(0, 3))))
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, c):
        if abs(z[i][c]) <= language.L1:
            return 0.0
        return -(z[i][c] - math.copysign(language.L1, z[i][c])) / ((language.BETA + math.sqrt(n[i][c])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for place, value, label in rows:
            w = {(i, c): weight(i, c) for i in place.tolist() for c in range(3)}
            score = [sum(v * w[i, c] for i, v in zip(place.tolist(), value, strict=True)) for c in range(3)]
            top = [math.exp(s - max(score)) for s in score]
            for i, v in zip(place.tolist(), value, strict=True):
                for c in range(3):
                    g = v * (top[c] / sum(top) - (c == label))
                    z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / language.ALPHA * w[i, c]
                    n[i][c] += g * g
    plain = np.array([[weight(i, c) for c in range(3)] for i in range(12)])
    assert language.fit(rows, 3) == pytest.approx(plain, abs=1e-12) and (plain != 0).any()


def test_weights_of_terms():
    """TF-IDF of length one, against the formula."""
    counts, idf = np.zeros(language.PLACES, np.int64), np.linspace(1, 3, language.PLACES)
    counts[[5, 9, 700]] = 1, 4, 2
    place, value = language.features(counts, idf)
    raw = [(1 + math.log(counts[i])) * idf[i] for i in (5, 9, 700)]
    assert place.tolist() == [5, 9, 700]
    assert value == pytest.approx([x / math.sqrt(sum(y * y for y in raw)) for x in raw])
