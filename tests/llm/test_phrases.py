"""Collocations against a plain version of their definition."""

import re
from collections import Counter

import pytest
from corpus_fixtures import FOLD, documents

from xmseq.llm import phrases

SCHEMA = "lang string, text string"


def by_hand(rows, longest, least, percent, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            own = counts.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                own.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in counts.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_():
    texts = [t for _, t in documents(3, 40)]
    rows = [(("en", "de", None, "und", "a b")[i % 5], t) for i, t in enumerate(texts)]
    rows += [("en", "the end. of THE end, of the end; of\tthe end: x! the end of? the\rend")] * 7
    rows += [("en", "a a a a a a a a a")] * 3 + [("de", "é ß é ß 漢 é ß.é ß")] * 4 + [("", "to be or to be or")] * 3 + [("fr", None), ("es", " .,; \n")]
    return rows


@pytest.mark.parametrize(("longest", "least", "percent", "top", "small"), [(5, 3, 100, 2000, False), (5, 2, 60, 7, True), (2, 3, 100, 2000, True), (3, 100, 100, 5, False)])
def test_against_plain_version(spark, monkeypatch, longest, least, percent, top, small):
    if small:  # many slices, many tasks, stripes in parts
        for name, value in (("SLICE", 300), ("PART", 3), ("TASK_WORDS", 500)):
            monkeypatch.setattr(phrases, name, value)
    rows = rows_()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as a", "'x' as phrase", "2 as slice", "3 as n").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, longest, least, percent, top).collect())
    assert got == by_hand(rows, longest, least, percent, top)


def test_empty(spark):
    empty = phrases.collocations(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of a corpus far larger than a test's, given to the scoring alone."""
    big = 3 * 10**12
    found = spark.createDataFrame([("en", "a", 1, 2 * big), ("en", "b", 1, 7 * big), ("en", "a b", 2, big)], "lang string, phrase string, k int, a bigint")
    words = spark.createDataFrame([("en", 10**15)], "lang string, n bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (found, words))
    row = phrases.collocations(found).first()
    assert (row["phrase"], row["score"]) == ("a b", 1000 * big * 10**15 // (14 * big * big))
