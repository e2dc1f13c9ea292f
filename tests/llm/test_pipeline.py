"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import random

import numpy as np
import pytest

import corpus_pipeline
from corpus_fixtures import prose, words
from test_near import groups_by_hand
from test_texts import lines_by_hand

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = "\n".join(prose(rng, rng.randrange(1, 12), 3000) for _ in range(rng.randrange(1, 15)))
        if i % 9 == 1:
            text = rows[rng.randrange(len(rows))][1]
        if i % 9 == 2:
            w = words(rows[0][1])
            text = " ".join([*w[:-1], f"end{i}"])
        rows.append((i, text, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 5 else None, len(text)))
    rows += [(200, None, "en", "src1", None), (201, "", "en", "src1", 0), (202, "123 !!", "en", "src1", 6), (None, prose(rng, 30), "en", "src2", None)]
    return rows + [rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def test_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", range(4))
def test_columns_and_nothing(spark, docs, stage):
    function = corpus_pipeline.STAGES[stage][1]
    assert function(spark, docs, SF).schema.names == docs.schema.names
    assert function(spark, docs.limit(0), SF).count() == 0


def test_language_rejects_what_has_none(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.find_language(spark, docs, SF).collect()}
    assert kept == {r[0] for r in awkward()} - {200, 201, 202}


def test_lines(spark, docs):
    rows = awkward()
    expect = lines_by_hand([r[:2] for r in rows[:-1]], 3)
    found = [r for r in corpus_pipeline.drop_lines(spark, docs, SF).collect() if r.doc_id is not None]
    gone = {i for i, (n, removed, _) in expect.items() if removed and removed == n}
    assert gone and {r.doc_id for r in found} == set(expect) - gone
    for r in found:
        assert r.text == expect[r.doc_id][2]
        if expect[r.doc_id][1]:
            assert r.n_chars == len(r.text)


def test_near(spark, docs):
    rows = awkward()
    _, component = groups_by_hand([r[:2] for r in rows[:-1]], 5, 80)
    found = [r.doc_id for r in corpus_pipeline.drop_near(spark, docs, SF).collect()]
    assert sorted(i for i in found if i is not None) == sorted(set(component.values()))
    assert found.count(None) == 1 and len(found) == len(set(found))


def test_near_rows_that_share_an_id(spark):
    """Two texts of one id stay both; copies of one text leave the smallest id, whatever the order of the rows."""
    rng = random.Random(3)
    a, b, c = (prose(rng, 80, 3000) for _ in range(3))
    rows = [(5, a), (5, b), (7, a), (None, b), (None, c), (None, c), (2, c + " end"), (9, None), (9, "")]
    for turn in range(2):
        docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in (rows if turn else rows[::-1])], f"{SCHEMA}, row string")
        found = corpus_pipeline.drop_near(spark, docs, SF)
        assert found.columns == docs.columns
        assert sorted(map(repr, [(r.doc_id, r.text) for r in found.collect()])) == sorted(map(repr, [(5, a), (5, b), (2, c + " end"), (9, None), (9, "")]))


def test_packing(spark, docs):
    """Every id of every text once, by the tokenizer itself; awkward rows, and no rows."""
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    found = corpus_pipeline.pack(spark, docs, SF).collect()
    pieces = {}
    for r in found:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = sorted(plain.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in awkward())
    tokens = sorted(t for ids in want for t in ids)
    assert sorted(t for p in pieces.values() for _, ids in p for t in ids) == tokens
    assert sum(r.length for r in found if r.start == 0 and r.length == r.doc_tokens) <= len(tokens)
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_mixing_keeps_documents_whole(spark, docs):
    rows = {(r[0], r[1]) for r in awkward()}
    found = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in found} <= rows
    total, used = (sum(len(words(t)) for t in texts) for texts in ([r[1] for r in awkward()], [r.text for r in found]))
    assert 0.6 * total < used <= 0.8 * total


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    rows = found.collect()
    assert found.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    ids = {r.doc_id for r in rows}
    given = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert ids and ids < given
    length = {}
    for r in rows:
        assert len(np.frombuffer(r.ids, "<u4")) == r.length
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert all(length[r.doc_id] == r.doc_tokens for r in rows)
