import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from xmseq.functions.dates import epoch_seconds
from xmseq.functions.text import first_or_empty, text_to_vec, tokens, vec_to_text
from xmseq.model import DESCRIPTION, ITEM, MARKET, TEXT, TIME, TITLE, USER, VECTOR
from xmseq.operators.prep import coverage_report, item_text, require_coverage, to_interactions
from xmseq.operators.vectors import text_vectors, text_weights
from xmseq.plans.prepare import prepare, selected_metadata
from xmseq.sinks.export import write_master
from xmseq.sources.prepared import read_params, read_prepared, read_typed, read_vectors
from xmseq.sources.raw import read_markets, read_metadata, read_ratings, split_corrupt

META = [
    {"asin": "A1", "title": "First", "description": ["one", "two"], "price": 3},
    {"asin": "0972683275", "title": "Second", "description": []},
    {"asin": "A3", "title": "Third"},
    {"asin": "A1", "title": "Again", "description": ["later"]},
    {"asin": "XX", "title": "Nowhere", "description": ["no market"]},
]


def write_gz(path, lines):
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def raw(tmp_path):
    meta = write_gz(tmp_path / "meta_Things.json.gz", [json.dumps(m) for m in META])
    (tmp_path / "us_5core.txt").write_text(
        "userId itemId ratings date\nu1 A1 5 2014-07-01\nu1 0972683275 4 2014-07-01\nu1 A1 5 2014-07-01\nu2 A3 1 2015-01-02\n"
    )
    (tmp_path / "ca_5core.txt").write_text("userId itemId ratings date\nc1 0972683275 5 2016-02-29\n")
    return tmp_path, meta


def test_metadata_and_dedup(spark, raw):
    inter = to_interactions(read_markets(spark, str(raw[0]), ["us", "ca"]))
    chosen = selected_metadata(read_metadata(spark, raw[1]), inter)
    texts = rows_of(item_text(chosen), ITEM, TEXT)
    assert texts == [("0972683275", "Second "), ("A1", "First one"), ("A3", "Third ")]


def test_broken_metadata_line(spark, tmp_path):
    path = write_gz(tmp_path / "meta.json.gz", [json.dumps(META[0]), '{"asin": "A9", "tit', json.dumps(META[1])])
    with pytest.raises(Exception, match="(?i)malformed"):
        read_metadata(spark, path).collect()
    good, broken = split_corrupt(read_metadata(spark, path, strict=False))
    assert good.count() == 2
    assert [r["n_broken"] for r in broken.collect()] == [1]


def test_market_files(spark, raw):
    inter = to_interactions(read_markets(spark, str(raw[0]), ["us", "ca"]))
    assert rows_of(inter, MARKET, USER, ITEM, TIME) == [
        ("ca", "c1", "0972683275", 1456704000),
        ("us", "u1", "0972683275", 1404172800),
        ("us", "u1", "A1", 1404172800),
        ("us", "u1", "A1", 1404172800),
        ("us", "u2", "A3", 1420156800),
    ]


def test_market_files_with_other_column_order(spark, tmp_path):
    (tmp_path / "de_5core.txt").write_text("date userId itemId\n2014-07-01 u 007\n")
    found = to_interactions(read_markets(spark, str(tmp_path), ["de"]))
    assert rows_of(found) == [("de", "u", "007", 1404172800)]


def test_bad_date(spark, tmp_path):
    (tmp_path / "de_5core.txt").write_text("userId itemId date\nu 1 01.07.2014\n")
    rows = read_markets(spark, str(tmp_path), ["de"])
    with pytest.raises(Exception):
        to_interactions(rows).collect()
    assert rows_of(to_interactions(rows, strict=False), TIME) == [(None,)]


def test_epoch_does_not_follow_the_session_zone(spark):
    df = spark.createDataFrame([("2014-07-01",)], "d string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(epoch_seconds("d")).first()[0] == 1404172800
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ratings(spark, tmp_path):
    path = write_gz(tmp_path / "r.gz", ["u1 A1 5.0 2014-07-01", "u2 007 3 2014-07-02"])
    assert rows_of(read_ratings(spark, path)) == [("u1", "A1", 5.0, "2014-07-01"), ("u2", "007", 3.0, "2014-07-02")]


def test_missing_titles_and_descriptions(spark):
    meta = spark.createDataFrame(
        [("a", None, ["x"]), ("b", "T", None), ("c", "T", [None]), ("d", "T", [])],
        f"{ITEM} string, {TITLE} string, {DESCRIPTION} array<string>",
    )
    assert rows_of(item_text(meta)) == [("a", " x"), ("b", "T "), ("c", "T "), ("d", "T ")]
    with pytest.raises(Exception, match="no title"):
        item_text(meta, strict=True).collect()
    assert meta.select(first_or_empty(DESCRIPTION)).distinct().count() == 2
    items = spark.createDataFrame([("a",), ("b",), ("z",)], f"{ITEM} string")
    assert tuple(coverage_report(items, meta.unionAll(meta)).first()) == (3, 1, 2, 2, 2)
    with pytest.raises(ValueError, match="z"):
        require_coverage(items, meta)


def test_vector_text_round_trip(spark):
    values = [[-1.5, 1e-5, 1e7, 0.1], [3.4028235e38, 1e-38, -0.0, 2.0]]
    df = spark.createDataFrame([(v,) for v in values], "v array<float>")
    again = [r[0] for r in df.select(text_to_vec(vec_to_text("v"))).collect()]
    assert np.array_equal(np.array(again, np.float32), np.array(values, np.float32))
    assert spark.createDataFrame([("",), (None,)], "t string").select(text_to_vec("t")).distinct().collect() == [(None,)]


def test_prepare_end_to_end(spark, raw):
    out = str(raw[0] / "dataset")
    prepare(spark, str(raw[0]), raw[1], out, ["us", "ca"], dim=16)
    inter, items = read_prepared(spark, out, "us")
    assert rows_of(inter, MARKET, USER, ITEM, TIME) == [
        ("us", "u1", "0972683275", 1404172800),
        ("us", "u1", "A1", 1404172800),
        ("us", "u1", "A1", 1404172800),
        ("us", "u2", "A3", 1420156800),
    ]
    assert {r[ITEM] for r in items.collect()} == {"A1", "0972683275", "A3"}
    vectors = read_vectors(spark, out + "/item_emb.csv")
    assert vectors.count() == 3
    for r in vectors.collect():
        assert np.isclose(np.linalg.norm(r[VECTOR]), 1.0)
    assert [r[ITEM] for r in read_prepared(spark, out, "ca")[1].collect()] == ["0972683275"]
    first = (raw[0] / "dataset" / "us" / "us.inter").glob("part-*.csv")
    assert next(first).read_text().splitlines()[0] == "user_id:token\titem_id:token\ttimestamp:float"


def test_typed_header_checks(spark, tmp_path):
    (tmp_path / "a.inter").write_text("user_id:token\tx:odd\nu\t1\n")
    path = str(tmp_path / "a.inter")
    assert rows_of(read_typed(spark, path, load=["user_id"])) == [("u",)]
    with pytest.raises(ValueError, match="odd"):
        read_typed(spark, path)
    with pytest.raises(ValueError, match="item_id"):
        read_typed(spark, path, load=["user_id", "item_id"])


def test_params_and_master(spark, tmp_path):
    rows = spark.createDataFrame([("w", 0, [1.0, 2.0])], "name string, row int, values array<float>")
    rows.write.parquet(str(tmp_path / "p"))
    assert rows_of(read_params(spark, str(tmp_path / "p"))) == [("w", 0, [1.0, 2.0])]
    df = spark.createDataFrame([("us", 1), ("ca", 2)], f"{MARKET} string, x int")
    write_master(df, str(tmp_path / "m"))
    assert rows_of(spark.read.parquet(str(tmp_path / "m")), MARKET, "x") == [("ca", 2), ("us", 1)]
    assert (tmp_path / "m" / "market=us").is_dir()


def test_text_vectors(spark):
    texts = [("a", "Red red BLUE-42 über"), ("b", ""), ("c", None), ("d", "... --"), ("e", "w " * 600 + "end")]
    df = spark.createDataFrame(texts, f"{ITEM} string, {TEXT} string")
    assert df.where(f"{ITEM} = 'a'").select(tokens(TEXT)).first()[0] == ["red", "red", "blue", "42", "über"]
    found = {r[ITEM]: np.array(r[VECTOR]) for r in text_vectors(df, 32).collect()}
    assert len(found) == 5 and all(len(v) == 32 for v in found.values())
    assert np.isclose(np.linalg.norm(found["a"]), 1.0)
    assert not found["b"].any() and not found["c"].any() and not found["d"].any()
    whole = text_weights(df, 1 << 16).where(f"{ITEM} = 'e'")
    assert whole.count() == 2  # the last word counts
    assert text_weights(df, 1 << 16, max_tokens=512).where(f"{ITEM} = 'e'").count() == 1


def test_text_vectors_with_own_encoder(spark):
    df = spark.createDataFrame([(f"i{n}", "x" * n) for n in range(10)], f"{ITEM} string, {TEXT} string")

    def load():
        def encode(batch):
            assert len(batch) <= 4
            return [[len(text), len(batch)] for text in batch]

        return encode

    found = {r[ITEM]: r[VECTOR] for r in text_vectors(df.coalesce(1), encoder=load).collect()}
    assert found["i7"][0] == 7.0 and len(found) == 10
