"""Typed tables by the data source: round trips, ranges of bytes, the text reader, commits."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from xmseq.sources import typed
from xmseq.sources.prepared import read_typed

SCHEMA = "item_id string, score double, item_emb array<float>, n bigint"
ROWS = [
    ("a", 1.5, [0.25, -1e-5, 1e7], 1),
    ("0012", -0.0, [], 2),
    ("", None, None, None),
    (None, float("inf"), [1.0], 4),
    ('q"uo\\te', 1e300, [2.5], 5),
    ("tab\there", 0.1, [3.0, 4.0], 6),
    ("é 漢 :x", 7.0, [0.0], 7),
]


@pytest.fixture(scope="module")
def frame(spark):
    typed.register(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


def stored(frame, path, mode="append", parts=2):
    frame.repartition(parts).write.format("typed_table").mode(mode).save(path)
    return path


def expected(rows=ROWS):
    return sorted(((i, s, v, None if n is None else str(n)) for i, s, v, n in rows), key=repr)


@pytest.mark.parametrize("size", [1 << 20, 40, 7])
def test_round_trip(spark, frame, tmp_path, size):
    path = stored(frame, str(tmp_path / "t"))
    found = spark.read.format("typed_table").option("rangeBytes", size).load(path)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields] == ["item_id string", "score double", "item_emb array<float>", "n string"]
    assert rows_of(found) == sorted((tuple(r) for r in spark.createDataFrame([(i, s, v, None if n is None else str(n)) for i, s, v, n in ROWS], "item_id string, score double, item_emb array<float>, n string").collect()), key=repr)
    assert not [f for f in os.listdir(path) if f.startswith("_temporary")]


def test_columns_and_text_reader(spark, frame, tmp_path):
    plain = frame.where("item_id in ('a', '0012')").drop("n")
    path = stored(plain.where("size(item_emb) > 0"), str(tmp_path / "t"))
    some = spark.read.format("typed_table").option("load", "item_emb, item_id").load(path)
    assert some.columns == ["item_emb", "item_id"]
    assert rows_of(some) == rows_of(read_typed(spark, path, load=["item_id", "item_emb"]).select("item_emb", "item_id"))
    for wrong in ({"load": "other"}, {"sep": ";"}):
        with pytest.raises(Exception, match="not"):
            spark.read.format("typed_table").options(**wrong).load(path).count()


def test_append_overwrite_and_failure(spark, frame, tmp_path):
    path = stored(frame.limit(2), str(tmp_path / "t"))
    stored(frame.limit(1), path)
    read = spark.read.format("typed_table")
    assert read.load(path).count() == 3
    broken = frame.withColumn("item_id", F.when(F.col("n") == 5, "line\nbreak").otherwise(F.col("item_id")))
    with pytest.raises(Exception, match="line break"):
        stored(broken, path, "overwrite")
    assert read.load(path).count() == 3
    stored(frame, path, "overwrite")
    assert read.load(path).count() == len(ROWS)
    stored(frame.limit(0), path, "overwrite")
    assert read.load(path).count() == 0
