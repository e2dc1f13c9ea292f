"""A master by user: the same rows as from any table, and no shuffle."""

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from catalog import tables as t
from xmseq.model import EVENTS, ITEM, MARKET, PHASE, POS, SEQ, TIME, USER, USER_KEY
from xmseq.operators import sequences
from xmseq.sinks.buckets import read_buckets, spec_path, write_buckets

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("master") / "inter")
    write_buckets(t.purchases(spark, SF), path, t.TIES, buckets=3)
    return path


def test_same_rows_without_shuffle(spark, stored):
    inter = t.purchases(spark, SF)
    for make, columns in (
        (lambda df: sequences.loo_split(sequences.order_events(df, t.TIES, hot_rows=None)), (*USER_KEY, POS, EVENTS, ITEM, PHASE)),
        (lambda df: sequences.latest_sequence(df, t.TIES), (*USER_KEY, SEQ)),
        (lambda df: sequences.build_sequences(df, t.TIES, hot_rows=None), (*USER_KEY, POS, SEQ)),
        (lambda df: sequences.target_rows(df, t.TIES), (*USER_KEY, ITEM, SEQ)),
    ):
        found = make(read_buckets(spark, stored))
        assert exchanges(found) == 0 and exchanges(make(inter)) > 0
        assert rows_of(found, *columns) == rows_of(make(inter), *columns)


def test_large_users_are_still_told_apart(spark, stored):
    inter = t.purchases(spark, SF)
    found = sequences.order_events(read_buckets(spark, stored), t.TIES, hot_rows=20)
    assert rows_of(found, *USER_KEY, POS, EVENTS, ITEM) == rows_of(sequences.order_events(inter, t.TIES), *USER_KEY, POS, EVENTS, ITEM)


def test_nothing_is_lost(spark, tmp_path):
    rows = [("us", None, "i", 5), (None, "u", "j", 4), ("us", "u", "i", 5), ("us", "u", "i", 5)]
    inter = spark.createDataFrame(rows, f"{MARKET} string, {USER} string, {ITEM} string, {TIME} bigint")
    write_buckets(inter, str(tmp_path / "few"))
    assert rows_of(read_buckets(spark, str(tmp_path / "few")), MARKET, USER, ITEM, TIME) == sorted(rows, key=repr)
    assert spark.read.parquet(spec_path(str(tmp_path / "few"))).first()["buckets"] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_buckets(inter.where(F.lit(False)), str(tmp_path / "none"))
    assert read_buckets(spark, str(tmp_path / "none")).count() == 0
