import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from xmseq.model import EVENTS, IID, ITEM, LENGTH, MARKET, PHASE, POS, SEQ, TIME, USER
from xmseq.operators import losses
from xmseq.operators.sequences import (
    TEST,
    VALID,
    build_sequences,
    item_ids,
    latest_sequence,
    loo_split,
    order_events,
    target_rows,
)

SCHEMA = f"{MARKET} string, {USER} string, {ITEM} string, {TIME} bigint, ord bigint"


def brute_force(events, max_len=50):
    """(market, user) -> events in order."""
    users = {}
    for e in events:
        users.setdefault(e[:2], []).append(e)
    return {u: sorted(es, key=lambda e: (e[3], e[4], e[2])) for u, es in users.items()}


def some_events():
    rng = random.Random(3)
    events = []
    for user, n in [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 52), ("hot", 400)]:
        for market in ("us", "ca") if user in "ad" else ("us",):
            events += [(market, user, f"i{rng.randrange(30):02d}", rng.randrange(5) * 86400, rng.randrange(3)) for _ in range(n)]
    events += [("us", "copies", "i07", 86400, 1)] * 150 + [("us", "copies", "i08", 86400, 2)] * 3
    rng.shuffle(events)
    return events


@pytest.fixture(scope="module")
def events():
    return some_events()


@pytest.fixture(scope="module")
def inter(spark, events):
    return spark.createDataFrame(events, SCHEMA)


@pytest.mark.parametrize("hot_rows", [None, 2_000_000, 60])
def test_sequences_equal_brute_force(inter, events, hot_rows):
    expected = []
    for (market, user), es in brute_force(events).items():
        for i in range(1, len(es)):
            seq = [e[2] for e in es[max(0, i - 50) : i]]
            expected.append((market, user, i + 1, es[i][2], len(es), len(seq), seq))
    found = build_sequences(inter, ["ord"], hot_rows=hot_rows)
    assert rows_of(found, MARKET, USER, POS, ITEM, EVENTS, LENGTH, SEQ) == sorted(expected, key=repr)


def test_missing_user_and_large_reach(spark, inter, events):
    lost = inter.withColumn(USER, F.when(F.col(USER) != "hot", F.col(USER)))
    columns = [MARKET, USER, POS, ITEM, EVENTS]
    plain = rows_of(order_events(lost, ["ord"], hot_rows=None), *columns)
    assert rows_of(order_events(lost, ["ord"], hot_rows=60), *columns) == plain
    expected = [(m, u, [e[2] for e in es]) for (m, u), es in brute_force(events).items()]
    assert rows_of(latest_sequence(inter, ["ord"], 5000), MARKET, USER, SEQ) == sorted(expected, key=repr)


@pytest.mark.parametrize("hot_rows", [2_000_000, 60])
def test_positions(inter, events, hot_rows):
    expected = [
        (m, u, i + 1, e[2], e[3], len(es)) for (m, u), es in brute_force(events).items() for i, e in enumerate(es)
    ]
    found = order_events(inter, ["ord"], hot_rows=hot_rows)
    assert rows_of(found, MARKET, USER, POS, ITEM, TIME, EVENTS) == sorted(expected, key=repr)


def test_result_does_not_depend_on_input_order_or_partitions(inter):
    first = rows_of(build_sequences(inter, hot_rows=60), MARKET, USER, POS, ITEM, SEQ)
    again = build_sequences(inter.repartition(7).orderBy(F.rand(5)), hot_rows=60)
    assert rows_of(again, MARKET, USER, POS, ITEM, SEQ) == first


def test_split(inter):
    phases = {}
    for market, user, pos, phase in rows_of(loo_split(order_events(inter, ["ord"])), MARKET, USER, POS, PHASE):
        phases.setdefault((market, user), []).append((pos, phase))
    phases = {u: [p for _, p in sorted(rows)] for u, rows in phases.items()}
    assert ("us", "a") not in phases
    assert phases["us", "b"] == ["train"]
    assert phases["us", "c"] == ["train", "test"]
    assert phases["us", "d"] == ["train", "valid", "test"]
    assert phases["us", "e"] == ["train"] * 49 + ["valid", "test"]


@pytest.mark.parametrize("which", [VALID, TEST])
@pytest.mark.parametrize("max_len", [50, 1])
def test_target_rows_equal_the_split(inter, which, max_len):
    whole = loo_split(build_sequences(inter, ["ord"], max_len)).where(F.col(PHASE) == which)
    columns = [MARKET, USER, ITEM, SEQ, LENGTH]
    assert rows_of(target_rows(inter, ["ord"], which, max_len), *columns) == rows_of(whole, *columns)


def test_latest_sequence(inter, events):
    expected = [(m, u, [e[2] for e in es[-50:]]) for (m, u), es in brute_force(events).items()]
    assert rows_of(latest_sequence(inter, ["ord"]), MARKET, USER, SEQ) == sorted(expected, key=repr)


def test_several_list_columns(inter):
    found = build_sequences(inter, ["ord"], 3, fields={ITEM: SEQ, TIME: "ts_list"}, hot_rows=60)
    assert found.where(F.size(SEQ) != F.size("ts_list")).count() == 0


@pytest.mark.parametrize("small_rows", [0, 500_000])
def test_item_ids(inter, events, small_rows):
    expected = []
    for market in ("us", "ca"):
        items = sorted({e[2] for e in events if e[0] == market})
        expected += [(market, item, i + 1, len(items)) for i, item in enumerate(items)]
    found = item_ids(inter, small_rows)
    assert rows_of(found, MARKET, ITEM, IID, "n_items") == sorted(expected, key=repr)


def test_train_frequency_equals_the_split(inter):
    ids = item_ids(inter)
    train = loo_split(order_events(inter, ["ord"])).where(F.col(PHASE) == "train")
    columns = [MARKET, ITEM, IID, "freq"]
    slow = losses.item_freq(train, ids, include_padding=True)
    fast = losses.train_item_freq(inter, ids, ["ord"], include_padding=True)
    assert rows_of(fast, *columns) == rows_of(slow, *columns)
    assert fast.where("iid = 0").count() == 2
