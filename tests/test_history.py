"""Compressed histories against sets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from xmseq.model import IID, MARKET, USER
from xmseq.operators import history
from xmseq.operators.sampling import NEGATIVES, exclude_history

RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def seen(spark):
    """Few items, exactly as many as fit into a list, one more, a whole chunk, several chunks, repeats."""
    users = {
        "few": [3, 70_000, 3, 131_072],
        "list": RNG.choice(65_536, history.MOST_PLACES, replace=False).tolist(),
        "bits": RNG.choice(65_536, history.MOST_PLACES + 1, replace=False).tolist(),
        "all": list(range(65_536)),
        "wide": (RNG.choice(40, 30, replace=False) * 65_536 + 65_535).tolist(),
    }
    rows = [("us", u, int(i)) for u, ids in users.items() for i in ids] + [("ca", "few", 9), (None, "few", 5), ("us", None, 5), ("us", "few", None)]
    table = spark.createDataFrame(rows, f"{MARKET} string, {USER} string, {IID} bigint").repartition(5)
    return users, table


def test_exclusion(spark, seen):
    users, table = seen
    asked = [("us", u, sorted({0, 1, 3, 5, 9, 65_535, 65_536, 70_000, 131_071, 131_072, *RNG.integers(0, 200_000, 300).tolist()}), "x") for u in [*users, "nobody"]]
    asked += [("ca", "few", [9, 3, 10], "x"), (None, "few", [5, 6], "x"), ("us", None, [5], "x"), ("us", "few", [], "x"), ("us", "all", None, "x"), ("us", "few", [131_072, 2, 3], "y")]
    rows = spark.createDataFrame(asked, f"{MARKET} string, {USER} string, {NEGATIVES} array<bigint>, other string").repartition(3)
    want = []
    for market, user, ids, other in asked:
        known = set(users.get(user, [])) if market == "us" else {9} if market == "ca" else set()
        want.append((market, user, [i for i in ids or [] if i not in known], other))
    found = exclude_history(rows, table)
    assert found.columns == rows.columns
    assert rows_of(found) == sorted(want, key=repr)
    assert exclude_history(rows, table.limit(0)).agg(F.sum(F.size(NEGATIVES))).first()[0] == sum(len(a[2] or []) for a in asked)
    assert exclude_history(rows.limit(0), table).count() == 0


def test_sizes(spark, seen):
    """Two bytes an item, or a bit for each place, whatever is smaller."""
    users, table = seen
    for r in history.seen_items(table).where(f"{MARKET} = 'us'").collect():
        assert sum(len(c["bits"]) for c in r[history.SEEN]) <= min(2 * len(set(users[r[USER]])), 8192 * len(r[history.SEEN]))


def test_candidates_stay_in_their_row(spark, seen):
    rows = spark.createDataFrame([("us", "few", [1])], f"{MARKET} string, {USER} string, {NEGATIVES} array<bigint>")
    plan = exclude_history(rows, seen[1])._jdf.queryExecution().toString()
    assert "Generate" not in plan and "anti" not in plan.lower()


def test_no_chunks():
    kind = pa.list_(pa.struct([("chunk", pa.int64()), ("bits", pa.binary())]))
    assert history.among_seen(np.array([0, 1]), np.array([5, 6]), pa.array([None, []], kind)).tolist() == [False, False]
