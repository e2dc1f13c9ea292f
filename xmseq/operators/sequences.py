"""Time order, prefix sequences, leave-one-out split, dense item ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xmseq.model import EVENTS, IID, ITEM, ITEM_KEY, LENGTH, MARKET, MAX_LENGTH, PHASE, POS, SEQ, TIME, USER_KEY
from xmseq.operators.groups import HOT_ROWS, number_rows, split_hot, total_order
from xmseq.operators.prep import market_item_sets
from xmseq.storage import SMALL_ROWS, at_most, pin

TRAIN, VALID, TEST = "train", "valid", "test"
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def _order(inter: DataFrame, ties: Sequence[str]) -> list[str]:
    return total_order(inter, [TIME, *ties], USER_KEY)


def order_events(inter: DataFrame, ties: Sequence[str] = (), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Position from 1 (oldest) of each event of its user, and the user's event count.

    Order: time, `ties`, then all other columns. Users above `hot_rows` events are numbered across tasks.
    """
    return build_sequences(inter, ties, fields={}, hot_rows=hot_rows, keep_first=True).drop(LENGTH)


def build_sequences(
    inter: DataFrame,
    ties: Sequence[str] = (),
    max_len: int = MAX_LENGTH,
    fields: dict[str, str] | None = None,
    hot_rows: int | None = HOT_ROWS,
    keep_first: bool = False,
) -> DataFrame:
    """Every event but its user's first, with the at most `max_len` events before it, oldest first.

    `fields` maps columns to the list columns made of them; default the item ids. Adds position, event count and length.
    """
    fields = {ITEM: SEQ} if fields is None else fields
    order = _order(inter, ties)
    usual, hot, n_hot = split_hot(inter, USER_KEY, hot_rows)
    by_time = Window.partitionBy(*USER_KEY).orderBy(*order)
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = usual.select(
        "*",
        F.row_number().over(by_time).cast("bigint").alias(POS),
        F.count("*").over(whole).alias(EVENTS),
        *_lists(fields, by_time.rowsBetween(-max_len, -1)),
    )
    if hot is not None:
        numbered = number_rows(hot, USER_KEY, order, POS, EVENTS, -(-n_hot // hot_rows))
        out = out.unionByName(_hot_lists(numbered, fields, max_len, max(hot_rows, max_len)) if fields else numbered)
    out = out.withColumn(LENGTH, F.least(F.col(POS) - 1, F.lit(max_len)).cast("int"))
    return out if keep_first else out.where(F.col(POS) > 1)


def _lists(fields: dict[str, str], frame: Window) -> list[Column]:
    return [F.collect_list(c).over(frame).alias(name) for c, name in fields.items()]


def _hot_lists(numbered: DataFrame, fields: dict[str, str], max_len: int, piece: int) -> DataFrame:
    """Lists for users cut into pieces of `piece` positions; each piece also sees the `max_len` events before it."""
    own = F.expr(f"({POS} - 1) div {piece}")
    seen_next = ((F.col(POS) - 1) % piece >= piece - max_len) & (F.col(POS) < F.col(EVENTS))
    pieces = numbered.withColumn(
        "_piece", F.explode(F.when(seen_next, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = Window.partitionBy(*USER_KEY, "_piece").orderBy(POS).rowsBetween(-max_len, -1)
    return pieces.select("*", *_lists(fields, frame)).where(F.col("_piece") == own).drop("_piece")


def phase() -> Column:
    """Phase of an event by its position: last test, last but one valid, other targets train, first NULL.

    A user keeps a training target before getting a valid one, and gets a test one before a valid one.
    """
    pos, n = F.col(POS), F.col(EVENTS)
    return (
        F.when((pos == n) & (n >= 3), TEST)
        .when((pos == n - 1) & (n >= 4), VALID)
        .when(pos >= 2, TRAIN)
    )


def loo_split(rows: DataFrame) -> DataFrame:
    """Add the phase to rows with position and event count, and drop first events."""
    return rows.withColumn(PHASE, phase()).where(F.col(PHASE).isNotNull())


def last_events(inter: DataFrame, ties: Sequence[str], n: int) -> DataFrame:
    """The last `n` events of each user with `back` = 1 for the latest.

    Each task passes on at most `n` rows of a user, so no user is too large. Spark does that for limits below the one
    the session sets; a longer reach is taken from the positions of all events.
    """
    if n >= int(inter.sparkSession.conf.get(GROUP_LIMIT)):
        placed = order_events(inter, ties).withColumn("back", F.col(EVENTS) - F.col(POS) + 1)
        return placed.where(F.col("back") <= n).drop(POS, EVENTS)
    latest = [F.col(c).desc() for c in _order(inter, ties)]
    back = F.row_number().over(Window.partitionBy(*USER_KEY).orderBy(*latest)).cast("bigint")
    return inter.withColumn("back", back).where(F.col("back") <= n)


def latest_sequence(inter: DataFrame, ties: Sequence[str] = (), max_len: int = MAX_LENGTH) -> DataFrame:
    """The last at most `max_len` items of each user, oldest first."""
    seq = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), ITEM)))
    return (
        last_events(inter, ties, max_len)
        .groupBy(*USER_KEY)
        .agg(F.transform(seq, lambda x: x[ITEM]).alias(SEQ))
        .withColumn(LENGTH, F.size(SEQ))
    )


def target_rows(
    inter: DataFrame, ties: Sequence[str] = (), which: str = TEST, max_len: int = MAX_LENGTH
) -> DataFrame:
    """The test or valid row of each user that has one: target item and the sequence before it.

    Equals the rows of that phase in the split of all sequences, from the last few events of each user only.
    """
    skip, needed = {TEST: (0, 3), VALID: (1, 4)}[which]
    reach = max(max_len + 1 + skip, needed)
    events = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), ITEM)))
    users = last_events(inter, ties, reach).groupBy(*USER_KEY).agg(F.transform(events, lambda x: x[ITEM]).alias("_e"))
    size = F.size("_e")
    seq = F.slice("_e", F.greatest(size - skip - max_len, F.lit(1)), F.least(size - skip - 1, F.lit(max_len)))
    return users.where(size >= needed).select(
        *USER_KEY, F.get("_e", size - skip - 1).alias(ITEM), seq.alias(SEQ), F.size(seq).alias(LENGTH)
    )


def item_ids(inter: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Dense ids 1..N of each market's items in item order, with N; 0 stays free for padding.

    A dictionary of up to `small_rows` rows (checked) is numbered in a window per market, a larger one across tasks.
    """
    sets = pin(market_item_sets(inter), "item-sets")
    if at_most(sets, small_rows):
        market = Window.partitionBy(MARKET)
        number = F.row_number().over(market.orderBy(ITEM)).cast("bigint")
        return sets.select(*ITEM_KEY, number.alias(IID), F.count("*").over(market).alias("n_items"))
    parts = -(-sets.count() // max(small_rows, 1))
    numbered = number_rows(sets, [MARKET], [ITEM], IID, "n_items", parts, distinct=True)
    return pin(numbered, "item-ids").select(*ITEM_KEY, IID, "n_items")
