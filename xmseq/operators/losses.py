"""Item frequency, frequency weights and losses over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmseq.functions.activations import softplus, weight_decay
from xmseq.functions.vectors import dot, logsumexp, once
from xmseq.model import ALPHA, BETA, IID, ITEM, ITEM_KEY, MARKET, TIME, USER_KEY, VECTOR
from xmseq.operators.blocks import all_item_logsumexp, each_logsumexp
from xmseq.operators.groups import same, total_order
from xmseq.operators.lookup import lookup, lookup_vectors_by, one_per_key, padding_rows
from xmseq.operators.scoring import SEQ_VECTOR
from xmseq.operators.sequences import last_events
from xmseq.storage import BROADCAST_BYTES, SMALL_ROWS, fits, pin, vector_table_bytes

FREQ = "freq"
WEIGHT = "weight"


def item_freq(rows: DataFrame, ids: DataFrame, include_padding: bool = False) -> DataFrame:
    """Rows per item of the dictionary, 0 where there are none; with id 0 on request."""
    counts = rows.groupBy(*ITEM_KEY).agg(F.count("*").alias(FREQ))
    return _zero_filled(ids, counts, include_padding)


def train_item_freq(
    inter: DataFrame, ids: DataFrame, ties: Sequence[str] = (), include_padding: bool = False
) -> DataFrame:
    """Training targets per item, from the interactions.

    All events less those that are no training target: each user's first, and the last two as far as they are test and
    valid. Counts are added up before they move, and each task passes on five events of a user at most.
    """
    order = F.struct(*total_order(inter, [TIME, *ties], USER_KEY))
    first = inter.groupBy(*USER_KEY).agg(F.min_by(ITEM, order).alias(ITEM))
    # Four events tell whether a user has three, or four and more: one more than are left out.
    events = F.array_sort(F.collect_list(F.struct("back", ITEM)))
    last = last_events(inter, ties, 4).groupBy(*USER_KEY).agg(events.alias("_e"))
    left_out = F.when(F.size("_e") >= 4, 2).when(F.size("_e") == 3, 1).otherwise(0)
    last = last.select(MARKET, F.explode(F.slice("_e", 1, left_out)).alias("_x")).select(f"_x.{ITEM}", MARKET)
    less = first.select(*ITEM_KEY).unionAll(last).withColumn("_by", F.lit(-1))
    both = inter.select(*ITEM_KEY).withColumn("_by", F.lit(1)).unionAll(less)
    counts = both.groupBy(*ITEM_KEY).agg(F.sum("_by").alias(FREQ))
    return _zero_filled(ids, counts, include_padding)


def _zero_filled(ids: DataFrame, counts: DataFrame, include_padding: bool) -> DataFrame:
    rows = ids.select(MARKET, ITEM, IID)
    if include_padding:
        rows = rows.unionByName(padding_rows(ids))
    freq = F.coalesce(FREQ, F.lit(0).cast("bigint"))
    return rows.join(counts, ITEM_KEY, "left").select(*ITEM_KEY, IID, freq.alias(FREQ))


def item_weights(freq: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Weight of each item by its frequency."""
    return freq.withColumn(WEIGHT, weight_decay(FREQ, alpha, beta))


def with_weights(rows: DataFrame, weights: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Weight of each row's target; a target of unknown frequency counts as frequency 0."""
    found = lookup(rows, weights.select(*ITEM_KEY, WEIGHT), ITEM_KEY, "left")
    return found.withColumn(WEIGHT, F.coalesce(WEIGHT, weight_decay(F.lit(0.0), alpha, beta)))


def log_softmax(scored: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """Add `log_p` over each group's candidates; a null group is a group.

    The rows are stored once, and groups are only aggregated and joined, so none has to fit a task. What is known of few groups
    (checked) is broadcast, and rows then stay where they are.
    """
    group = list(group)
    scored = pin(scored, "scored")

    def stored(per_group: DataFrame) -> DataFrame:
        found = pin(per_group, "groups")
        return F.broadcast(found) if fits(found, SMALL_ROWS, BROADCAST_BYTES) else found

    peak, equal = same(scored, stored(scored.groupBy(*group).agg(F.max(score).alias("_peak"))), group)
    names = [f"_same_{k}" for k in group]
    shifted = scored.join(peak, equal).drop(*names).withColumn("_e", F.exp(F.col(score) - F.col("_peak")))
    total = shifted.groupBy(*group).agg((F.max("_peak") + F.log(F.sum("_e"))).alias("_lse"))
    total, equal = same(scored, stored(total), group)
    return scored.join(total, equal).drop(*names).withColumn("log_p", F.col(score) - F.col("_lse")).drop("_lse")


def array_log_softmax(scores: Column | str) -> Column:
    """The same for scores that lie in one array: no shuffle."""
    return once(logsumexp(scores), lambda lse: F.transform(scores, lambda s: s - lse))


def all_item_nll(
    rows: DataFrame,
    items: DataFrame,
    key: Sequence[str],
    target: str = ITEM,
    include_padding: bool = False,
    shared: bool = False,
    vectors: DataFrame | None = None,
    last: str | None = None,
    **blocks,
) -> DataFrame:
    """Replace the vector of each row by `nll`, -log p of the target over all items (of its market, if `items` has one).

    Padding is one more class with logit 0. `shared` says that many rows have the same vector, as where one item stands for a
    sequence: each vector then meets the items once. Equal vectors are known by 128 bits of hashes.

    `vectors` are those that the items of every market were taken from: targets, each an item of its market, are looked up there,
    and no vector is filed anew for every market. `last` names the item in it whose vector stands for the sequence, if one does:
    that is what tells different vectors' rows apart then, and no vector is shuffled.
    """
    group = [MARKET] if MARKET in items.columns else []
    on = [target, *group] if vectors is None else [target]
    named = items if vectors is None else vectors
    table = named.select(F.col(ITEM).alias(target), F.col(VECTOR).alias("_target"), *on[1:])
    small = vector_table_bytes(table, "_target") <= blocks.get("limit_bytes", BROADCAST_BYTES)
    found = lookup_vectors_by(rows, table, on, "_target", small)
    own = found.withColumn("_own", dot(SEQ_VECTOR, "_target")).drop("_target")
    if shared:
        mark = {"_h1": F.xxhash64(SEQ_VECTOR), "_h2": F.xxhash64(F.lit(1), SEQ_VECTOR)}
        by_item = vectors is not None and last is not None and one_per_key(vectors, [ITEM], VECTOR)
        sums = each_logsumexp(rows, items, mark, *((last, vectors) if by_item else ()), **blocks)
        found = lookup(own.withColumns(mark).drop(SEQ_VECTOR), sums, [*group, *mark], "inner")
        # A dictionary of numbers has no NaN, and every vector that is found has a sum.
        scored = found.withColumn("lse", F.coalesce("lse", F.lit(float("nan")))).drop(*mark)
    else:
        scored = all_item_logsumexp(own, items, **blocks)
    lse = softplus(F.col("lse")) if include_padding else F.col("lse")
    return scored.withColumn("nll", lse - F.col("_own")).drop("_own", "lse")


def ce_loss(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean nll."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg("nll").alias("loss"))


def wce_loss(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean nll weighted by the target's weight."""
    weighted = F.sum(F.col(WEIGHT) * F.col("nll")) / F.sum(WEIGHT)
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), weighted.alias("loss"))


def bpr_loss(rows: DataFrame, by: Sequence[str] = (), pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    """Mean of -log sigmoid(pos - neg)."""
    nll = softplus(F.col(neg) - F.col(pos))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(nll).alias("loss"))
