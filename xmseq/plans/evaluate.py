"""Leave-one-out evaluation against sampled negatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.model import IID, ITEM, N_NEGATIVES, PHASE, SEQ, TOP_K
from xmseq.operators.lookup import lookup_vectors
from xmseq.operators.metrics import rank_first, ranking_metrics
from xmseq.operators.sampling import NEGATIVES, uniform_negatives
from xmseq.operators.scoring import CANDIDATES, SEQ_VECTOR, score_candidates
from xmseq.operators.sequences import TEST, item_ids, target_rows

Encoder = Callable[[DataFrame], DataFrame]


def last_item_encoder(vectors: DataFrame) -> Encoder:
    """The vector of the latest item stands for the sequence."""

    def encode(rows: DataFrame) -> DataFrame:
        found = lookup_vectors(rows.withColumn("_last", F.element_at(SEQ, -1)), vectors, "_last", SEQ_VECTOR)
        return found.drop("_last")

    return encode


def scored_targets(
    inter: DataFrame,
    vectors: DataFrame,
    encode: Encoder,
    ties: Sequence[str] = (),
    which: str = TEST,
    n: int = N_NEGATIVES,
    seed: int = 7,
) -> DataFrame:
    """Target rows of a phase with candidates (the positive first) and their scores."""
    ids = item_ids(inter)
    rows = target_rows(inter, ties, which).withColumn(PHASE, F.lit(which))
    drawn = uniform_negatives(rows, ids, n, seed)
    encoded = encode(drawn).withColumn(CANDIDATES, F.concat(F.array(IID), NEGATIVES)).drop(NEGATIVES, SEQ, ITEM)
    return score_candidates(encoded, ids, vectors)


def sampled_evaluation(
    inter: DataFrame,
    vectors: DataFrame,
    encode: Encoder | None = None,
    ties: Sequence[str] = (),
    which: str = TEST,
    n: int = N_NEGATIVES,
    seed: int = 7,
    top_k: Sequence[int] = TOP_K,
    digits: int | None = 4,
) -> DataFrame:
    """MRR and NDCG per market of a phase."""
    scored = scored_targets(inter, vectors, encode or last_item_encoder(vectors), ties, which, n, seed)
    return ranking_metrics(rank_first(scored), top_k, digits=digits)
