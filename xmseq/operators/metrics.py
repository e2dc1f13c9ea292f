"""Rank of the positive and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmseq.model import MARKET, PHASE, TOP_K, VALID_METRIC
from xmseq.operators.scoring import CANDIDATES, SCORES

RANK = "rank"


def beats(score: Column, item: Column, pos_score: Column, pos_item: Column) -> Column:
    """A candidate beats the positive by a larger score, or by a smaller id at equal score."""
    return (score > pos_score) | ((score == pos_score) & (item < pos_item))


def rank_positive(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rank from one row per candidate with `score`, `candidate`, `pos_score`, `positive`.

    Counts the better candidates: no sort, and tasks add up their part first.
    """
    better = beats(F.col("score"), F.col("candidate"), F.col("pos_score"), F.col("positive"))
    return scored.groupBy(*key).agg((F.count_if(better) + 1).alias(RANK))


def rank_first(rows: DataFrame) -> DataFrame:
    """Rank of the first candidate from the row's arrays of candidates and scores: no shuffle."""
    pos_score, pos_item = F.get(SCORES, F.lit(0)), F.get(CANDIDATES, F.lit(0))
    better = F.zip_with(SCORES, CANDIDATES, lambda s, c: beats(s, c, pos_score, pos_item))
    return rows.withColumn(RANK, (F.size(F.filter(better, lambda b: b)) + 1).cast("bigint"))


def ranking_metrics(
    ranks: DataFrame, top_k: Sequence[int] = TOP_K, by: Sequence[str] = (MARKET, PHASE), digits: int | None = 4
) -> DataFrame:
    """MRR@k and NDCG@k with one positive per row, averaged over rows, as (by.., metric, k, value)."""
    rank = F.col(RANK)
    gains = {"MRR": 1.0 / rank, "NDCG": 1.0 / F.log2(rank + 1.0)}
    means = {
        (m, k): F.avg(F.when(rank <= k, g).otherwise(0.0)) for m, g in gains.items() for k in top_k
    }
    lines = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(k).cast("bigint").alias("k"),
            (F.round(v, digits) if digits is not None else v).alias("value"),
        )
        for (m, k), v in means.items()
    ]
    return ranks.groupBy(*by).agg(F.array(*lines).alias("_lines")).select(*by, F.inline("_lines"))


def report_line(metrics: DataFrame, by: Sequence[str] = (MARKET, PHASE)) -> DataFrame:
    """Metric values in fixed order (MRR then NDCG, k ascending) in one blank-separated text per group."""
    ordered = F.array_sort(F.collect_list(F.struct("metric", "k", "value")))
    return metrics.groupBy(*by).agg(
        F.array_join(F.transform(ordered, lambda x: x["value"].cast("string")), " ").alias("line")
    )


def best_run(runs: DataFrame, metric: str = VALID_METRIC, bigger: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The run with the best value of `metric` (name@k) in a table of (by.., run, metric, k, value); ties to the smaller run."""
    name, k = metric.split("@")
    value = F.col("value") if bigger else -F.col("value")
    chosen = runs.where((F.col("metric") == name) & (F.col("k") == int(k)))
    best = F.min_by(F.struct("run", "value"), F.struct((-value).alias("v"), "run"))
    return chosen.groupBy(*by).agg(best.alias("_b")).where("_b is not null").select(*by, "_b.run", "_b.value")
