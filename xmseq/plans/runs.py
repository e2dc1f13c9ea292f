"""Choice among sets of parameters: all encode and score the same rows in one scan, one is chosen on validation rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.model import HEADS, HIDDEN_ACT, IID, ITEM, MARKET, N_NEGATIVES, PHASE, SEQ, TOP_K, VALID_METRIC
from xmseq.operators.encoder import ACTIVATIONS, POSITION, SLICE_CELLS, encode_last, padded
from xmseq.operators.matrix import to_lists
from xmseq.operators.metrics import best_run, rank_first, ranking_metrics
from xmseq.operators.params import collect_params
from xmseq.operators.sampling import NEGATIVES, uniform_negatives
from xmseq.operators.scoring import CANDIDATES, SEQ_VECTOR, score_candidates
from xmseq.operators.sequences import TEST, VALID, item_ids, target_rows
from xmseq.operators.vector_store import vector_source
from xmseq.storage import BROADCAST_BYTES, pin

RUN = "run"
#: Sets of parameters that are compared at once; each is a model of its own in every task.
MOST_RUNS = 64


def collect_runs(params: DataFrame, params_bytes: int = BROADCAST_BYTES) -> dict[str, dict[str, np.ndarray]]:
    """Matrices by run and name from (run, name, row, values). Rows without a run belong to none."""
    names = sorted(r[RUN] for r in params.select(RUN).where(F.col(RUN).isNotNull()).distinct().limit(MOST_RUNS + 1).collect())
    if not 1 <= len(names) <= MOST_RUNS:
        raise ValueError(f"1 to {MOST_RUNS} runs can be compared at once")
    found = {name: collect_params(params.where(F.col(RUN) == name), params_bytes // len(names)) for name in names}
    shapes = {name: {n: m.shape for n, m in p.items()} for name, p in found.items()}
    unlike = [name for name in names if shapes[name].get(POSITION) != shapes[names[0]].get(POSITION)]
    if unlike:
        raise ValueError(f"runs differ in width or length from {names[0]}: {', '.join(unlike)}")
    return found


def encode_runs(
    rows: DataFrame, vectors: DataFrame, params: DataFrame, heads: int = HEADS, act: str = HIDDEN_ACT, limit_bytes: int = BROADCAST_BYTES, params_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Each row once per run, with its name and the run's sequence vector: items are looked up once for all of them."""
    if act not in ACTIVATIONS:
        raise ValueError(f"activation {act!r} is not one of {', '.join(ACTIVATIONS)}")
    models = collect_runs(params, params_bytes)
    longest, width = next(iter(models.values()))[POSITION].shape
    if width % heads:
        raise ValueError(f"width {width} is not a multiple of {heads} heads")
    source = vector_source(vectors, limit_bytes=limit_bytes)
    if source is None:
        raise ValueError("vectors above the broadcast limit need a shared folder that can be mapped")
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(RUN, T.StringType()), T.StructField(SEQ_VECTOR, T.ArrayType(T.DoubleType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = source.reader()
        step = max(1, SLICE_CELLS // (longest * width))
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                some, lengths, x = padded(part, read, SEQ, width)
                at = np.full(part.num_rows, -1)
                at[some] = np.arange(len(some))
                for name, p in shared.value.items():
                    found = encode_last(x, lengths, p, heads, act) if len(some) else np.zeros((0, width))
                    out = to_lists(found).take(pa.array(at, mask=at < 0))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([name] * part.num_rows), out], schema.names)

    return rows.mapInArrow(encode, schema)


def run_metrics(
    inter: DataFrame,
    vectors: DataFrame,
    params: DataFrame,
    ties: Sequence[str] = (),
    n: int = N_NEGATIVES,
    seed: int = 7,
    top_k: Sequence[int] = TOP_K,
    digits: int | None = 4,
    **encoder,
) -> DataFrame:
    """MRR and NDCG of every run on the validation and the test rows of each market: (run, market, phase, metric, k, value)."""
    ids = item_ids(inter)
    rows = [target_rows(inter, ties, which).withColumn(PHASE, F.lit(which)) for which in (VALID, TEST)]
    drawn = uniform_negatives(rows[0].unionByName(rows[1]), ids, n, seed)
    encoded = encode_runs(drawn, vectors, params, **encoder)
    asked = encoded.withColumn(CANDIDATES, F.concat(F.array(IID), NEGATIVES)).drop(NEGATIVES, SEQ, ITEM)
    ranks = rank_first(score_candidates(asked, ids, vectors))
    return ranking_metrics(ranks, top_k, by=(RUN, MARKET, PHASE), digits=digits)


def selected_run(
    inter: DataFrame, vectors: DataFrame, params: DataFrame, ties: Sequence[str] = (), metric: str = VALID_METRIC, bigger: bool = True, **how
) -> DataFrame:
    """Test metrics of each market's best run on its validation rows: (market, run, valid_value, metric, k, value).

    params: run, name, row, values. Ties go to the smaller run. A market without validation rows has no choice and no row.
    """
    # A line per run, market, phase, metric and k.
    found = pin(run_metrics(inter, vectors, params, ties, **how), "run-metrics")
    chosen = best_run(found.where(F.col(PHASE) == VALID).drop(PHASE), metric, bigger, [MARKET])
    chosen = chosen.withColumnRenamed("value", "valid_value")
    return found.where(F.col(PHASE) == TEST).drop(PHASE).join(chosen, [MARKET, RUN]).select(MARKET, RUN, "valid_value", "metric", "k", "value")
