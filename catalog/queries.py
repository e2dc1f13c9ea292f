"""Each registered query: the library on the given tables, with columns of plain types."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import tables as t
from xmseq.functions.text import text_to_vec, vec_to_text
from xmseq.functions.vectors import dot
from xmseq.model import (
    EVENTS,
    IID,
    ITEM,
    ITEM_KEY,
    LENGTH,
    MARKET,
    PHASE,
    POS,
    SEQ,
    TEXT,
    TIME,
    USER,
    USER_KEY,
    VECTOR,
)
from xmseq.operators import causal, encoder, losses, metrics, params, prep, sampling, scoring, sequences, text_encoder, vectors
from xmseq.operators.blocks import full_sort_topk
from xmseq.operators.lookup import dense_items, lookup, lookup_vectors, side_by_side
from xmseq.plans.evaluate import last_item_encoder, sampled_evaluation, scored_targets
from xmseq.plans.prepare import prepare
from xmseq.plans.runs import RUN, selected_run
from xmseq.sinks.buckets import read_buckets, write_buckets
from xmseq.sinks.export import export_inter, export_items, export_vectors, write_master
from xmseq.sources import prepared, raw, typed
from xmseq.storage import dealt, pin, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = [*USER_KEY, PHASE]
DIM = 64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(x: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("bigint")


def text_of(seq: str) -> Column:
    return F.array_join(seq, " ")


def digits_of(vector: str) -> Column:
    """All places of a vector as whole millionths, in one text."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("bigint")), " ")


def parts_of(vector: str, *key: str) -> list[Column]:
    """A vector in long form."""
    return [*map(F.col, key), F.posexplode(vector).alias("place", "value")]


# ---- cleaning and joins


@query
def item_text(spark, sf):
    return prep.item_text(t.metadata(spark, sf))


@query
def dedup_first(spark, sf):
    meta = t.metadata(spark, sf).select(ITEM, "title")
    first = meta.withColumn("ord", long(ITEM))
    again = meta.select(ITEM, F.concat(F.lit("again "), "title").alias("title"), (F.col(ITEM) + 1_000_000).alias("ord"))
    return prep.dedup_first(again.unionByName(first), [ITEM], ["ord"])


@query
def items_semi_join(spark, sf):
    clicked = prep.all_items(t.clicks(spark, sf))
    return prep.keep_items(t.metadata(spark, sf), clicked).select(ITEM, "title")


@query
def epoch_seconds(spark, sf):
    orders = t.table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select("o_orderkey", prep.epoch_seconds(text).alias(TIME))


@query
def interactions(spark, sf):
    return t.purchases(spark, sf).select(MARKET, USER, ITEM, TIME)


@query
def coverage_report(spark, sf):
    """Purchased items against metadata that lacks some, repeats some, and lacks some titles and descriptions."""
    return prep.coverage_report(prep.all_items(t.purchases(spark, sf)), t.flawed_metadata(spark, sf))


@query
def missing_items(spark, sf):
    return prep.missing_items(t.purchases(spark, sf), t.described(spark, sf))


@query
def market_items(spark, sf):
    found = prep.market_items(t.item_vectors(spark, sf), t.purchases(spark, sf))
    return found.select(MARKET, ITEM, r6(dot(VECTOR, F.transform(VECTOR, lambda x, i: i + 1.0))).alias("checksum"))


@query
def market_item_sets(spark, sf):
    return prep.market_item_sets(t.purchases(spark, sf))


@query
def all_items(spark, sf):
    return prep.all_items(t.purchases(spark, sf))


@query
def market_stats(spark, sf):
    stats = prep.market_stats(t.stored_purchases(spark, sf))
    return stats.withColumn("avg_events", r6("avg_events"))


@query
def market_overlap(spark, sf):
    return prep.market_overlap(t.purchases(spark, sf)).withColumn("jaccard", r6("jaccard"))


@query
def user_overlap(spark, sf):
    return prep.market_overlap(t.purchases(spark, sf), USER).withColumn("jaccard", r6("jaccard"))


# ---- sequences


@query
def event_positions(spark, sf):
    ordered = sequences.order_events(t.purchases(spark, sf), t.TIES)
    return ordered.select(*USER_KEY, ITEM, TIME, *map(long, t.TIES), POS, EVENTS)


@query
def click_positions(spark, sf):
    ordered = sequences.order_events(t.clicks(spark, sf).drop("event_type"))
    return ordered.select(USER, ITEM, F.date_format(TIME, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), POS, EVENTS)


@query
def prefix_sequences(spark, sf):
    rows = sequences.build_sequences(t.purchases(spark, sf), t.TIES)
    return rows.select(*USER_KEY, POS, ITEM, text_of(SEQ).alias("seq"), long(LENGTH).alias(LENGTH))


@query
def click_sequences(spark, sf):
    rows = sequences.build_sequences(t.clicks(spark, sf), fields={ITEM: SEQ, "event_type": "event_type_list"})
    return rows.select(USER, POS, ITEM, text_of(SEQ).alias("seq"), text_of("event_type_list").alias("types"))


@query
def loo_split(spark, sf):
    rows = sequences.loo_split(sequences.order_events(t.purchases(spark, sf), t.TIES))
    return rows.select(*USER_KEY, POS, ITEM, PHASE)


@query
def target_rows(spark, sf):
    inter = t.stored_purchases(spark, sf)
    rows = [
        sequences.target_rows(inter, t.TIES, which).withColumn(PHASE, F.lit(which))
        for which in (sequences.VALID, sequences.TEST)
    ]
    return rows[0].unionByName(rows[1]).select(*KEY, ITEM, text_of(SEQ).alias("seq"))


@query
def latest_sequence(spark, sf):
    latest = sequences.latest_sequence(t.purchases(spark, sf), t.TIES)
    return latest.select(*USER_KEY, text_of(SEQ).alias("seq"), long(LENGTH).alias(LENGTH))


def bucketed_purchases(spark, sf):
    path = shared_path(spark, "master-by-user")
    write_buckets(t.purchases(spark, sf), path, t.TIES)
    return read_buckets(spark, path)


@query
def bucketed_loo_split(spark, sf):
    """The split of a master that lies by user: no shuffle."""
    rows = sequences.loo_split(sequences.order_events(bucketed_purchases(spark, sf), t.TIES))
    return rows.select(*USER_KEY, POS, ITEM, PHASE)


@query
def bucketed_latest_sequence(spark, sf):
    latest = sequences.latest_sequence(bucketed_purchases(spark, sf), t.TIES)
    return latest.select(*USER_KEY, text_of(SEQ).alias("seq"), long(LENGTH).alias(LENGTH))


@query
def item_ids(spark, sf):
    return sequences.item_ids(t.purchases(spark, sf))


# ---- frequency, weights, losses


@query
def item_freq(spark, sf):
    inter = t.stored_purchases(spark, sf)
    train = sequences.loo_split(sequences.order_events(inter, t.TIES)).where(F.col(PHASE) == sequences.TRAIN)
    return losses.item_freq(train, sequences.item_ids(inter), include_padding=True).drop(ITEM)


@query
def train_item_freq(spark, sf):
    inter = t.stored_purchases(spark, sf)
    return losses.train_item_freq(inter, sequences.item_ids(inter), t.TIES, include_padding=True).drop(ITEM)


@query
def item_weights(spark, sf):
    inter = t.stored_purchases(spark, sf)
    freq = losses.train_item_freq(inter, sequences.item_ids(inter), t.TIES)
    return losses.item_weights(freq).withColumn("weight", r6("weight"))


@query
def mapped_weights(spark, sf):
    """Every event with the dense id and weight of its item, from a dictionary that tasks map, as beyond the broadcast limit."""
    inter = t.stored_purchases(spark, sf)
    freq = losses.train_item_freq(inter, sequences.item_ids(inter), t.TIES)
    found = lookup(inter.select(*USER_KEY, ITEM), losses.item_weights(freq).select(*ITEM_KEY, IID, "weight"), ITEM_KEY, "left", False)
    return found.select(*USER_KEY, ITEM, IID, r6("weight").alias("weight"))


def target_nll(spark, sf, inter, include_padding=False):
    """nll of the test rows over the items of their market, the vector of the latest item standing for the sequence."""
    vectors_ = t.item_vectors(spark, sf)
    items = pin(prep.market_items(vectors_, inter), "market-items")
    rows = dealt(sequences.target_rows(inter, t.TIES), *USER_KEY).withColumn(PHASE, F.lit(sequences.TEST))
    encoded = last_item_encoder(vectors_)(rows).drop(SEQ, LENGTH)
    return losses.all_item_nll(encoded, items, KEY, include_padding=include_padding, vectors=vectors_)


@query
def ce_loss(spark, sf):
    return losses.ce_loss(target_nll(spark, sf, t.stored_purchases(spark, sf)), [MARKET]).withColumn("loss", r6("loss"))


@query
def ce_loss_padded(spark, sf):
    return losses.ce_loss(target_nll(spark, sf, t.stored_purchases(spark, sf), True), [MARKET]).withColumn("loss", r6("loss"))


@query
def wce_loss(spark, sf):
    inter = t.stored_purchases(spark, sf)
    weights = losses.item_weights(losses.train_item_freq(inter, sequences.item_ids(inter), t.TIES))
    rows = losses.with_weights(target_nll(spark, sf, inter), pin(weights, "weights"))
    return losses.wce_loss(rows, [MARKET]).withColumn("loss", r6("loss"))


def train_rows(spark, sf, inter):
    """Every training target with the item before it: the vector of that stands for the sequence."""
    rows = sequences.loo_split(sequences.build_sequences(inter, t.TIES, max_len=1))
    return rows.where(F.col(PHASE) == sequences.TRAIN).select(*USER_KEY, POS, ITEM, SEQ)


def train_nll(spark, sf, inter):
    """nll of the training rows over the items of their market."""
    vectors_ = t.item_vectors(spark, sf)
    items = pin(prep.market_items(vectors_, inter), "market-items")
    rows = train_rows(spark, sf, inter).withColumn("last", F.element_at(SEQ, -1))
    encoded = last_item_encoder(vectors_)(rows).drop(SEQ)
    return losses.all_item_nll(encoded, items, [*USER_KEY, POS], shared=True, vectors=vectors_, last="last")


@query
def train_ce_loss(spark, sf):
    return losses.ce_loss(train_nll(spark, sf, t.stored_purchases(spark, sf)), [MARKET]).withColumn("loss", r6("loss"))


@query
def train_wce_loss(spark, sf):
    inter = t.stored_purchases(spark, sf)
    weights = losses.item_weights(losses.train_item_freq(inter, sequences.item_ids(inter), t.TIES))
    rows = losses.with_weights(train_nll(spark, sf, inter), pin(weights, "weights"))
    return losses.wce_loss(rows, [MARKET]).withColumn("loss", r6("loss"))


@query
def train_bpr_loss(spark, sf):
    """One negative for each training row."""
    inter, vectors_ = t.stored_purchases(spark, sf), t.item_vectors(spark, sf)
    ids = sequences.item_ids(inter)
    drawn = sampling.uniform_negatives(train_rows(spark, sf, inter), ids, 1, key=(MARKET, USER, POS))
    encoded = last_item_encoder(vectors_)(drawn)
    pair = encoded.select(MARKET, scoring.SEQ_VECTOR, F.concat(F.array(IID), sampling.NEGATIVES).alias(scoring.CANDIDATES))
    found = scoring.score_candidates(pair, ids, vectors_).select(
        MARKET, F.get(scoring.SCORES, F.lit(0)).alias("pos_score"), F.get(scoring.SCORES, F.lit(1)).alias("neg_score")
    )
    return losses.bpr_loss(found, [MARKET]).withColumn("loss", r6("loss"))


def scored(spark, sf, n=99):
    vectors_ = t.item_vectors(spark, sf)
    return scored_targets(t.stored_purchases(spark, sf), vectors_, last_item_encoder(vectors_), t.TIES, n=n)


def scored_long(spark, sf):
    """One row per candidate."""
    pair = F.inline(F.arrays_zip(F.col(scoring.CANDIDATES).alias("candidate"), F.col(scoring.SCORES).alias("score")))
    return scored(spark, sf).select(
        *KEY, F.col(IID).alias("positive"), F.get(scoring.SCORES, F.lit(0)).alias("pos_score"), pair
    )


@query
def log_softmax(spark, sf):
    log_p = losses.array_log_softmax(F.col(scoring.SCORES)).alias("log_p")
    rows = scored(spark, sf).select(*USER_KEY, F.inline(F.arrays_zip(F.col(scoring.CANDIDATES).alias("candidate"), log_p)))
    return rows.select(*USER_KEY, "candidate", r6("log_p").alias("log_p"))


@query
def grouped_log_softmax(spark, sf):
    """All candidates of a market's test rows as one group, far too large for a row."""
    rows = scored_long(spark, sf).select(*USER_KEY, "candidate", "score")
    found = losses.log_softmax(rows, [MARKET])
    return found.select(*USER_KEY, "candidate", r6("log_p").alias("log_p"))


@query
def bpr_loss(spark, sf):
    pair = scored(spark, sf, n=1).select(
        MARKET, F.get(scoring.SCORES, F.lit(0)).alias("pos_score"), F.get(scoring.SCORES, F.lit(1)).alias("neg_score")
    )
    return losses.bpr_loss(pair, [MARKET]).withColumn("loss", r6("loss"))


# ---- candidates, scores, metrics


@query
def uniform_negatives(spark, sf):
    inter = t.stored_purchases(spark, sf)
    rows = sequences.target_rows(inter, t.TIES).withColumn(PHASE, F.lit(sequences.TEST))
    drawn = sampling.uniform_negatives(rows, sequences.item_ids(inter))
    return sampling.long_candidates(drawn).select(*USER_KEY, "positive", "candidate")


@query
def unseen_negatives(spark, sf):
    inter = t.stored_purchases(spark, sf)
    ids = sequences.item_ids(inter)
    rows = sequences.target_rows(inter, t.TIES).withColumn(PHASE, F.lit(sequences.TEST))
    seen = inter.select(*USER_KEY, ITEM).join(ids, ITEM_KEY)
    kept = sampling.exclude_history(sampling.uniform_negatives(rows, ids), seen)
    return sampling.long_candidates(kept).select(*USER_KEY, "positive", "candidate")


@query
def pair_scores(spark, sf):
    """Every event's item scored by the item before it."""
    rows, vectors_ = sequences.build_sequences(t.stored_purchases(spark, sf), t.TIES, max_len=1), t.item_vectors(spark, sf)
    scored_pairs = scoring.score_pairs(last_item_encoder(vectors_)(rows), vectors_, digits=None)
    return scored_pairs.select(*USER_KEY, POS, ITEM, r6("score").alias("score"))


@query
def vector_lookup(spark, sf):
    rows = t.purchases(spark, sf).select(*USER_KEY, ITEM)
    found = lookup_vectors(side_by_side(rows, ITEM), t.item_vectors(spark, sf))
    return found.select(*USER_KEY, ITEM, digits_of(VECTOR).alias("v"))


@query
def dense_item_features(spark, sf):
    """Features of all ids, padding included; only items with a description have a vector here."""
    inter = t.stored_purchases(spark, sf)
    some = prep.keep_items(t.item_vectors(spark, sf), t.described(spark, sf))
    found = dense_items(sequences.item_ids(inter), some, include_padding=True)
    return found.select(MARKET, IID, digits_of(VECTOR).alias("v"))


@query
def rank_positive(spark, sf):
    ranks = metrics.rank_positive(scored_long(spark, sf), [*KEY, "positive"])
    return ranks.select(*USER_KEY, "positive", "rank")


@query
def ranking_metrics(spark, sf):
    return sampled_evaluation(t.stored_purchases(spark, sf), t.item_vectors(spark, sf), ties=t.TIES)


@query
def validation_metrics(spark, sf):
    return sampled_evaluation(t.stored_purchases(spark, sf), t.item_vectors(spark, sf), ties=t.TIES, which=sequences.VALID)


@query
def metric_report(spark, sf):
    """The metric line of each market."""
    values = ranking_metrics(spark, sf)
    whole = values.withColumn("value", F.format_string("%.4f", "value"))
    return metrics.report_line(whole).select(MARKET, PHASE, "line")


@query
def best_run(spark, sf):
    """The market with the best MRR@10 on the validation rows, each market taken as a run."""
    runs = validation_metrics(spark, sf).withColumnRenamed(MARKET, "run")
    return metrics.best_run(runs)


@query
def full_sort_top_items(spark, sf):
    found = t.raw_vectors(spark, sf).select(F.col("vec_id").alias(ITEM), VECTOR)
    rows = found.select(F.col(ITEM).alias("vec_id"), F.col(VECTOR).alias(scoring.SEQ_VECTOR))
    top = full_sort_topk(rows, found, 10, ["vec_id"])
    return top.select("vec_id", ITEM, "score", long("rank").alias("rank"))


@query
def market_top_items(spark, sf):
    """Serving: the ten best items of the market for each user's latest sequence."""
    inter, vectors_ = t.stored_purchases(spark, sf), t.item_vectors(spark, sf)
    rows = last_item_encoder(vectors_)(dealt(sequences.latest_sequence(inter, t.TIES), *USER_KEY))
    items = pin(prep.market_items(vectors_, inter), "market-items")
    top = full_sort_topk(rows, items, 10, USER_KEY)
    return top.select(*USER_KEY, ITEM, "score", long("rank").alias("rank"))


@query
def mapped_top_items(spark, sf):
    """The same from blocks of similar items in the shared folder, as beyond the broadcast limit."""
    inter, vectors_ = t.stored_purchases(spark, sf), t.item_vectors(spark, sf)
    rows = last_item_encoder(vectors_)(dealt(sequences.latest_sequence(inter, t.TIES), *USER_KEY))
    items = pin(prep.market_items(vectors_, inter), "market-items")
    top = full_sort_topk(rows, items, 10, USER_KEY, limit_bytes=0)
    return top.select(*USER_KEY, ITEM, "score", long("rank").alias("rank"))


# ---- vectors, attention, encoder, parameters


@query
def text_vectors(spark, sf):
    """Hashed vectors of whole documents."""
    found = vectors.text_weights(t.table(spark, sf, "documents"), DIM, "doc_id", "text")
    return found.select("doc_id", long("bucket").alias("bucket"), r6("weight").alias("weight"))


@query
def item_text_vectors(spark, sf):
    texts = prep.item_text(t.metadata(spark, sf))
    found = vectors.text_vectors(texts, DIM)
    return found.select(ITEM, digits_of(VECTOR).alias("v"))


@query
def encoded_texts(spark, sf):
    """Texts of parts by a subword encoder of two layers, its weights taken from the given vectors."""
    model = t.model_params(spark, sf, t.text_model_spec())
    found = text_encoder.encode_texts(t.part_texts(spark, sf), t.text_vocabulary(spark, sf), model, heads=4, max_tokens=16)
    return found.select(ITEM, digits_of(VECTOR).alias("v"))


@query
def attention_weights(spark, sf):
    seqs = sequences.latest_sequence(t.purchases(spark, sf), t.TIES)
    found = vectors.attention_weights(seqs, t.item_vectors(spark, sf))
    return found.select(*USER_KEY, long("place").alias("place"), ITEM, r6("weight").alias("weight"))


@query
def attention_top_item(spark, sf):
    """The past item weighing most for each user."""
    seqs = sequences.latest_sequence(t.purchases(spark, sf), t.TIES)
    found = vectors.attention_weights(seqs, t.item_vectors(spark, sf))
    # Equal weights go to the later place.
    top = F.max_by(F.struct(ITEM, "place"), F.struct(r6("weight"), "place")).alias("top")
    best = found.groupBy(*USER_KEY).agg(top, r6(F.max("weight")).alias("top_weight"))
    return best.select(*USER_KEY, F.col(f"top.{ITEM}").alias(ITEM), long("top.place").alias("place"), "top_weight")


@query
def attention_pool(spark, sf):
    seqs = sequences.latest_sequence(t.purchases(spark, sf), t.TIES)
    pooled = vectors.attention_pool(seqs, t.item_vectors(spark, sf))
    return pooled.select(*parts_of("pooled", *USER_KEY)).select(
        *USER_KEY, long("place").alias("place"), r6("value").alias("value")
    )


@query
def encode_sequences(spark, sf):
    """The attention encoder with adapters, on each user's latest sequence."""
    rows = sequences.latest_sequence(t.purchases(spark, sf), t.TIES)
    model = t.model_params(spark, sf)
    encoded = encoder.encode_sequences(rows, t.item_vectors(spark, sf), model, key=USER_KEY)
    return encoded.select(*parts_of(scoring.SEQ_VECTOR, *USER_KEY)).select(
        *USER_KEY, long("place").alias("place"), r6("value").alias("value")
    )


@query
def encoder_metrics(spark, sf):
    """Sampled evaluation with the attention encoder, its query and key matrices taken over from another model."""
    vectors_ = t.item_vectors(spark, sf)
    given = params.select_weights(whole_layers(spark, sf))
    model = pin(params.transfer(t.model_params(spark, sf), given), "transferred")

    def encode(rows):
        return encoder.encode_sequences(rows, vectors_, model)

    return sampled_evaluation(t.stored_purchases(spark, sf), vectors_, encode, t.TIES)


@query
def selected_run_metrics(spark, sf):
    """Three sets of parameters, the model's own, query and key taken over, and value as well: test metrics of each market's best."""
    own, given = t.model_params(spark, sf), whole_layers(spark, sf)
    sets = {"own": own}
    for name, weights in (("query-key", ("query", "key")), ("query-key-value", ("query", "key", "value"))):
        sets[name] = params.transfer(own, params.select_weights(given, weights))
    table = reduce(DataFrame.unionByName, [p.withColumn(RUN, F.lit(name)) for name, p in sets.items()])
    return selected_run(t.stored_purchases(spark, sf), t.item_vectors(spark, sf), pin(table, "runs"), t.TIES)


def encoded_targets(spark, sf, inter, vectors_):
    """The test rows with the encoder's output."""
    rows = dealt(sequences.target_rows(inter, t.TIES), *USER_KEY).withColumn(PHASE, F.lit(sequences.TEST))
    return encoder.encode_sequences(rows, vectors_, t.model_params(spark, sf)).drop(SEQ, LENGTH)


@query
def encoder_ce_loss(spark, sf):
    """Mean nll of the test rows over the items of their market, scored by the encoder's output."""
    inter, vectors_ = t.stored_purchases(spark, sf), t.item_vectors(spark, sf)
    items = pin(prep.market_items(vectors_, inter), "market-items")
    rows = losses.all_item_nll(encoded_targets(spark, sf, inter, vectors_), items, KEY, vectors=vectors_)
    return losses.ce_loss(rows, [MARKET]).withColumn("loss", r6("loss"))


def encoded_train_rows(spark, sf, inter, vectors_):
    """Every training target with the encoder's output on the 50 events before it."""
    rows = causal.encode_targets(inter, vectors_, t.model_params(spark, sf), t.TIES)
    return rows.where(sequences.phase() == sequences.TRAIN).drop(EVENTS)


def encoder_train_nll(spark, sf, inter, vectors_):
    items = pin(prep.market_items(vectors_, inter), "market-items")
    return losses.all_item_nll(encoded_train_rows(spark, sf, inter, vectors_), items, [*USER_KEY, POS], vectors=vectors_)


@query
def encoder_train_ce_loss(spark, sf):
    """Mean nll of all training rows over the items of their market, scored by the encoder's output."""
    nll = encoder_train_nll(spark, sf, t.stored_purchases(spark, sf), t.item_vectors(spark, sf))
    return losses.ce_loss(nll, [MARKET]).withColumn("loss", r6("loss"))


@query
def encoder_train_wce_loss(spark, sf):
    """The same weighted by the training frequency of the target."""
    inter = t.stored_purchases(spark, sf)
    weights = losses.item_weights(losses.train_item_freq(inter, sequences.item_ids(inter), t.TIES))
    rows = losses.with_weights(encoder_train_nll(spark, sf, inter, t.item_vectors(spark, sf)), pin(weights, "weights"))
    return losses.wce_loss(rows, [MARKET]).withColumn("loss", r6("loss"))


@query
def encoder_train_bpr_loss(spark, sf):
    """Pairwise loss of all training rows, one negative each, scored by the encoder's output."""
    inter, vectors_ = t.stored_purchases(spark, sf), t.item_vectors(spark, sf)
    ids = sequences.item_ids(inter)
    drawn = sampling.uniform_negatives(encoded_train_rows(spark, sf, inter, vectors_), ids, 1, key=(MARKET, USER, POS))
    pair = drawn.select(MARKET, scoring.SEQ_VECTOR, F.concat(F.array(IID), sampling.NEGATIVES).alias(scoring.CANDIDATES))
    found = scoring.score_candidates(pair, ids, vectors_).select(
        MARKET, F.get(scoring.SCORES, F.lit(0)).alias("pos_score"), F.get(scoring.SCORES, F.lit(1)).alias("neg_score")
    )
    return losses.bpr_loss(found, [MARKET]).withColumn("loss", r6("loss"))


@query
def encoder_top_items(spark, sf):
    """The ten best items of the market for each user's test sequence, by the encoder's output."""
    inter, vectors_ = t.stored_purchases(spark, sf), t.item_vectors(spark, sf)
    items = pin(prep.market_items(vectors_, inter), "market-items")
    top = full_sort_topk(encoded_targets(spark, sf, inter, vectors_), items, 10, USER_KEY, digits=6)
    return top.select(*USER_KEY, ITEM, "score", long("rank").alias("rank"))


def whole_layers(spark, sf):
    """Parameters of the layers that the given vectors fill completely: 192 rows each."""
    given = t.layered_params(spark, sf).withColumn("layer", F.regexp_extract("name", r"layer\.(\d+)", 1))
    whole = given.groupBy("layer").agg(F.count("*").alias("n")).where("n = 192").select("layer")
    return given.join(whole, "layer", "left_semi").drop("layer")


@query
def select_weights(spark, sf):
    # As in the SQL, the highest layer counts with what it holds: the given vectors need not fill it.
    chosen = params.select_weights(t.layered_params(spark, sf), strict=False)
    return chosen.select("weight", long("row").alias("row"), digits_of("values").alias("v"))


@query
def transfer_weights(spark, sf):
    """Query, key and value matrices of the highest whole layer in place of the model's own."""
    given = params.select_weights(whole_layers(spark, sf), ("query", "key", "value"))
    model = params.transfer(t.model_params(spark, sf), given)
    return model.select("name", long("row").alias("row"), digits_of("values").alias("v"))


# ---- files


@query
def vector_text(spark, sf):
    """Vectors written as text and read again."""
    again = t.raw_vectors(spark, sf).select("vec_id", text_to_vec(vec_to_text(VECTOR)).alias("v"))
    return again.select(*parts_of("v", "vec_id")).select(
        "vec_id", long("place").alias("place"), r6(F.col("value").cast("double")).alias("value")
    )


@query
def vector_file(spark, sf):
    path = export_vectors(t.item_vectors(spark, sf), shared_path(spark, "item-emb"))
    found = prepared.read_vectors(spark, path)
    return found.select(long(ITEM).alias(ITEM), digits_of(VECTOR).alias("v"))


def all_markets(spark, df, export, pick):
    """Export every market, read it back, unite."""
    folder = shared_path(spark, "prepared")
    rows = pin(df, "by-market", MARKET)
    markets = [r[0] for r in rows.select(MARKET).distinct().collect()]  # the five regions
    for market in markets:
        export(rows, folder, market)
    return reduce(DataFrame.unionByName, [pick(spark, folder, market) for market in markets])


@query
def prepared_interactions(spark, sf):
    found = all_markets(spark, t.purchases(spark, sf), export_inter, prepared.read_inter)
    return found.select(MARKET, long(USER).alias(USER), long(ITEM).alias(ITEM), TIME)


@query
def prepared_items(spark, sf):
    items = prep.market_items(t.item_vectors(spark, sf), t.purchases(spark, sf))
    found = all_markets(spark, items, export_items, prepared.read_items)
    return found.select(MARKET, long(ITEM).alias(ITEM), digits_of(VECTOR).alias("v"))


@query
def typed_source(spark, sf):
    """Items of all markets with their vectors, written and read by the data source of typed tables."""
    typed.register(spark)
    path = shared_path(spark, "typed")
    items = prep.market_items(t.item_vectors(spark, sf), t.purchases(spark, sf))
    items.select(MARKET, F.col(ITEM).cast("string").alias(ITEM), VECTOR).write.format("typed_table").mode("append").save(path)
    found = spark.read.format("typed_table").load(path)
    return found.select(MARKET, long(ITEM).alias(ITEM), digits_of(VECTOR).alias("v"))


@query
def master_table(spark, sf):
    """The rows of the partitioned master."""
    path = shared_path(spark, "master")
    write_master(t.purchases(spark, sf), path)
    found = spark.read.parquet(path)
    return found.select(F.col(MARKET).cast("string").alias(MARKET), USER, ITEM, TIME, *map(long, t.TIES))


def raw_market_files(spark, sf):
    """Folder and markets of the interactions as raw market files."""
    folder = shared_path(spark, "raw")
    inter = pin(t.purchases(spark, sf), "inter", MARKET)
    markets = [r[0] for r in t.table(spark, sf, "region").select("r_name").collect()]  # five rows
    date = F.date_add(F.lit("1970-01-01").cast("date"), (F.col(TIME) / 86400).cast("int")).cast("string")
    columns = [F.col(USER).alias("userId"), F.col(ITEM).alias("itemId"), F.lit(5).alias("ratings"), date.alias("date")]
    for market, path in zip(markets, raw.market_files(folder, markets)):
        inter.where(F.col(MARKET) == market).select(*columns).write.csv(path, sep=" ", header=True)
    return folder, markets


def raw_metadata_file(spark, sf):
    """Path of the metadata as JSON lines."""
    path = shared_path(spark, "metadata")
    meta = t.metadata(spark, sf).withColumnRenamed(ITEM, "asin").withColumn("asin", F.col("asin").cast("string"))
    meta.write.json(path, compression="gzip")
    return path


@query
def market_files(spark, sf):
    """Interactions written as raw market files and read with their market taken from the file name."""
    folder, markets = raw_market_files(spark, sf)
    found = prep.to_interactions(raw.read_markets(spark, folder, markets))
    return found.select(MARKET, long(USER).alias(USER), long(ITEM).alias(ITEM), TIME)


@query
def metadata_file(spark, sf):
    """Metadata written as JSON lines, read, restricted to purchased items, one row per item, as texts."""
    path = raw_metadata_file(spark, sf)
    items = prep.all_items(t.purchases(spark, sf)).select(F.col(ITEM).cast("string").alias(ITEM))
    chosen = prep.dedup_first(prep.keep_items(raw.read_metadata(spark, path), items), [ITEM], raw.FILE_ORDER)
    return prep.item_text(chosen).select(long(ITEM).alias(ITEM), TEXT)


@query
def prepared_tables(spark, sf):
    """From raw files to prepared tables, read back: every event of every market with the vector of its item."""
    (folder, markets), out = raw_market_files(spark, sf), shared_path(spark, "prepared")
    prepare(spark, folder, raw_metadata_file(spark, sf), out, markets, DIM)

    def both(market):
        inter, items = prepared.read_prepared(spark, out, market)
        return inter.join(items.drop(MARKET), ITEM, "left")

    found = reduce(DataFrame.unionByName, map(both, markets))
    return found.select(MARKET, long(USER).alias(USER), long(ITEM).alias(ITEM), TIME, digits_of(VECTOR).alias("v"))


@query
def ratings_file(spark, sf):
    """Ratings written without a header and read again."""
    path = shared_path(spark, "ratings")
    lineitem = spark.read.schema("l_orderkey bigint, l_partkey bigint, l_quantity double, l_shipdate timestamp_ntz").parquet(
        f"{sf}/lineitem.parquet"
    )
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")
    lineitem.select("l_orderkey", "l_partkey", "l_quantity", day).write.csv(path, sep=" ", compression="gzip")
    found = raw.read_ratings(spark, path)
    return found.select("reviewerID", "asin", "ratings", "date")


@query
def params_file(spark, sf):
    path = shared_path(spark, "params")
    t.layered_params(spark, sf).write.parquet(path)
    found = prepared.read_params(spark, path)
    return found.select("name", long("row").alias("row"), digits_of("values").alias("v"))
