"""From raw documents to training windows: five stages, each a table that the next one reads.

Documents go if the language model finds no language in them; runs of lines that repeat are deleted, and with them documents
that consist of nothing else; of each group of near-duplicates one stays; sources are mixed to target weights; what is left
is packed into windows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmseq.llm import inverted, language, lines, mixing, packing
from xmseq.llm.queries import WEIGHTS, with_domain
from xmseq.llm.store import unused
from xmseq.storage import numbered, pin

#: A calibrated probability below this means no language.
LEAST_SCORE = 0.5
TOKENIZER = "byte_bpe_50k.json"


def find_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a language of probability 0.5 or more; the model learns from the labels of `docs`."""
    names = docs.columns
    found = language.predict(docs, language.train(docs.select("doc_id", "text", "lang")))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of three lines or 50 words, n_chars brought in line; a document all of whose lines repeat goes."""
    names = docs.columns
    kept = lines.drop_repeated_lines(docs, words=lines.LONG).where("n_removed = 0 or n_removed < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*names)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingle sets of Jaccard 0.8 or more: the row with the smallest doc_id.

    Rows that share a doc_id, and rows without one, are documents of their own; of equal doc_ids the smaller text stays, and
    a row without doc_id only where the group has no other. Rows without a shingle (no words) stay.
    """
    names = docs.columns
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1)
    if repeated.isEmpty():
        ids = pin(inverted.near_groups(docs, k=5, percent=80).where("kept").select("doc_id"), "kept-documents")
        return docs.join(ids.hint("merge"), "doc_id", "left_semi").select(*names)
    row = unused(docs, "row")
    rows = numbered(docs, row)
    groups = inverted.near_groups(rows.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80)
    groups = groups.select(F.col("doc_id").alias(row), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), row)
    placed = rows.select(row, order.alias("_order")).join(groups, row)
    first = pin(placed.groupBy("_group").agg(F.min("_order").alias("_o")).select(f"_o.{row}"), "kept-documents")
    return rows.join(first.hint("merge"), row, "left_semi").select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a mixture of 80 % of the tokens by target weights, each read once at most."""
    names = docs.columns
    mixed = mixing.mix(with_domain(docs), F.expr("tokens * 8 div 10"), WEIGHTS, max_epochs=1, seed=1)
    return mixed.where("uses > 0").select(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, in windows of at most 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", find_language),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: No SQL for a trained classifier and near-duplicate components; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
