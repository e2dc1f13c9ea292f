"""The given tables seen as market interactions, item metadata and item vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xmseq.functions.dates import days_to_seconds
from xmseq.model import DESCRIPTION, ITEM, MARKET, TEXT, TIME, TITLE, USER, VECTOR
from xmseq.storage import pin

TIES = ["l_orderkey", "l_linenumber"]

# The columns used, as they lie in the files: no footer is read just to learn them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "events": "ts timestamp_ntz, user_id bigint, event_type string, props string",
    "embeddings": "vec_id bigint, embedding array<float>",
    "documents": "doc_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: market = region of the customer, user = customer, item = part."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias(MARKET))
    nation, customer, orders, lineitem = (
        table(spark, sf_dir, name) for name in ("nation", "customer", "orders", "lineitem")
    )
    # Customers join the orders first: the line items are then shuffled by order, not by a customer who may hold many.
    bought = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select("o_orderkey", "o_custkey", "o_orderdate", MARKET)
    )
    return lineitem.join(bought, lineitem.l_orderkey == bought.o_orderkey).select(
        MARKET,
        F.col("o_custkey").alias(USER),
        F.col("l_partkey").alias(ITEM),
        days_to_seconds("o_orderdate").alias(TIME),
        *TIES,
    )


def stored_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stored table, for work that reads it more than once.

    Spread by order, so that files come out even however the inputs are cut, also when one user holds many orders.
    """
    return pin(purchases(spark, sf_dir).repartition("l_orderkey"), "purchases")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source without ties in time: one market, item = props.k."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("event_type"),
        F.lit("web").alias(MARKET),
        F.col("user_id").alias(USER),
        F.get_json_object("props", "$.k").cast("bigint").alias(ITEM),
        F.col("ts").alias(TIME),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as item metadata; every third size has no description."""
    texts = F.array("p_type", "p_brand")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(ITEM),
        F.col("p_name").alias(TITLE),
        F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(texts).alias(DESCRIPTION),
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with a description."""
    return metadata(spark, sf_dir).where(F.size(DESCRIPTION) > 0)


def flawed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata without parts 7 of 50, with parts 3 of 50 twice, without titles for 11 and descriptions for 13 of 50."""
    part = F.col(ITEM) % 50
    meta = metadata(spark, sf_dir).where(part != 7)
    twice = meta.withColumn("_n", F.explode(F.when(part == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return twice.drop("_n").withColumns(
        {TITLE: F.when(part != 11, F.col(TITLE)), DESCRIPTION: F.when(part != 13, F.col(DESCRIPTION))}
    )


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias(VECTOR))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with a vector for every part: parts share the given vectors by part number modulo their count."""
    vectors = raw_vectors(spark, sf_dir)
    n = vectors.count()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(ITEM))
    return pin(parts.join(vectors, F.col(ITEM) % n == F.col("vec_id")).select(ITEM, VECTOR), "item-vectors")


# Names, first vector, rows, and vectors joined per row of a model made of the given vectors; norm weights are 1 + vector.
MODEL = """
position_embedding.weight 0 50 1
LayerNorm.weight 50 1 1
LayerNorm.bias 51 1 1
trm_encoder.layer.multi_head_attention.query.weight 60 64 1
trm_encoder.layer.multi_head_attention.query.bias 52 1 1
trm_encoder.layer.multi_head_attention.key.weight 124 64 1
trm_encoder.layer.multi_head_attention.key.bias 53 1 1
trm_encoder.layer.multi_head_attention.value.weight 188 64 1
trm_encoder.layer.multi_head_attention.value.bias 54 1 1
trm_encoder.layer.multi_head_attention.mlp_query.mlp_layers.1.weight 316 64 1
trm_encoder.layer.multi_head_attention.mlp_query.mlp_layers.1.bias 56 1 1
trm_encoder.layer.multi_head_attention.mlp_key.mlp_layers.1.weight 380 64 1
trm_encoder.layer.multi_head_attention.mlp_key.mlp_layers.1.bias 57 1 1
trm_encoder.layer.multi_head_attention.dense.weight 252 64 1
trm_encoder.layer.multi_head_attention.dense.bias 55 1 1
trm_encoder.layer.multi_head_attention.LayerNorm.weight 58 1 1
trm_encoder.layer.multi_head_attention.LayerNorm.bias 59 1 1
trm_encoder.layer.feed_forward.dense_1.weight 244 256 1
trm_encoder.layer.feed_forward.dense_1.bias 0 1 4
trm_encoder.layer.feed_forward.dense_2.weight 100 64 4
trm_encoder.layer.feed_forward.dense_2.bias 63 1 1
trm_encoder.layer.feed_forward.LayerNorm.weight 61 1 1
trm_encoder.layer.feed_forward.LayerNorm.bias 62 1 1
"""


# The same for a text encoder of two layers; those of layer n start 64 * n vectors later.
TEXT_MODEL = """
embeddings.word_embeddings.weight 11 400 1
embeddings.position_embeddings.weight 200 16 1
embeddings.token_type_embeddings.weight 40 2 1
embeddings.LayerNorm.weight 3 1 1
embeddings.LayerNorm.bias 4 1 1
"""
TEXT_LAYER = """
attention.self.query.weight 20 64 1
attention.self.query.bias 5 1 1
attention.self.key.weight 90 64 1
attention.self.key.bias 6 1 1
attention.self.value.weight 160 64 1
attention.self.value.bias 7 1 1
attention.output.dense.weight 230 64 1
attention.output.dense.bias 8 1 1
attention.output.LayerNorm.weight 9 1 1
attention.output.LayerNorm.bias 10 1 1
intermediate.dense.weight 300 128 1
intermediate.dense.bias 12 1 2
output.dense.weight 370 64 2
output.dense.bias 14 1 1
output.LayerNorm.weight 15 1 1
output.LayerNorm.bias 16 1 1
"""
Spec = list[tuple[str, int, int, int]]


def model_spec(model: str = MODEL) -> Spec:
    lines = (line.split() for line in model.split("\n") if line)
    return [(name, int(first), int(rows), int(joined)) for name, first, rows, joined in lines]


def text_model_spec() -> Spec:
    layers = [(f"encoder.layer.{n}.{name}", first + 64 * n, *rest) for n in range(2) for name, first, *rest in model_spec(TEXT_LAYER)]
    return model_spec(TEXT_MODEL) + layers


def model_params(spark: SparkSession, sf_dir: str, lines: Spec | None = None) -> DataFrame:
    """A full set of encoder parameters taken from the given vectors."""
    vectors = raw_vectors(spark, sf_dir)
    n = vectors.count()
    spec = spark.createDataFrame(lines or model_spec(), "name string, first int, rows int, joined int")
    cells = spec.select("name", "first", "joined", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("joined") - 1)).alias("part"))
    wanted = (F.col("first") + F.col("row") * F.col("joined") + F.col("part")) % n
    parts = F.array_sort(F.collect_list(F.struct("part", VECTOR)))
    rows = (
        cells.join(vectors, wanted == F.col("vec_id"))
        .groupBy("name", "row")
        .agg(F.flatten(F.transform(parts, lambda p: p[VECTOR])).alias("values"))
    )
    scale = F.col("name").endswith("LayerNorm.weight")
    shifted = F.transform("values", lambda x: F.when(scale, x.cast("double") + 1.0).otherwise(x.cast("double")))
    return pin(rows.select("name", "row", shifted.alias("values")), "model")


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias(ITEM), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias(TEXT))


def text_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the words of parts: their first letter and first three, and one and two letters from the second on; none with a z."""
    words = part_texts(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower(TEXT), F.lit("([a-z0-9]+|[^a-z0-9 ])"))).alias("w"))
    words = words.distinct().select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"))
    parts = [F.substr("w", "i", F.lit(n)) for n in (1, 2)]
    heads = [F.substr("w", F.lit(1), F.lit(n)) for n in (1, 3)]
    pieces = words.select(F.explode(F.array(*heads, *(F.when(F.col("i") > 1, F.concat(F.lit("##"), x)) for x in parts))).alias("piece"))
    pieces = pieces.where("piece is not null and piece not like '%z%'").distinct()
    # A few hundred rows.
    ranked = pieces.select("piece", (F.row_number().over(Window.orderBy("piece")) + 3).alias("id"))
    first = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ("[PAD]", "[UNK]", "[CLS]", "[SEP]")))).alias("id", "piece"))
    return pin(first.select("piece", "id").unionByName(ranked), "vocabulary")


def layered_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as query, key and value matrices of numbered layers, 64 rows each, three to a layer."""
    block = F.floor(F.col("vec_id") / 64)
    kind = F.element_at(F.array(F.lit("query"), F.lit("key"), F.lit("value")), (block % 3 + 1).cast("int"))
    layer = F.floor(block / 3).cast("string")
    return raw_vectors(spark, sf_dir).select(
        F.concat(F.lit("trm_encoder.layer."), layer, F.lit(".multi_head_attention."), kind, F.lit(".weight")).alias("name"),
        (F.col("vec_id") % 64).cast("int").alias("row"),
        F.col(VECTOR).alias("values"),
    )
