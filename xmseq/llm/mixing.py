"""Mixing of sources to target weights, by budgets handed down a tree of domain, language and source.

A node's budget is shared among its children by weight. A child that has too few tokens, even when repeated as often as
allowed, keeps what it has, and the shortage goes to its siblings by weight; a node passes a shortage up only when all below
it is used. Each leaf then reads its documents in epochs, every one in a seeded order of its own: whole epochs as far as
the budget goes, and a prefix of the next. Numbers are exact integers. Only DataFrame functions are used; documents meet a
plan of one row per leaf and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xmseq.llm.store import unused
from xmseq.storage import pin

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order that cut a leaf into parts, and the part in which its budget ends into parts of its own: 256 sums
#: per leaf each time, and rows of one 65,536th of it at last.
DIGITS = (2, 4)


def token_count(text: str = "text") -> Column:
    """Words of the text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    """Place of a document in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def weight_of(weights: Mapping[str, int], name: str) -> Column:
    """Weight of the node in column `name`: as given, else 1."""
    out = F.lit(1)
    for node, w in weights.items():
        out = F.when(F.col(name) == node, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """nodes: budget (of the parent), capacity, weight. Gives each node its own budget, filling siblings up by weight."""
    wide = "decimal(19,0)"
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(name).asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = F.col("capacity").cast(wide) * F.sum("weight").over(after).cast(wide) <= left.cast(wide) * F.col("weight").cast(wide)
    marked = nodes.withColumn("full", full)
    siblings = Window.partitionBy(*parent)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0))
    weights = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings), F.lit(1))
    marked = marked.withColumn("rest", rest).withColumn("weights", weights)
    part = F.expr(f"cast(floor(cast(rest as {wide}) * cast(weight as {wide}) / weights) as bigint)")
    return marked.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", part))).drop("full", "rest", "weights", "weight")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """Budget of each leaf. leaves: the levels and tokens; budget: an expression over `tokens`, the sum of all."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    whole = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    root = whole.select(F.least("capacity", budget.cast("bigint"))).first()[0] or 0
    plan = leaves
    for i, level in enumerate(LEVELS):
        names = list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", weight_of(weights.get(level, {}), level))
        if i:
            above = plan.select(*[F.col(c).alias(f"_{c}") for c in names[:-1]], "budget")
            match = F.lit(True)
            for c in names[:-1]:
                match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
            nodes = nodes.join(above, match).drop(*[f"_{c}" for c in names[:-1]])
        else:
            nodes = nodes.withColumn("budget", F.lit(root).cast("bigint"))
        plan = share(nodes, names[:-1], level).select(*names, "capacity", "budget")
    return plan


def leaf_plan(
    docs: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int, seed: int
) -> DataFrame:
    """Per leaf: tokens, budget, whole epochs, and the (key, doc_id) up to which documents join the epoch after them.

    docs: doc_id, the levels, n_tokens.
    """
    docs = pin(docs.select("doc_id", *LEVELS, "n_tokens"), "mixing-tokens")
    leaves = pin(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mixing-leaves")
    budgets = leaf_budgets(leaves, budget, weights, max_epochs)
    joined = leaves.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "tokens")
    plan = budgets.join(joined, same_leaf()).select(*LEVELS, "tokens", "budget", F.expr("if(tokens = 0, 0, budget div tokens)").alias("epochs"))
    plan = pin(plan, "mixing-plan")
    rows = with_plan(docs, plan).where("epochs * tokens < budget").withColumn("key", order_key(seed, F.col("epochs")))
    rows = rows.withColumn("room", F.expr("budget - epochs * tokens")).withColumn("before", F.lit(0).cast("bigint"))
    # A leaf of any size: sums of its parts first, then the rows of the one part in which the room ends.
    largest = F.max(F.struct("key", "doc_id")).alias("last")
    found = []
    for digits in DIGITS:
        rows = rows.withColumn("part", F.substring("key", 1, digits))
        parts = rows.groupBy(*LEVELS, "part", "room", "before").agg(F.sum("n_tokens").alias("n"), largest)
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part"))
        parts = parts.withColumn("upto", upto)
        found.append(parts.where("upto <= room").groupBy(*LEVELS).agg(F.max("last").alias("last")))
        edge = parts.where("upto > room and upto - n <= room")
        edge = edge.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("part").alias("_part"), F.expr("upto - n").alias("_before"))
        rows = rows.join(edge, same_leaf() & (F.col("part") == F.col("_part")))
        rows = rows.withColumn("before", F.col("_before")).drop(*edge.columns)
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "doc_id"))
    found.append(rows.withColumn("upto", upto).where("upto <= room").groupBy(*LEVELS).agg(largest))
    last = reduce(DataFrame.unionByName, found)
    last = last.groupBy(*LEVELS).agg(F.max("last").alias("last"))
    last = last.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "last")
    return pin(plan.join(last, same_leaf(), "left").select(*LEVELS, "tokens", "budget", "epochs", "last"), "mixing-plan")


def same_leaf() -> Column:
    """The levels equal those of the other side, named with an underscore; a null equals a null."""
    out = F.lit(True)
    for c in LEVELS:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """`docs` with the plan of their leaf. Spark broadcasts the plan, one row per leaf, if that is small, else shuffles."""
    names = {c: unused(docs, f"plan_{c}") for c in LEVELS}
    plan = plan.withColumnsRenamed(names)
    match = F.lit(True)
    for c, other in names.items():
        match = match & docs[c].eqNullSafe(plan[other])
    return docs.join(plan, match).drop(*names.values())


def mix(
    docs: DataFrame,
    budget: Column,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    text: str = "text",
) -> DataFrame:
    """All columns of `docs` with n_tokens and uses: how often the mixture reads each row, 0 if it does not.

    docs: doc_id, domain, lang, source and `text`. weights: by level, positive whole weights of nodes, 1 if not named. budget:
    tokens wanted, an expression that may name `tokens`, all there are. A row without tokens is read as often as others of
    its place in the order. A null level is a node of its own. Documents stay whole: a prefix ends before the first one
    that goes beyond the budget; rows that share a doc_id are taken or left together. Columns named n_tokens or uses are
    replaced.
    """
    docs = docs.drop("n_tokens", "uses").withColumn("n_tokens", token_count(text))
    plan = leaf_plan(docs, budget, weights or {}, max_epochs, seed)
    tokens, room, epochs, last = (unused(docs, c) for c in ("plan_tokens", "plan_budget", "plan_epochs", "plan_last"))
    rows = with_plan(docs, plan.withColumnsRenamed({"tokens": tokens, "budget": room, "epochs": epochs, "last": last}))
    place = F.struct(order_key(seed, F.col(epochs)).alias("key"), F.col("doc_id").alias("doc_id"))
    more = F.coalesce((place <= F.col(last)) & (F.col(epochs) * F.col(tokens) < F.col(room)), F.lit(False))
    return rows.withColumn("uses", F.col(epochs) + more.cast("bigint")).drop(tokens, room, epochs, last)
