"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries target weights. A token budget
goes down the tree: at each node it is split by weight, and what a child cannot
use (all its documents, over all epochs) is split again among its siblings, so a
shortage is made up by siblings before it reaches the ancestors' siblings. Each
leaf then takes the first tokens of its seeded epochs, up to its budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.session import prepare, stored

LEVELS = ["domain", "lang", "source"]
NO_VALUE = "(none)"
BUCKET_DIGITS = 3


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weight_of(value: Column, weights: Mapping[str, float]) -> Column:
    """The target weight of a node among its siblings; 1 where none is named."""
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(value == name, F.lit(float(weight))).otherwise(out)
    return out


def _split(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Each child's budget out of its parent's: the level w is sought at which min(capacity, w * weight) sums to the budget.

    In ascending order of capacity / weight, a child is full exactly if it is
    below the level that the budget left after all before it allows.
    """
    siblings = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = siblings.rowsBetween(Window.unboundedPreceding, -1)
    after = siblings.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(*parent)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after)
    full = nodes.withColumn("level", level).withColumn("is_full", F.col("level") * F.col("weight") >= F.col("capacity"))
    spent = full.withColumns({"held": F.sum(F.when(F.col("is_full"), F.col("capacity")).otherwise(0)).over(everyone), "open": F.sum(F.when(~F.col("is_full"), F.col("weight")).otherwise(0.0)).over(everyone)})
    share = F.floor((F.col("budget") - F.col("held")) * F.col("weight") / F.col("open")).cast("bigint")
    return spent.withColumn("budget", F.when(F.col("is_full"), F.col("capacity")).otherwise(share)).drop("level", "is_full", "held", "open")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], budget: Column, epochs: int) -> DataFrame:
    """(domain, lang, source, available, budget) from ``leaves`` with ``available`` tokens.

    Budgets are whole tokens; what rounding leaves over is not spent. A weight of
    zero or less gives no budget, so leaves below such a node are no capacity of
    any node above it either.
    """
    usable = [weight_of(F.col(name), weights.get(name, {})) > 0 for name in LEVELS]
    leaves, out = leaves.where(usable[0] & usable[1] & usable[2]), None
    for depth, name in enumerate(LEVELS):
        keys, parent = LEVELS[: depth + 1], LEVELS[:depth]
        nodes = leaves.groupBy(*keys).agg((F.sum("available") * epochs).alias("capacity"), F.sum("available").alias("available"))
        nodes = nodes.withColumn("weight", weight_of(F.col(name), weights.get(name, {}))).where("capacity > 0")
        nodes = nodes.withColumn("budget", budget) if out is None else nodes.join(out.select(*parent, "budget"), parent)
        out = _split(nodes, parent, name)
    return out.select(*LEVELS, "available", "budget")


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], share: float, epochs: int = 2, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents that fill each leaf's budget, and how much of each.

    ``docs`` needs doc_id, text, lang and source; ``domain`` is an expression over
    its columns. The whole budget is ``share`` of all tokens. Returns a row for
    each epoch in which a document is taken: doc_id, domain, lang, source, epoch
    (from 0), start (tokens of its leaf before it), n_tokens (of the document),
    taken (its first tokens that are within the budget; the last document of a
    leaf may be cut). ``carry`` names long columns of ``docs`` that the result keeps.

    An epoch's order is the MD5 of seed, epoch, doc_id and the text's own MD5, ties
    by doc_id. A leaf is cut at a bucket of the hash's first digits, so that only
    the documents of one bucket of each leaf are put in order; a hot source, and
    rows without doc_id, spread over all buckets. Null domain, lang or source is
    the node "(none)". Documents without tokens are never taken. Repeated rows are
    documents of their own and stand next to each other. Other columns, whatever
    their names, are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    told = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit(NO_VALUE)).alias(n) for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")), strict=True)], n_tokens(F.col("text")).alias("n_tokens"), F.md5(F.col("text").cast("binary")).alias("digest"), *carry)
    told = stored(told.where("n_tokens > 0"), "leaves")
    leaves = told.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"))
    total = leaves.agg(F.sum("available")).first()[0] or 0
    given = budgets(leaves, weights, F.lit(int(total * share)).cast("bigint"), epochs)

    shuffled = told.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    shuffled = shuffled.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id", "digest").cast("binary"))).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sums = shuffled.groupBy(*LEVELS, "epoch", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    ordered = Window.partitionBy(*LEVELS).orderBy("epoch", "bucket")
    sums = sums.withColumn("before", F.sum("in_bucket").over(ordered) - F.col("in_bucket")).join(given, LEVELS).where("before < budget")
    within = Window.partitionBy(*LEVELS, "epoch", "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    chosen = shuffled.join(sums.select(*LEVELS, "epoch", "bucket", "before", "budget"), [*LEVELS, "epoch", "bucket"])
    chosen = chosen.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("start < budget")
    return chosen.select("doc_id", *LEVELS, "epoch", "start", "n_tokens", F.least("n_tokens", F.col("budget") - F.col("start")).alias("taken"), *carry)
