"""Mixing sources to target weights by hierarchical budgeting, native Spark only.

Weights stand on the nodes of a tree (domain, then language, then source by default). A budget of tokens goes
from the root to the leaves. At each node it is shared among the children by weight, but no child gets more
than its capacity, the tokens below it times `max_epochs`; what a child can't take goes to its siblings. Since
an inner node's capacity is the sum of its leaves', a shortage leaves a family only when the whole family is
full, so siblings come before cousins.

A leaf with budget b and t tokens takes every document floor(b/t) times, and from one more epoch, ordered by
a seeded hash, the prefix of documents whose running sum of tokens stays within the rest. The running sums are
made in two steps (sums of hash slices, then sums inside a slice), so a leaf that holds a third of all rows is
spread over 4,096 slices.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = "__root"
NULL_NODE = "(null)"


def _weights(path: list[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    """The weight of the node at `path`; nodes that have none get 1. The table of weights is a parameter."""
    own = {k: float(v) for k, v in weights.items() if len(k) == len(path)}
    if any(not 0 <= w < float("inf") for w in own.values()):
        raise ValueError("weights are finite numbers from 0 on")
    if not own:
        return F.lit(1.0)
    cases = None
    for node, weight in sorted(own.items()):
        hit = None
        for column, value in zip(path, node, strict=True):
            test = F.col(column) == F.lit(value)
            hit = test if hit is None else hit & test
        cases = F.when(hit, F.lit(weight)) if cases is None else cases.when(hit, F.lit(weight))
    return cases.otherwise(F.lit(1.0))


def _share(children: DataFrame, parent: list[str], node: list[str]) -> DataFrame:
    """Give each child its part of __budget, by water filling in the order of capacity over weight.

    In that order the children that are full come first: child i is full if its capacity is at most its part of
    what the children before it leave, when they are full too.
    """
    order = [(F.col("__cap") / F.col("__w")).asc(), F.col(node[-1]).asc()]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    left = F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0)).cast("double")
    marked = children.withColumn("__fair", left * F.col("__w") / F.sum("__w").over(after)).withColumn(
        "__full", F.col("__cap").cast("double") <= F.col("__fair")
    )
    used = F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(whole), F.lit(0)).cast("double")
    open_w = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(whole)
    part = (F.col("__budget") - used) * F.col("__w") / open_w
    return marked.withColumn("__own", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(part))


def leaf_budgets(
    leaves: DataFrame, levels: list[str], weights: Mapping[tuple[str, ...], float], total: Column, max_epochs: int
) -> DataFrame:
    """The budget in tokens of each leaf. `leaves` has the level columns and __tokens; `total` is evaluated
    over one row with the column __all (the tokens of all leaves)."""
    capped = leaves.withColumn("__cap", F.col("__tokens") * F.lit(max_epochs))
    for depth in range(1, len(levels) + 1):  # what lies below a node of weight zero takes nothing
        capped = capped.withColumn("__cap", F.when(_weights(levels[:depth], weights) > 0, F.col("__cap")).otherwise(F.lit(0)))
    top = leaves.agg(F.coalesce(F.sum("__tokens"), F.lit(0)).alias("__all")).select(
        F.lit(ROOT).alias(ROOT), F.floor(total).cast("double").alias("__budget")
    )
    budgets, parent = top, [ROOT]
    for depth in range(1, len(levels) + 1):
        node = levels[:depth]
        kids = capped.withColumn(ROOT, F.lit(ROOT)).groupBy(ROOT, *node).agg(F.sum("__cap").alias("__cap"))
        kids = kids.withColumn("__w", _weights(node, weights)).join(budgets, parent)
        kids = kids.withColumn("__w", F.when(F.col("__w") > 0, F.col("__w")).otherwise(F.lit(1.0)))  # its capacity is none
        budgets = _share(kids, parent, node).select(ROOT, *node, F.col("__own").alias("__budget"))
        parent = [ROOT, *node]
    return budgets.drop(ROOT)


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple[str, ...], float],
    tokens: Column,
    total: Column | None = None,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
) -> DataFrame:
    """How often each document is taken, one row per input row.

    `levels` names the tree's levels, from the top, with the column that gives a document's node; null goes to
    the node "(null)". `total` is the budget in tokens as an expression of __all, the tokens of all documents
    (None: all of them). Weights are any numbers from 0 on, whole or not; only their ratio among siblings counts, and
    a node of weight 0 gets nothing. Returns id, the levels, n_tokens, leaf_tokens, leaf_budget (whole tokens), full_epochs,
    in_last_epoch and copies. Documents without tokens are never taken; a budget beyond the tree's capacity
    fills every leaf. Rows with the same id are ordered by their tokens, so ties change nothing that is kept; repeated
    rows are drawn each. A very long text is taken whole or not at all: one that doesn't fit in what is left of the last
    epoch ends it. Columns of the input other than those that `levels`, `tokens` and `id_col` read are ignored, so their
    names can't clash. An empty table gives an empty result.
    """
    names = list(levels)
    flat = docs.select(
        F.col(id_col),
        *[F.coalesce(c.cast("string"), F.lit(NULL_NODE)).alias(n) for n, c in levels.items()],
        tokens.cast("long").alias("n_tokens"),
    )
    leaves = flat.groupBy(*names).agg(F.sum("n_tokens").alias("__tokens"))
    budgets = leaf_budgets(leaves, names, weights, F.col("__all") if total is None else total, max_epochs)
    plan = leaves.join(budgets, names).select(
        *names, F.col("__tokens").alias("leaf_tokens"), F.floor("__budget").cast("long").alias("leaf_budget")
    )
    epochs = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.col("leaf_tokens"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("full_epochs", F.least(epochs, F.lit(max_epochs).cast("long")))
    plan = plan.withColumn("__rest", F.col("leaf_budget") - F.col("full_epochs") * F.col("leaf_tokens"))

    keyed = flat.join(plan, names).withColumn(
        "__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.col(id_col).cast("string")))
    )
    keyed = keyed.withColumn("__slice", F.substring("__h", 1, 3))
    slices = keyed.groupBy(*names, "__slice").agg(F.sum("n_tokens").alias("__sum"))
    ahead = Window.partitionBy(*names).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = (
        Window.partitionBy(*names, "__slice").orderBy("__h", id_col, "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = keyed.join(slices, [*names, "__slice"]).withColumn("__run", F.col("__ahead") + F.sum("n_tokens").over(inside))
    last = (F.col("n_tokens") > 0) & (F.col("__run") <= F.col("__rest")) & (F.col("full_epochs") < max_epochs)
    full = F.when(F.col("n_tokens") > 0, F.col("full_epochs")).otherwise(F.lit(0).cast("long"))
    return run.select(
        id_col, *names, "n_tokens", "leaf_tokens", "leaf_budget", full.alias("full_epochs"),
        last.alias("in_last_epoch"), (full + last.cast("long")).alias("copies"),
    )
