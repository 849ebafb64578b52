"""Mixing sources to target weights: hierarchical budgeting over a tree of columns.

A token budget goes down the tree (say domain, language, source). At each node it is
split among the children by their weights; a child that can't use its share (its
documents times the allowed epochs hold fewer tokens) keeps what it can use, and the
rest goes to its siblings, by weight again. As a node can use what its children can use
together, a shortage reaches an ancestor only when all siblings are full. Sorted by
what they can use per weight, the children that fill up come first, so one running sum
finds them: no iteration.

Each leaf then reads its documents in seeded orders, one for each epoch: whole epochs
first, and of the last one the longest prefix whose tokens fit. The prefix is found
by sums over ranges of the order (about the square root of the leaf's documents of
them) and then within the one range where it ends, so that no leaf, however large, is
sorted by one task.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import WORD, hex_long
from auditlake.session import written

ORDER_DIGITS = 15  # hex digits of a document's place in an epoch
SMALL_TABLE = 200_000  # leaves up to which their table is broadcast; counted, not assumed


def n_tokens(text: Column) -> Column:
    """Words, as the measure of a document's size."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch's order; equal places are told apart by doc_id."""
    key = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return hex_long(F.md5(key), ORDER_DIGITS)


def weight_of(path: Column, weights: dict[str, int]) -> Column:
    """The weight named for a node's path (levels joined by "/"), else 1."""
    chosen = F.lit(1)
    for name, weight in weights.items():
        chosen = F.when(path == name, weight).otherwise(chosen)
    return chosen.cast("long")


def _whole(a: Column, b: Column) -> Column:
    """a / b in whole numbers, for a that isn't negative."""
    return F.call_function("div", a, b).cast("long")


def leaf_budgets(
    leaves: DataFrame, levels: list[str], weights: dict[str, int], share: tuple[int, int], epochs: int
) -> DataFrame:
    """Adds ``budget`` to the leaves (levels, tokens)."""
    leaves = written(leaves.withColumn("usable", F.col("tokens") * epochs), "leaves")
    budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
    nodes = None
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[: depth - 1]
        own = leaves.groupBy(*path).agg(F.sum("usable").alias("usable"))
        own = own.withColumn("weight", weight_of(F.concat_ws("/", *path), weights))
        own = own.join(nodes, parent) if parent else own.withColumn("budget", F.lit(budget).cast("long"))
        fill = Window.partitionBy(*parent).orderBy(F.col("usable") / F.col("weight"), path[-1])
        before = fill.rowsBetween(Window.unboundedPreceding, -1)
        behind = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        left = F.col("budget") - F.coalesce(F.sum("usable").over(before), F.lit(0))
        own = own.withColumn("left", F.greatest(left, F.lit(0)))
        own = own.withColumn("weights_left", F.sum("weight").over(behind))
        full = F.col("usable") * F.col("weights_left") <= F.col("weight") * F.col("left")
        own = own.withColumn("full", full)
        rest = Window.partitionBy(*parent)
        open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(rest)
        open_budget = F.col("budget") - F.coalesce(
            F.sum(F.when(F.col("full"), F.col("usable"))).over(rest), F.lit(0)
        )
        given = F.when(F.col("full"), F.col("usable")).otherwise(
            _whole(F.col("weight") * open_budget, open_weight)
        )
        own = own.withColumn("given", given)
        nodes = own.select(*path, F.col("given").alias("budget"))
    return leaves.join(nodes, levels)


def plan(
    sized: DataFrame, levels: list[str], weights: dict[str, int], share: tuple[int, int], epochs: int, seed: int
) -> DataFrame:
    """For each leaf: whole epochs, the epoch it ends in, and the last place that epoch reaches.

    ``sized``: doc_id, n_tokens and the levels, written before as it is read three times.
    """
    leaves = sized.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    leaves = leaf_budgets(leaves, levels, weights, share, epochs)
    whole = F.when(F.col("tokens") > 0, _whole(F.col("budget"), F.col("tokens"))).otherwise(F.lit(0))
    leaves = (
        leaves.withColumn("whole", whole)
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
        .withColumn("ranges", F.ceil(F.sqrt(F.col("n_docs"))).cast("long"))
        .select(*levels, "budget", "whole", "rest", "ranges")
    )
    leaves = written(leaves, "budgets")
    small = leaves.count() <= SMALL_TABLE
    known = F.broadcast(leaves) if small else leaves
    ordered = (
        sized.join(known, levels)
        .withColumn("place", place(seed, F.col("whole"), F.col("doc_id")))
        # shiftright keeps the product within a long
        .withColumn("range", F.shiftright(F.shiftright("place", 30) * F.col("ranges"), 30))
    )
    by_range = Window.partitionBy(*levels).orderBy("range")
    sums = (
        ordered.groupBy(*levels, "range", "rest")
        .agg(F.sum("n_tokens").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(by_range))
    )
    # The first range that doesn't fit as a whole; none if the rest of the budget takes them all.
    ends = sums.filter(F.col("upto") > F.col("rest")).groupBy(*levels).agg(
        F.min(F.struct("range", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end")
    )
    ends = ends.select(*levels, F.col("end.range").alias("end_range"), F.col("end.before").alias("before"))
    inside = ordered.join(F.broadcast(ends) if small else ends, levels).filter(
        F.col("range") == F.col("end_range")
    )
    by_place = Window.partitionBy(*levels).orderBy(F.struct("place", "doc_id"))
    last = (
        inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(by_place))
        .filter(F.col("upto") <= F.col("rest"))
        .groupBy(*levels)
        .agg(F.max(F.struct("place", "doc_id")).alias("last"))
    )
    return (
        leaves.join(ends.select(*levels, "end_range"), levels, "left")
        .join(last, levels, "left")
        .select(*levels, "budget", "whole", "ranges", "end_range", "last")
    )


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, int],
    share: tuple[int, int] = (1, 2),
    epochs: int = 2,
    seed: int = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """How often each document is read, with the level columns beside it.

    ``levels``: name to column, from the root's children to the leaves; nulls are a child
    of their own named "none". ``weights``: path ("a", "a/en", ...) to a positive whole number,
    1 where none is named. ``share``: the budget as a fraction of all tokens. ``keep``:
    further columns of ``docs`` to return; a level's name must not be among them.

    Returns doc_id, n_tokens, the levels, copies (0 for documents that aren't read) and
    budget of the leaf. A null or empty text has no tokens, so it fits wherever it stands
    within the prefix. Rows that repeat a doc_id stand at one place and are read or left
    together. An empty table gives no rows. If the tree as a whole can't use the budget,
    every leaf gives all its epochs.
    """
    names = list(levels)
    keep = [c for c in keep or [] if c not in {"doc_id", "n_tokens", "copies", "budget", *names}]
    labelled = docs.select(
        "doc_id",
        n_tokens(F.col("text")).alias("n_tokens"),
        *(F.coalesce(column.cast("string"), F.lit("none")).alias(name) for name, column in levels.items()),
        *(F.col(c) for c in keep),
    )
    sized = written(labelled.select("doc_id", "n_tokens", *names), "sized")
    leaves = written(plan(sized, names, weights, share, epochs, seed), "prefixes")
    known = F.broadcast(leaves) if leaves.count() <= SMALL_TABLE else leaves
    at = place(seed, F.col("whole"), F.col("doc_id"))
    joined = (labelled if keep else sized).join(known, names).withColumn("place", at)
    range_ = F.shiftright(F.shiftright("place", 30) * F.col("ranges"), 30)
    within = (
        F.col("end_range").isNull()
        | (range_ < F.col("end_range"))
        | (F.struct("place", "doc_id") <= F.col("last"))
    )
    copies = F.col("whole") + F.coalesce(within & (F.col("whole") < epochs), F.lit(False)).cast("long")
    return joined.select("doc_id", "n_tokens", *names, copies.alias("copies"), "budget", *keep)
