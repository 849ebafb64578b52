"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id on an edge (a, b), the smallest id it reaches.

    Every id keeps its smallest known smaller neighbour as its parent; each other smaller
    neighbour is passed on to that parent, and parents' parents are looked up, until
    all parents are roots. Edges only ever shrink towards smaller ids, each round is cut by a
    written table, and only row counts come to the driver.
    """
    down = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y")
    down = written(down.distinct(), "edges")
    while True:
        parents = down.groupBy("x").agg(F.min("y").alias("p"))
        # Neighbours other than the parent become the parent's.
        passed = (
            down.join(parents, "x")
            .filter("y <> p")
            .select(F.greatest("y", "p").alias("x"), F.least("y", "p").alias("y"))
        )
        # Parents that have parents themselves are skipped.
        above = parents.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        lifted = parents.join(above, "p", "left").select("x", F.coalesce("pp", "p").alias("y"))
        after = written(passed.union(lifted).distinct(), "edges")
        if after.count() == down.count() and not after.join(down, ["x", "y"], "left_anti").take(1):
            break
        down = after
    roots = down.select(F.col("y").alias("id")).distinct().join(down.select(F.col("x").alias("id")), "id", "left_anti")
    return down.select(F.col("x").alias("id"), F.col("y").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
