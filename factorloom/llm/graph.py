"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, fresh_path
from .common import stored_at


def _stars(edges: DataFrame, large: bool, path: str) -> DataFrame:
    """One step on edges (a, b), a > b: link neighbours to the least of a node's neighbourhood.

    The large step looks at all neighbours of a node and moves the greater ones; the small step looks at the smaller
    ones and moves those. The least neighbours begin as partial sums and are stored, so that the join that brings them to
    the edges has an exchange on either side: adaptive execution then splits the edges of a hub.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored_at(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), path)
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node that can be reached.

    Each round is written to the shared folder, and the one before it is deleted then. An edge from a node to itself makes a component of its own. Null ends
    are left out. An empty table gives no rows.
    """
    edges = edges.where("a is not null and b is not null")
    nodes_alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    now = stored_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    for _ in range(rounds):
        # Done when every node hangs on one root that hangs on nothing.
        odd = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = now.select(F.col("b").alias("a")).distinct().join(now.select("a").distinct(), "a")
        if odd.isEmpty() and chained.isEmpty():
            linked = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            out = linked.unionByName(roots)
            return out.unionByName(nodes_alone.join(out.select("node"), "node", "left_anti").distinct())
        before, path = path, fresh_path(spark, "edges")
        passing = [fresh_path(spark, name) for name in ("least", "large", "least")]
        large = stored_at(_stars(now, True, passing[0]), passing[1])
        now = stored_at(_stars(large, False, passing[2]), path)
        for done in (before, *passing):
            discard(spark, done)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
