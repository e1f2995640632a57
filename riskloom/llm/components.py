"""Connected components by rounds of contraction.

In each round every node moves to the neighbour (or itself) of least random priority, and the links are drawn again
between the places their ends moved to. A constant share of the nodes that still have links goes in each round, also
in long chains, so there are about log(n) rounds. Each round is one aggregate and two equality joins over the links
that are left, written to the shared folder; the driver sees only whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` for every node of ``links``: equal roots, one component. No links give no rows.

    Nodes can have any type that can be compared; null ends and loops are no links.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    edges = stage(edges.filter(F.col("a") != F.col("b")).distinct(), "links")
    found, left = None, edges
    round_no = 0
    while not left.isEmpty():
        moved = stage(_moves(left, round_no), "moves")
        found = moved if found is None else stage(_followed(found, moved), "followed")
        ends = left.join(moved.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        ends = ends.join(moved.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        left = stage(ends.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        round_no += 1
    if found is None:
        kind = dict(edges.dtypes)["a"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return found


def _moves(edges: DataFrame, round_no: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("node", "near")
    ranked = lambda c: F.struct(F.xxhash64(F.lit(round_no), F.col(c)).alias("p"), F.col(c).alias("n"))
    least = both.groupBy("node").agg(F.min(ranked("near")).alias("near"))
    return least.select("node", F.least(F.col("near"), ranked("node"))["n"].alias("root"))


def _followed(found: DataFrame, moved: DataFrame) -> DataFrame:
    step = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
    joined = found.join(step, "root", "left")
    return joined.select("node", F.coalesce("next", "root").alias("root"))
