"""Connected components as rounds of DataFrame joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shuttleplan.functions.scratch import materialize


def _star(edges: DataFrame, keep: str) -> DataFrame:
    """Point the chosen neighbours of every node at the least of the node and its neighbours.

    The least neighbour comes from an aggregate with a map-side combine; the join back is an
    equi-join that adaptive execution can split where a hub has very many edges.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if keep == "large":
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    to_least = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return to_least.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node that it reaches.

    ``a`` and ``b`` are BIGINT; loops and repeated edges are allowed, rows with a null end are
    left out, no rows give no rows. Every round writes its edges to the shared folder, so that
    neither the plan nor what a lost executor costs grows with the rounds.
    """
    nodes = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = materialize(nodes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = now.where("a = b").select("a", "b")
    now, last = now.where("a <> b"), None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialize(_star(both, "large").distinct())
        now = materialize(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "small").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == (seen["n"], seen["h"]):
            break
        last = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lone = loops.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(roots).union(lone).groupBy("node").agg(F.min("component").alias("component"))
