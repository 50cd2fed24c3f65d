"""Connected components over an edge table, without collecting edges, labels or groups anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a long, b long) -> (node long, label long): for each node of an edge, the smallest node of its component.

    Each round hooks every node to its smallest neighbour if that is smaller, follows one more pointer, and contracts
    the edges to what joins different nodes. Every node that still has an edge hooks or is hooked to, so the nodes at
    least halve: the rounds grow as the logarithm of the component's size. All tables of a round are written to the
    shared folder. A hub with very many edges is summed on the map side and joined under AQE's skew handling.
    Null ends and loops are ignored; an empty table gives an empty table.
    """
    now = scratch.keep(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p"))
        hook = scratch.keep(hook, "hook")
        jump = hook.join(hook.select(F.col("node").alias("p"), F.col("p").alias("pp")), "p").select("node", F.col("pp").alias("p"))
        jump = scratch.keep(jump, "jump")
        ends = now.join(jump.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(jump.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        after = scratch.keep(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        step = jump.select(F.col("node").alias("label"), "p")
        new = jump.select("node", F.col("p").alias("label")) if labels is None else labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        new = scratch.keep(new, "labels")
        scratch.drop(now, hook, jump, *([labels] if labels is not None else []))
        now, labels = after, new
    return labels if labels is not None else now.select(F.col("a").alias("node"), F.col("b").alias("label"))
