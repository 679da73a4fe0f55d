"""Connected components of a graph given by its edges, with joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round of the alternating star method over edges (u, v) with u > v.

    large: each node's larger neighbours are tied to the least node near it; else its smaller neighbours and itself.
    """
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = near.join(least.hint("merge"), "u")  # never broadcast: rounds would pile the built tables up in the driver
    if large:
        tied = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return tied.filter("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of any order-able type -> (node, root): the least node of its component, for every node that has an edge.

    Alternating large and small stars (Kiveris et al. 2014): every round keeps the components and ends with stars.
    A node with very many neighbours is only ever a join key, never a collected list, so skewed joins can be split.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    state = staged(edges, "edges")
    mark = None
    for _ in range(max_rounds):
        state = staged(_stars(_stars(state, True), False), "edges")
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(state.select("v", "v").distinct())
