"""Connected components of an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(src long, dst long) -> (v, component): the smallest vertex reachable, for every vertex with an edge.

    Each round every vertex and its parent take the smallest grandparent among the neighbours, and
    vertices jump to their grandparents; the rounds grow with the logarithm of the diameter. The state of a
    round is one row per vertex, written to the shared folder. Nulls aren't vertices; no edges give no rows.
    """
    edges = edges.filter("src is not null and dst is not null")
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    state = materialize(both.groupBy("src").agg(F.min("dst").alias("p")).select(F.col("src").alias("v"), F.least("src", "p").alias("p")))
    for _ in range(max_rounds):
        parents = state.select(F.col("v").alias("pv"), F.col("p").alias("gp"))
        seen = state.join(parents, state["p"] == parents["pv"]).select("v", "p", "gp")
        near = both.join(seen.select(F.col("v").alias("dst"), "gp"), "dst").groupBy("src").agg(F.min("gp").alias("m"))
        step = seen.join(near, seen["v"] == near["src"]).select("v", "p", F.least("m", "gp").alias("c"))
        offers = step.select("v", "c", F.col("p").alias("old")).unionByName(step.select(F.col("p").alias("v"), "c", F.lit(None).cast("long").alias("old")))
        state = materialize(offers.groupBy("v").agg(F.min("c").alias("p"), F.max("old").alias("old")).select("v", F.least("p", "old").alias("p"), "old"))
        if state.filter("p <> old").isEmpty():
            return state.select("v", F.col("p").alias("component"))
        state = state.select("v", "p")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
