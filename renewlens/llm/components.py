"""Connected components of an edge table, by alternating star contractions.

Every round is two aggregations and two joins over the edges, written to the
shared folder. A node with very many neighbours is only ever reduced to its
smallest neighbour (with map-side combine) and joined back to its edges, which
adaptive execution splits; no neighbour list is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:  # larger neighbours move to the smallest one
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours, and the node itself, move to the smallest one
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def _state(edges: DataFrame):
    return edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    ``links`` has two long columns ``a`` and ``b`` in any direction, repeats
    and self links allowed; rows with a NULL are left out. An empty table gives
    an empty table.
    """
    edges = (
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = stored(edges, purpose)
    state = _state(edges)
    for _ in range(ROUNDS):
        if not state["n"]:
            break
        edges = stored(_star(_star(edges, True), False), purpose)
        last, state = state, _state(edges)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
