"""Connected components by alternating large-star and small-star rounds.

Both steps are a grouped minimum (combined on the map side) and one join, so a
component of any size is never gathered into one task; each round is written
to the shared folder, which keeps plans short and survives lost executors.
Method: Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    around = _both(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Returns (node, component), a row for each node that has an edge.  Edges
    with a null end and self-loops are ignored; repeated edges count once.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now).distinct()).distinct(), "star")
        # Decimal sum: a sum of 64-bit hashes as BIGINT may overflow under ANSI rules.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
