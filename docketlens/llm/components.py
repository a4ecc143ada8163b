"""Connected components by alternating large-star and small-star steps.

Each step is a min per node and one join on the node, so the work is linear in the edges and no
component is ever gathered in a task. Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


#: At most so many hub nodes are handled apart from the others.
HUBS = 1000
#: Edges of one partition between rounds, so that small graphs do not shuffle in many tiny files.
PART_EDGES = 100_000


def _hub_degree(edges: int) -> int:
    """Degree above which a node is a hub; fewer than ``HUBS`` nodes of ``edges`` edges exceed it."""
    return max(64, -(-2 * edges // HUBS))


def _joined(rows: DataFrame, least: DataFrame, hub_degree: int) -> DataFrame:
    """``rows`` with the least neighbour ``m`` of ``u``.

    Rows of hubs meet a broadcast of the few hubs where they lie, so no task receives a hub's edges.
    """
    hubs = F.broadcast(least.filter(F.col("n") > hub_degree).select("u", "m"))
    others = least.filter(F.col("n") <= hub_degree).select("u", "m")
    plain = rows.join(hubs.select("u"), "u", "left_anti").join(others, "u")
    return rows.join(hubs, "u").unionByName(plain)


def with_least(rows: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key``; rows of very frequent keys stay where they lie."""
    named = rows.withColumnRenamed(key, "u")
    least = named.groupBy("u").agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n"))
    degree = _hub_degree(rows.count() // 2)
    return _joined(named, least, degree).withColumnRenamed("u", key).withColumnRenamed("m", output)


def _large_star(edges: DataFrame, hub_degree: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(
        "u", F.least("u", "m").alias("m"), "n"
    )
    return _joined(both.filter(F.col("v") > F.col("u")), least, hub_degree).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    ).distinct()


def _small_star(edges: DataFrame, hub_degree: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    below = _joined(edges, least, hub_degree).filter(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` long pairs to ``(node, root)`` for every node with an edge to another node.

    ``root`` is the smallest node of the component and the root itself is not listed.
    """
    current = cut_lineage(
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    seen = None
    count = current.count()
    hub_degree, parts = _hub_degree(count), max(1, -(-count // PART_EDGES))
    while True:
        # The large-star result is read several times, so it is written once.
        wide = cut_lineage(_large_star(current, hub_degree).coalesce(parts))
        current = cut_lineage(_small_star(wide, hub_degree).coalesce(parts))
        state = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        ).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
