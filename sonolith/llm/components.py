"""Connected components of a distributed edge list.

Randomised contraction: every round each node moves to the neighbour (or itself) with the least hash of the round, the
edges are rewritten to the new nodes and deduplicated. A constant share of the nodes disappears each round whatever the
ids look like, so the number of rounds is logarithmic. Every round is two equi-joins and two pre-aggregated group-bys;
rounds are written to the shared folder, so lineage stays short and a lost executor costs one round at most. Nodes of
very many edges are never a shuffle's hot key: their few moves are broadcast. Nothing but counters and those reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_unique, materialise


def connected(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, root long) for every node of an edge; equal roots mean connected.

    Self-links and repeated edges are allowed, null ends are dropped. The root is some node of the component.
    """
    live = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    rnd = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64(F.lit(rnd), "b").alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64(F.lit(rnd), "a").alias("h"), F.col("a").alias("to"))
        move = materialise(
            both.groupBy("a").agg(F.min(rank).alias("m")).select("a", F.least("m", own)["to"].alias("to")), "moves"
        )
        half = materialise(join_unique(live, move.withColumnRenamed("to", "ta"), "a", "inner").select("ta", "b"), "half")
        after = join_unique(half, move.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "inner").where("ta <> tb")
        after = after.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        after = materialise(after, "edges")
        discard(live)
        discard(half)
        live, rnd = after, rnd + 1
        moves.append(move)
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].toDF("node", "root")
    for move in reversed(moves[:-1]):  # from the few nodes of the last round to all of them
        step = join_unique(move.toDF("node", "to"), roots.toDF("to", "root"), "to").select("node", F.coalesce("root", "to").alias("root"))
        roots = materialise(step, "roots")
    return roots


def smallest(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members (node, id), roots of connected() -> (node, component_id): the smallest id of each component."""
    placed = materialise(members.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "placed")
    least = materialise(placed.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return join_unique(placed, least, "root", "inner").select("node", "component_id")
