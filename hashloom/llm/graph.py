"""Connected components of edge tables by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hashloom.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): nodes have one root just when a path connects them.

    Each round every node moves to the first node, in the round's own order, among
    its neighbours and itself, and the edges move along; edges within a node go.
    In the first round the order is that of the node numbers, so stars around
    their least node are done at once; later rounds order by fresh hashes, by
    which at least a quarter of the nodes is expected to go each time, whatever
    the shape: the rounds grow with the logarithm of the number of nodes. The
    nodes' moves are stored before the joins, so that both sides of these are
    plain shuffles and adaptive execution can split a node with very many edges.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct())
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = stored(both.groupBy("u").agg(_first("u", "v", len(moves)).alias("to")))
        ends = edges.join(move.select("u", F.col("to").alias("from_")), "u").join(move.select(F.col("u").alias("v"), "to"), "v")
        edges = stored(ends.select(F.greatest("from_", "to").alias("u"), F.least("from_", "to").alias("v")).where("u <> v").distinct())
        moves.append(move)
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = moves[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = stored(move.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root")))
    return roots


def _first(own: str, other: str, turn: int) -> Column:
    """Of a node and its neighbours the one that comes first in the order of this round."""
    if turn == 0:
        return F.least(F.min(other), F.first(own))
    key = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("node"))
    return F.least(F.min(key(other)), F.min(key(own)))["node"]
