"""Iterative graph operators as loops of joins.

Each round is written to the checkpoint folder; the only value that reaches the
driver per round is a count.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import fragment_replicate_join
from tessera.sources.tables import cut_lineage

#: One-row-per-node sides may be broadcast below this many bytes, by their counted rows.
BROADCAST_BYTES = 32 << 20
_NODE_BYTES = 256


def _hub_join(rows: DataFrame, per_node: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row of ``per_node`` of their node; a hub may have a third of all rows."""
    if per_node.count() * _NODE_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_node), key)
    return fragment_replicate_join(rows, per_node, key)


def _checksum(df: DataFrame) -> tuple:
    """Number of rows and two sums of their hashes; equal sets give equal sums."""
    h = lambda seed: F.sum(F.xxhash64(*df.columns, F.lit(seed)).cast("decimal(20,0)"))
    return tuple(df.agg(F.count(F.lit(1)), h(1), h(2)).first())


def connected_components(edges: DataFrame, a: str, b: str, *, max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node of each component.

    Alternating large-star and small-star steps, so rounds grow with the
    logarithm of a component's length and a node of many neighbours is reduced
    by a minimum that combines before the shuffle.  Null ends are left out, self
    edges give lone nodes.  Rounds end when the edges' checksum stays.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    cur = cut_lineage(e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _checksum(cur)
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is tied to the node's least.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = _hub_join(both.where(F.col("v") > F.col("u")), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = cut_lineage(large)
        # Small star: every smaller neighbour, and the node, is tied to the least.
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = _hub_join(large, low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        cur = cut_lineage(nxt)
        after = _checksum(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    labels = cur.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select("node", F.coalesce("m", "node").alias("component"))


def distances(edges: DataFrame, sources: DataFrame, a: str, b: str, node: str, *, max_depth: int | None = None) -> DataFrame:
    """``node, depth``: fewest edges from any source.

    Level by level until no node is new: the frontier meets the edges by
    equality and drops what was reached before.  Cycles end by themselves;
    unreached nodes are left out.  ``max_depth`` asks for the nodes of so many
    levels only.
    """
    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).distinct()
    seen = cut_lineage(sources.select(F.col(node).alias("node")).where(F.col("node").isNotNull()).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(e, F.col("node") == F.col("__a")).select(F.col("__b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut_lineage(step.withColumn("depth", F.lit(depth)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def spread_sets(edges: DataFrame, seeds: DataFrame, a: str, b: str, node: str, value: str, *, max_rounds: int = 50) -> DataFrame:
    """``node, value``: each seed value at every node it reaches along edges.

    A monotone fix-point, so the order of rounds does not matter; only new
    (node, value) rows take part in the next round.
    """
    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    seen = cut_lineage(seeds.select(F.col(node).alias("node"), F.col(value).alias("value")).distinct())
    frontier = seen
    for _ in range(max_rounds):
        step = frontier.join(e, F.col("node") == F.col("__a")).select(F.col("__b").alias("node"), "value").distinct()
        frontier = cut_lineage(step.join(seen, ["node", "value"], "left_anti"))
        if frontier.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("values did not settle")


def shortest_paths(edges: DataFrame, sources: DataFrame, a: str, b: str, node: str, kind: str) -> DataFrame:
    """``node, path, kinds``: a fewest-edges path from any source to each node.

    Of equally long paths the one of the smallest (predecessor path, kind)
    counts, so the choice is fixed.  ``kinds`` holds the edge kinds on the way.
    """
    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(kind).cast("string").alias("__k")).where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).distinct()
    start = sources.select(F.col(node).alias("node")).where(F.col("node").isNotNull()).distinct()
    seen = cut_lineage(start.select("node", F.array("node").alias("path"), F.array().cast("array<string>").alias("kinds")))
    frontier = seen
    while True:
        step = frontier.join(e, F.col("node") == F.col("__a")).join(seen.select(F.col("node").alias("__s")), F.col("__b") == F.col("__s"), "left_anti")
        best = step.groupBy("__b").agg(F.min(F.struct("path", "__k", "kinds")).alias("m"))
        frontier = cut_lineage(best.select(F.col("__b").alias("node"), F.concat("m.path", F.array("__b")).alias("path"), F.concat("m.kinds", F.array("m.__k")).alias("kinds")))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def paths_per_source(edges: DataFrame, sources: DataFrame, a: str, b: str, kind: str, node: str, *, max_rounds: int = 200) -> DataFrame:
    """``source, node, path, kinds``: a fewest-edges path from every source to each node it reaches.

    Of equally long paths the smallest (predecessor path, kind) counts.  Raises
    if paths are longer than ``max_rounds``.
    """
    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(kind).cast("string").alias("__k")).where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).distinct()
    start = sources.select(F.col(node).alias("node")).where(F.col("node").isNotNull()).distinct()
    seen = cut_lineage(start.select(F.col("node").alias("source"), "node", F.array("node").alias("path"), F.array().cast("array<string>").alias("kinds")))
    frontier = seen
    for _ in range(max_rounds):
        step = frontier.join(e, F.col("node") == F.col("__a")).select("source", F.col("__b").alias("node"), "path", "kinds", "__k")
        best = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min(F.struct("path", "__k", "kinds")).alias("m"))
        frontier = cut_lineage(best.select("source", "node", F.concat("m.path", F.array("node")).alias("path"), F.concat("m.kinds", F.array("m.__k")).alias("kinds")))
        if frontier.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("paths did not settle")
