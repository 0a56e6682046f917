"""Balanced partitions of a weighted graph with few cut edges: coarsening, a start along a curve, refinement level by level.

All steps are joins and grouped sums over nodes and edges; windows run over rows per pair of
parts, never over a part's nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.functions.storage import broadcast_if_small, running_sum, settle
from entitygraph.operators.tiling import z_order

#: Classes by hash in which moves of equal gain are taken.
CLASSES = 64


def _named(nodes: DataFrame, node: str, value: str, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(node), F.col(value).alias(name))


def matching(nodes: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """(node, to) of nodes that join a neighbour: edges that are the heaviest of both their ends, where both weigh ``most`` at most.

    Edges of equal weight are in the order of a hash of their ends, so there is always one to take.
    """
    fit = edges.join(_named(nodes, "a", "size", "sa"), "a").join(_named(nodes, "b", "size", "sb"), "b").where(F.col("sa") + F.col("sb") <= most)
    rank = F.struct("w", F.xxhash64("a", "b").alias("h"), "a", "b")
    best = fit.select(F.explode(F.array("a", "b")).alias("node"), rank.alias("e")).groupBy("node").agg(F.max("e").alias("e"))
    return best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select(F.col("e.b").alias("node"), F.col("e.a").alias("to"))


def contract(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after renaming (node, to): sizes and weights add up, places are means, inner edges go."""
    to = F.coalesce("to", "node").alias("node")
    joined = nodes.join(names, "node", "left").select(to, "size", *((F.col(c) * F.col("size")).alias(c) for c in "xy"))
    fewer = joined.groupBy("node").agg(F.sum("size").alias("size"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    fewer = fewer.select("node", "size", *((F.col(c) / F.col("size")).alias(c) for c in "xy"))
    e = edges
    for end in "ab":
        e = e.join(names.select(F.col("node").alias(end), F.col("to").alias("_t")), end, "left").withColumn(end, F.coalesce("_t", end)).drop("_t")
    e = e.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    return fewer, e


def cut_weight(placed: DataFrame, edges: DataFrame) -> float:
    """The weight of all edges between nodes (node, part) of different parts."""
    both = edges.join(_named(placed, "a", "part", "pa"), "a").join(_named(placed, "b", "part", "pb"), "b")
    return both.where("pa <> pb").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]


def _within(cells: DataFrame, key: str, other: str, room: Column) -> DataFrame:
    along = Window.partitionBy(key).orderBy("class", other, "h").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_s", F.sum("size").over(along)).where(F.col("_s") <= room).drop("_s")


def moves(placed: DataFrame, edges: DataFrame, upward: bool, turn: int, least: float, most: float) -> DataFrame:
    """(node, to) of half of the nodes that more weight ties to a higher (lower) part than to their own, as far as sizes of parts allow.

    Greater gains come first, in classes of half powers of two.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("_o"), "w").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("_o"), "w"))
    pull = ends.join(_named(placed, "_o", "part", "to"), "_o").groupBy("node", "to").agg(F.sum("w").alias("w"))
    own = pull.join(placed.select("node", "size", "part"), "node")
    ahead = F.col("to") > F.col("part") if upward else F.col("to") < F.col("part")
    best = own.groupBy("node", "size", "part").agg(F.sum(F.when(F.col("to") == F.col("part"), F.col("w")).otherwise(0)).alias("stay"), F.max(F.when(ahead, F.struct("w", (-F.col("to")).alias("p")))).alias("go"))
    gain = F.col("go.w") - F.col("stay")
    wish = best.where(F.col("go").isNotNull() & (gain > 0) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0))
    wish = wish.select("node", "size", "part", (-F.col("go.p")).alias("to"), (-F.floor(2 * F.log2(gain))).alias("class"), F.pmod(F.xxhash64("node"), F.lit(CLASSES)).alias("h"))
    wish = settle(wish, "wishes", compact=True)
    loads = placed.groupBy("part").agg(F.sum("size").alias("load"))  # one row a part
    cells = wish.groupBy("part", "to", "class", "h").agg(F.sum("size").alias("size"))
    cells = cells.join(F.broadcast(loads.select(F.col("part").alias("to"), (F.lit(most) - F.col("load")).alias("into"))), "to").join(F.broadcast(loads.select("part", (F.col("load") - F.lit(least)).alias("out"))), "part")
    taken = _within(_within(cells, "to", "part", F.col("into")), "part", "to", F.col("out"))
    return wish.join(broadcast_if_small(taken.select("part", "to", "class", "h")), ["part", "to", "class", "h"]).select("node", "to")


def refine(placed: DataFrame, edges: DataFrame, least: float, most: float, turns: int) -> DataFrame:
    """Nodes after ``turns`` rounds of moves, alternately to higher and lower parts; a round that does not lower the cut is undone."""
    cut, idle = cut_weight(placed, edges), 0
    if not cut:
        return placed
    for turn in range(turns):
        go = moves(placed, edges, turn % 2 == 0, turn, least, most)
        after = settle(placed.join(go, "node", "left").withColumn("part", F.coalesce("to", "part")).drop("to"), "placed", compact=True)
        now = cut_weight(after, edges)
        if now < cut:
            placed, cut, idle = after, now, 0
        else:
            idle += 1
            if idle == 2:
                break
    return placed


def min_cut_partition(centres: DataFrame, edges: DataFrame, parts: int, slack: float = 0.05, levels: int = 10, turns: int = 6) -> DataFrame:
    """Centres (entity, x, y) with ``part``: parts of equal numbers but for ``slack`` that cut little of the edges (src, dst[, w]).

    Nodes are merged along their heaviest edges as long as none grows beyond the slack, the coarse graph is
    dealt along a Z-order curve, and each level is refined on the way back.  Edges count once in either
    direction, repeated ones add up; loops and edges with unknown ends are left out.  An empty table stays empty.
    """
    weight = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    nodes = settle(centres.select(F.col("entity").alias("node"), F.lit(1.0).alias("size"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "nodes", compact=True)
    known = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight.alias("w"))
    for end in "ab":
        known = known.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    graph = settle(known.groupBy("a", "b").agg(F.sum("w").alias("w")), "edges", compact=True)
    total = nodes.count()
    if not total:
        return centres.withColumn("part", F.lit(None).cast("int"))
    most_size = max(1.0, slack * total / parts)
    least, most = (1 - slack) * total / parts, (1 + slack) * total / parts
    stack, count = [], total
    for _ in range(levels):
        names = settle(matching(nodes, graph, most_size), "names", compact=True)
        merged = names.count()
        if merged < 0.02 * count:
            break
        stack.append((nodes, graph, names))
        coarse, thin = contract(nodes, graph, names)
        nodes, graph, count = settle(coarse, "nodes", compact=True), settle(thin, "edges", compact=True), count - merged
    along = running_sum(z_order(nodes).select("node", "size", "_z"), ["_z", "node"], "size")
    part = F.least(F.floor((F.col("before") + F.col("size") / 2) * parts / total), F.lit(parts - 1)).cast("int")
    placed = settle(along.select("node", "size", part.alias("part")), "placed", compact=True)
    placed = refine(placed, graph, least, most, turns)
    for finer, links, names in reversed(stack):
        down = finer.select("node", "size").join(names, "node", "left").withColumn("to", F.coalesce("to", "node"))
        placed = settle(down.join(_named(placed, "to", "part", "part"), "to").select("node", "size", "part"), "placed", compact=True)
        placed = refine(placed, links, least, most, turns)
    return centres.join(placed.select(F.col("node").alias("entity"), "part"), "entity")
