"""Graphs over points: grid edges, constrained components, edge pruning, component summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitygraph.functions.scalars import bin_of, offsets_column, xy_half_offsets
from entitygraph.functions.storage import broadcast_if_small, settle
from entitygraph.operators import entity
from entitygraph.operators.components import components
from entitygraph.operators.delaunay import neighbours


def grid_edges(points: DataFrame, size: float = 8.0, topology: str = "8", z_size: float | None = None, z_depth: int = 1, longest: float | None = None) -> DataFrame:
    """(src, dst), src < dst, of points in equal or neighbouring bins, each edge once.

    Without ``z_size`` bins lie in the plane.  ``longest`` filters by distance, z included.
    """
    xy = xy_half_offsets(topology)
    zs = range(-z_depth, z_depth + 1) if z_size is not None else (0,)
    offsets = [(dx, dy, dz) for dx, dy in xy for dz in zs if (dx, dy) != (0, 0) or dz >= 0]
    bz = bin_of("z", z_size) if z_size is not None else F.lit(0)
    binned = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("id", "x", "y", "z", bin_of("x", size).alias("bx"), bin_of("y", size).alias("by"), bz.alias("bz"))
    a = binned.withColumn("o", F.explode(offsets_column(offsets))).select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"), (F.col("bx") + F.col("o.d0")).alias("bx"), (F.col("by") + F.col("o.d1")).alias("by"), (F.col("bz") + F.col("o.d2")).alias("bz"), ((F.col("o.d0") == 0) & (F.col("o.d1") == 0) & (F.col("o.d2") == 0)).alias("own"))
    met = a.join(binned, ["bx", "by", "bz"]).where((F.col("a") != F.col("id")) & (~F.col("own") | (F.col("a") < F.col("id"))))
    if longest is not None:
        d2 = F.pow(F.col("xa") - F.col("x"), F.lit(2)) + F.pow(F.col("ya") - F.col("y"), F.lit(2)) + F.pow(F.col("za") - F.col("z"), F.lit(2))
        met = met.where(d2 <= longest * longest)
    return met.select(F.least("a", "id").alias("src"), F.greatest("a", "id").alias("dst"))


def bin_edges(rows: DataFrame, size: float, z_size: float, z_depth: int = 1, label: str = "entity") -> DataFrame:
    """(src, dst) that hang an entity's points together as the graph of equal and neighbouring bins does, with fewer edges.

    Points of one bin hang on their smallest id, and smallest ids on those of neighbouring bins of the same entity.
    """
    binned = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).select("id", F.col(label).alias("entity"), bin_of("x", size).alias("bx"), bin_of("y", size).alias("by"), bin_of("z", z_size).alias("bz"))
    key = ["entity", "bx", "by", "bz"]
    reps = binned.groupBy(*key).agg(F.min("id").alias("rep"))
    star = binned.join(reps, key).where("id != rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    offsets = [(dx, dy, dz) for dx, dy in xy_half_offsets("8") for dz in range(-z_depth, z_depth + 1) if (dx, dy) != (0, 0) or dz > 0]
    moved = reps.withColumn("o", F.explode(offsets_column(offsets))).select("entity", (F.col("bx") + F.col("o.d0")).alias("bx"), (F.col("by") + F.col("o.d1")).alias("by"), (F.col("bz") + F.col("o.d2")).alias("bz"), F.col("rep").alias("a"))
    return star.unionByName(moved.join(reps, key).select(F.least("a", "rep").alias("src"), F.greatest("a", "rep").alias("dst")))


def self_bin_components(points: DataFrame, size: float) -> DataFrame:
    """Components of the graph that joins points of one bin: the bin itself, by grouping, without iteration."""
    binned = points.select("id", bin_of("x", size).alias("bx"), bin_of("y", size).alias("by"))
    first = binned.groupBy("bx", "by").agg(F.min("id").alias("component"))
    return binned.join(first, ["bx", "by"]).select("id", "component")


def all_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node, nodes without edges included."""
    reach = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
    return nodes.select("id").join(reach, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def constrained_components(nodes: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """Components along edges whose ends carry the same label; nodes with a null label belong to none."""
    lab = lambda s: nodes.where(F.col(label).isNotNull()).select(F.col("id").alias(s), F.col(label).alias(f"l_{s}"))
    kept = edges.join(lab("src"), "src").join(lab("dst"), "dst").where("l_src = l_dst").select("src", "dst")
    return all_components(nodes.where(F.col(label).isNotNull()), kept)


def edge_stats(edges: DataFrame, nodes: DataFrame, table: DataFrame) -> DataFrame:
    """Edges with npmi and cond_prob of their features' directed pair (gi, gj, npmi, cond_prob, dropped); 0 where missing or dropped."""
    feature = lambda s, g: nodes.select(F.col("id").alias(s), F.col("feature").alias(g))
    known = table.where("not dropped").select("gi", "gj", "npmi", "cond_prob")
    e = edges.join(feature("src", "gi"), "src").join(feature("dst", "gj"), "dst").join(broadcast_if_small(known), ["gi", "gj"], "left")
    return e.withColumns({"npmi": F.coalesce("npmi", F.lit(0.0)), "cond_prob": F.coalesce("cond_prob", F.lit(0.0))})


def prune_edges(edges: DataFrame, thresholds: DataFrame, near: float, far: float, npmi_floor: float = 0.0, cond_floor: float = 0.0) -> DataFrame:
    """Edges that stay, with ``connect``: 1 above the source feature's thresholds and nearer than ``near``.

    Of the rest, those at or below a floor, or as far as ``far``, go.
    """
    t = edges.join(broadcast_if_small(thresholds), "gi", "left")
    strong = F.coalesce((F.col("npmi") > F.col("npmi_thresh")) & (F.col("cond_prob") > F.col("cond_thresh")) & (F.col("length") < near), F.lit(False))
    weak = (F.col("npmi") <= npmi_floor) | (F.col("cond_prob") <= cond_floor) | (F.col("length") >= far)
    return t.withColumn("connect", strong.cast("int")).where(strong | ~weak).drop("npmi_thresh", "cond_thresh")


def undirected(edges: DataFrame) -> DataFrame:
    """Only edges whose directed form has src < dst, as the undirected view keeps them."""
    return edges.where("src < dst")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def component_summary(points: DataFrame, membership: DataFrame, least: int = 1, panel: DataFrame | None = None, threshold: float = 0.0, tau: float = 0.0) -> DataFrame:
    """Per component: nodes, features, centre, the prior cell of most nodes and its share; largest first.

    With a panel also purity and conflict over the pairs of its features, their relative parts and
    the signal strength after symmetric thresholding; components of one feature have none.
    Equal sizes come by purity, then by component.
    """
    p = points.join(membership, "id")
    cells = p.groupBy("component", "cell").agg(F.count("*").alias("c"))
    top = cells.groupBy("component").agg(F.min(F.struct((-F.col("c")).alias("m"), F.col("cell").alias("cell"))).alias("t"))
    s = p.groupBy("component").agg(F.count("*").alias("n_nodes"), F.countDistinct("feature").alias("n_features"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    s = s.where(F.col("n_nodes") >= least).join(top, "component").select("component", "n_nodes", "n_features", "x", "y", "z", F.col("t.cell").alias("majority_cell"), (-F.col("t.m") / F.col("n_nodes")).alias("majority_share"))
    order = [F.col("n_nodes").desc(), F.col("component")]
    if panel is not None:
        large = p.join(broadcast_if_small(s.select("component")), "component", "left_semi")
        sets = entity.features_of(large, "component")
        scores = entity.relu_scores(entity.purity_conflict(entity.pair_aggregate(sets, panel, threshold, tau)))
        s = s.join(scores.select(F.col("entity").alias("component"), "purity", "conflict", "relative_purity", "relative_conflict", "signal_strength"), "component", "left")
        order.insert(1, F.col("purity").desc_nulls_last())
    return s.orderBy(*order)


# --- triangulation of component centres ----------------------------------------------------------


def component_delaunay(centres: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(a, b, length) of neighbouring components (component, *axes): the Delaunay neighbours of all centres, in the plane or in space."""
    return neighbours(centres.withColumnRenamed("component", "id"), axes)


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise (monotone chains)."""
    p = sorted({(x, y) for x, y in points.tolist()})
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def chain(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


#: Rows of a key that one worker reduces to their hull at a time (about), and rows of a key from which it is dealt out.
HULL_ROWS = 100_000


def hulls(points: DataFrame, key: str, least: int = 3, part_rows: int = HULL_ROWS) -> DataFrame:
    """(polygon, ring) of every key with enough points.

    Keys are dealt out by a hash of the point to parts of about ``part_rows`` rows; the hull of
    the parts' hulls is that of the key, as a vertex of a set is one of every part that holds it.
    """
    kind = dict(points.dtypes)[key]
    named = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(key).alias("polygon"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sizes = named.groupBy("polygon").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") > part_rows))
    large = settle(sizes.select("polygon", F.ceil(F.col("n") / F.lit(part_rows)).alias("m")), "large-keys", compact=True)
    n_large = large.count()
    out = f"polygon {kind}, ring array<struct<x:double,y:double>>"
    row = F.collect_list(F.struct("x", "y")).alias("ring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys are small and many: a batch holds many of them.
        for batch in (b for b in batches if b.num_rows):
            rows = batch.column("ring")
            xy = np.column_stack([c.to_numpy(zero_copy_only=False) for c in rows.flatten().flatten()])
            ends = np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False))
            rings = [hull(part) for part in np.split(xy, ends[:-1])]
            found = np.concatenate(rings)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])
            yield pa.RecordBatch.from_arrays([batch.column("polygon"), pa.ListArray.from_arrays(pa.array(offsets), struct)], ["polygon", "ring"])

    small = named.join(broadcast_if_small(large.select("polygon"), n_large), "polygon", "left_anti") if n_large else named
    rings = small.groupBy("polygon").agg(row).where(F.size("ring") >= least).mapInArrow(run, out)
    if n_large:
        dealt = named.join(broadcast_if_small(large, n_large), "polygon").select("polygon", F.pmod(F.xxhash64("x", "y"), "m").alias("part"), "x", "y")
        rims = dealt.groupBy("polygon", "part").agg(row).select("polygon", "ring").mapInArrow(run, out).select("polygon", F.inline("ring"))
        rings = rings.unionByName(rims.groupBy("polygon").agg(row).mapInArrow(run, out))
    return rings.where(F.size("ring") >= 3)
