"""Tiles: assignment of entities and points, balanced partitions, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitygraph.functions.storage import broadcast_if_small, numbered
from entitygraph.operators.graph import hulls
from entitygraph.operators.spatial_join import nearest_seed, point_in_polygon


def centroids(rows: DataFrame, entity: str = "cell") -> DataFrame:
    return rows.groupBy(F.col(entity).alias("entity")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def tile_assign(centres: DataFrame, nx: int, ny: int) -> DataFrame:
    """Centres with ``tile``: row-major in an nx by ny grid over their extent."""
    box = centres.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c, n: F.least(F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * n)).otherwise(F.lit(0)), F.lit(n - 1))
    return centres.crossJoin(F.broadcast(box)).withColumn("tile", (at("y", ny) * nx + at("x", nx)).cast("int")).drop("x0", "x1", "y0", "y1")


def interior(x: str, y: str, bounds: tuple[str, str, str, str], buffer: float) -> Column:
    """Whether a point is at least ``buffer`` from the nearest edge of its tile (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = (F.col(c) for c in bounds)
    return F.least(F.col(x) - x0, x1 - F.col(x), F.col(y) - y0, y1 - F.col(y)) >= buffer


def z_order(centres: DataFrame) -> DataFrame:
    """Centres with ``_z``: the place of their cell on a Z-order curve over 2^10 by 2^10 cells of their extent."""
    box = centres.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scaled = lambda c: F.least(F.coalesce(F.floor((F.col(c) - F.col(f"{c}0")) / F.nullif(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0)) * 1024), F.lit(0)), F.lit(1023)).cast("long")
    bits = lambda v, shift: sum((F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), 2 * k + shift) for k in range(10)), F.lit(0).cast("long"))
    return centres.crossJoin(F.broadcast(box)).withColumn("_z", bits(scaled("x"), 0) + bits(scaled("y"), 1)).drop("x0", "x1", "y0", "y1")


def balanced_partition(centres: DataFrame, parts: int) -> DataFrame:
    """Centres with ``part``: equal numbers along a Z-order curve of 2^10 by 2^10 cells, so parts are compact.

    Edges are not looked at; :func:`entitygraph.operators.cuts.min_cut_partition` does.
    """
    placed = numbered(z_order(centres), ["_z", "entity"], "_r")
    total = centres.agg(F.count("*").alias("_total"))
    return placed.crossJoin(F.broadcast(total)).withColumn("part", F.floor(F.col("_r") * parts / F.col("_total")).cast("int")).drop("_z", "_r", "_total")


def edge_cuts(edges: DataFrame, parted: DataFrame) -> DataFrame:
    """One row: edges between different parts."""
    p = lambda s: parted.select(F.col("entity").alias(s), F.col("part").alias(f"p_{s}"))
    return edges.join(p("src"), "src").join(p("dst"), "dst").agg(F.sum((F.col("p_src") != F.col("p_dst")).cast("long")).alias("edge_cuts"))


def chunk_points(rows: DataFrame, parted: DataFrame) -> DataFrame:
    """Every point with its part: that of its prior cell, else of the outline that holds it, else of the nearest centre."""
    direct = rows.join(broadcast_if_small(parted.select(F.col("entity").alias("cell"), "part")), "cell", "left")
    rest = direct.where("part is null").drop("part")
    outline = hulls(parted.select("part", "x", "y"), "part")
    found = rest.join(point_in_polygon(rest, outline).withColumnRenamed("polygon", "_p"), "id", "left")
    lost = found.where("_p is null").drop("_p")
    seeds = parted.groupBy("part").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumnRenamed("part", "id")
    near = lost.join(nearest_seed(lost, seeds).select("id", F.col("seed").alias("part")), "id", "left")
    return direct.where("part is not null").unionByName(found.where("_p is not null").withColumnRenamed("_p", "part")).unionByName(near)


def chunk_summary(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("part").agg(F.count("*").alias("n_points"), F.countDistinct("cell").alias("n_cells"))


def disambiguate(rows: DataFrame, tile: str = "tile", label: str = "entity") -> DataFrame:
    """Labels that pipelines number anew in each tile get the tile as prefix."""
    own = F.col(label).startswith("cascade_") | F.col(label).startswith("UNASSIGNED_")
    return rows.withColumn(label, F.when(own, F.concat(F.lit("tile"), F.col(tile), F.lit("_"), F.col(label))).otherwise(F.col(label)))
