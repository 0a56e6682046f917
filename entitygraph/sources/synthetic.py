"""Planted tables for tests: association structures, cells in space, simulated segmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitygraph.operators.components import components
from entitygraph.operators.spatial_join import nearest_centroid, nearest_seed, radius_join


def planted_observations(spark: SparkSession, contexts: int = 1000, features: int = 20, seed: int = 42) -> DataFrame:
    """(cell, feature), every present feature twice: 0 and 1 together in two fifths, 2 and 3 apart in four fifths,
    4 and 5 independent, 6 and 7 rare and never together, 8 and 9 common and never together, the rest at random."""
    rng = np.random.default_rng(seed)
    u = rng.random((contexts, 6))
    present = np.zeros((contexts, features), bool)
    present[:, 0] = present[:, 1] = u[:, 0] < 0.4
    apart = u[:, 1] < 0.8
    present[:, 2], present[:, 3] = apart & (u[:, 2] < 0.5), apart & (u[:, 2] >= 0.5)
    present[:, 4], present[:, 5] = u[:, 3] < 0.3, rng.random(contexts) < 0.3
    present[:, 6], present[:, 7] = u[:, 4] < 0.02, (u[:, 4] >= 0.02) & (u[:, 4] < 0.04)
    present[:, 8], present[:, 9] = u[:, 5] < 0.4, (u[:, 5] >= 0.4) & (u[:, 5] < 0.8)
    present[:, 10:] = rng.random((contexts, features - 10)) < 0.2
    rows = [(f"c{c}", f"g{g:02d}") for c, g in zip(*np.nonzero(present), strict=True) for _ in range(2)]
    return spark.createDataFrame(rows, "cell string, feature string")


def planted_cells(spark: SparkSession, cells: int = 8, per_cell: int = 25, types: int = 3, genes_per_type: int = 4, spacing: float = 12.0, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Points of spherical cells on a grid; each cell expresses the genes of its type, half its points are nuclear.

    ``noise`` is the share of points whose prior cell is unknown.
    """
    rng = np.random.default_rng(seed)
    rows, side = [], int(np.ceil(np.sqrt(cells)))
    for c in range(cells):
        centre = np.array([c % side, c // side, 0.5]) * spacing
        for k in range(per_cell):
            at = centre + rng.normal(0, 1.5, 3)
            gene = f"t{c % types}g{rng.integers(genes_per_type)}"
            known = rng.random() >= noise
            rows.append((c * per_cell + k, f"cell{c}" if known else "-1", gene, *(float(v) for v in at), bool(k % 2 == 0 and known), f"cell{c}"))
    return spark.createDataFrame(rows, "id long, cell string, feature string, x double, y double, z double, nuclear boolean, truth string")


def planted_panel(spark: SparkSession, types: int = 3, genes_per_type: int = 4) -> DataFrame:
    """+1 within a type, -1 across types."""
    genes = [f"t{t}g{g}" for t in range(types) for g in range(genes_per_type)]
    return spark.createDataFrame([(a, b, 1.0 if a[:2] == b[:2] else -1.0) for i, a in enumerate(genes) for b in genes[i + 1 :]], "gi string, gj string, w double")


def voronoi_segmentation(points: DataFrame) -> DataFrame:
    """Prior cells replaced by the nearest true centre in the plane; the truth stays in ``truth``."""
    seeds = points.groupBy(F.col("truth").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    near = nearest_seed(points, seeds).select("id", F.col("seed").alias("cell"))
    return points.drop("cell").join(near, "id")


def nuclear_segmentation(points: DataFrame, merge: float = 1.5, reach: float = 5.0, least: int = 3) -> DataFrame:
    """Cells grown from nuclei: nuclear points linked within ``merge``, groups of ``least`` as seeds, every point to the
    nearest seed within ``reach``, others to -1."""
    nuc = points.where("nuclear")
    links = radius_join(nuc, nuc, merge).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    group = components(links).withColumnsRenamed({"node": "id", "component": "entity"})
    seeds = nuc.join(group, "id").groupBy("entity").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    near = nearest_centroid(points, seeds, reach).select(F.col("src").alias("id"), F.concat(F.lit("nucleus"), F.col("entity")).alias("_cell"))
    return points.drop("cell").join(near, "id", "left").withColumn("cell", F.coalesce("_cell", F.lit("-1"))).drop("_cell")
