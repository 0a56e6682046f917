"""A quality report of cells: purity and conflict of their features, place, size, and a band for each, by tile.

Points are read from the star schema, the panel of association is estimated from all of them, and every
cell is scored against it.  The report is written by tile; a run for some tiles replaces these and no
others.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitygraph.functions import labels as L
from entitygraph.functions.storage import settle
from entitygraph.operators import assoc, entity
from entitygraph.sources import adapters
from jobs.common import command, log, with_defaults

DEFAULTS = {"least_points": 10, "tau": 0.02, "conflict_from": 0.01, "pure_from": 0.5, "tile": 2.0, "tiles": []}


def report(points: DataFrame, c: Mapping[str, Any]) -> DataFrame:
    """(entity, n_points, n_features, x, y, purity, conflict, band, tile) of every cell.

    Bands, in this order: small (few points), conflicted, pure, mixed.  A cell with one feature has no pairs: its
    purity and conflict are null and its band is mixed.
    """
    usable = assoc.exclude_contexts(points)
    # Points are read once: all that follows works on one row a cell and feature.
    total = lambda a: F.sum(a).alias(f"sum_{a}")
    counted = settle(usable.groupBy("cell", "feature").agg(F.count("*").alias("n"), total("x"), total("y"), F.count("x").alias("n_x"), F.count("y").alias("n_y")), "counted")
    panel = settle(assoc.centred_panel(assoc.association(assoc.pairs(counted.where("n >= 2").select("cell", "feature")))), "panel", compact=True)
    scored = entity.purity_conflict(entity.pair_aggregate(entity.features_of(counted, "cell"), panel, 0.0, c["tau"]))
    mean = lambda a: (F.sum(f"sum_{a}") / F.nullif(F.sum(f"n_{a}"), F.lit(0))).alias(a)
    cells_only = L.etype_of_label("cell").isin("cell", "partial", "component") & ~F.col("cell").isin("DROP", "nan")
    placed = counted.where(cells_only).groupBy(F.col("cell").alias("entity")).agg(F.sum("n").alias("n_points"), mean("x"), mean("y"))
    value = lambda name: (F.round(F.col(name) + 1e-9, 6) + 0.0).alias(name)
    cells = placed.join(scored, "entity").select("entity", "n_points", F.col("k").alias("n_features"), *(value(v) for v in ("x", "y", "purity", "conflict")))
    few, conflicted, pure = F.col("n_points") < c["least_points"], F.col("conflict") >= c["conflict_from"], F.col("purity") >= c["pure_from"]
    tile = F.concat_ws(":", *(F.floor(F.col(a) / c["tile"]).cast("string") for a in ("x", "y")))
    return cells.withColumns({"band": F.when(few, "small").when(conflicted, "conflicted").when(pure, "pure").otherwise("mixed"), "tile": tile})


def summary(cells: DataFrame) -> DataFrame:
    """(tile, band, n_cells, n_points, purity, conflict): numbers and means of a tile's bands."""
    mean = lambda name: (F.round(F.avg(name) + 1e-9, 6) + 0.0).alias(name)
    return cells.groupBy("tile", "band").agg(F.count("*").alias("n_cells"), F.sum("n_points").alias("n_points"), mean("purity"), mean("conflict"))


def write_by_tile(table: DataFrame, path: str, some: bool) -> None:
    """Replace the tiles of ``table`` only (``some``), or everything; a crowded tile is written by several tasks."""
    mode = "dynamic" if some else "static"
    table.repartitionByRange("tile", *(c for c in ("entity", "band") if c in table.columns)).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("tile").parquet(path)


def run(spark: SparkSession, tables: str, out: str, config: Mapping[str, Any] | None = None) -> dict[str, int]:
    """Write ``out``/cells and ``out``/summary, partitioned by tile, from the star schema in ``tables``; returns what was read and written."""
    c = with_defaults(config, DEFAULTS)
    points = adapters.points(spark, tables)
    n_points = points.count()
    log.info("cell_report: read %d points of %s", n_points, tables)
    cells = report(points, c)
    if c["tiles"]:
        cells = cells.where(F.col("tile").isin(*c["tiles"]))
    write_by_tile(cells, f"{out}/cells", bool(c["tiles"]))
    # Tile names are text, whatever they look like.
    written = spark.read.schema(cells.schema).parquet(f"{out}/cells")
    mine = written.where(F.col("tile").isin(*c["tiles"])) if c["tiles"] else written
    write_by_tile(summary(mine), f"{out}/summary", bool(c["tiles"]))
    n_cells = mine.count()
    log.info("cell_report: wrote %d cells to %s/cells", n_cells, out)
    return {"points": n_points, "cells": n_cells}


if __name__ == "__main__":
    command("cell_report", "Score the cells of a point table and report them by tile.", {"tables": "folder of the star schema (lineitem, orders, part)", "out": "folder of the report"}, run)
