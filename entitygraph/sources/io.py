"""Readers, normalization of point tables, and writers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitygraph.operators.assoc import as_flag

#: Names that platforms give to the point columns (fixed values).
RENAMES = {"x_location": "x", "y_location": "y", "z_location": "z", "feature_name": "feature", "cell_id": "cell", "transcript_id": "id", "overlaps_nucleus": "nuclear", "is_nuclear": "nuclear", "fov_name": "fov"}


def discover(project: str | Path) -> tuple[Path, Path | None]:
    """The point file of a project folder and its panel: ``data/*.parquet`` (one, or the one named like the folder)
    and the first ``npmi_bs*.csv`` by name, if any."""
    project = Path(project)
    found = sorted((project / "data").glob("*.parquet"))
    if len(found) > 1:
        found = [p for p in found if project.name in p.name]
    if len(found) != 1:
        raise FileNotFoundError(f"expected one parquet file in {project / 'data'}, found {len(found)}")
    panels = sorted([*project.glob("npmi_bs*.csv"), *(project / "data").glob("npmi_bs*.csv")], key=lambda p: p.name)
    return found[0], panels[0] if panels else None


def load_points(spark: SparkSession, project: str | Path | None = None, parquet: str | None = None) -> DataFrame:
    """The point table of a project folder or of a parquet path, one of which must be given."""
    if (project is None) == (parquet is None):
        raise ValueError("give either a project folder or a parquet path")
    return spark.read.parquet(str(discover(project)[0]) if parquet is None else parquet)


def renamed(df: DataFrame, names: dict[str, str] = RENAMES) -> DataFrame:
    """Only the known columns, under the library's names; the projection reaches the scan."""
    return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns if names.get(c, c) in {*names.values(), "x", "y", "z", "qv", "id", "cell", "feature", "entity", "etype"}))


def normalize(df: DataFrame) -> DataFrame:
    """Points with text labels, NaN as null, whole-number ids and boolean flags; applying it again changes nothing."""
    out = renamed(df)
    kinds = dict(out.dtypes)
    change: dict[str, Column] = {}
    for c in ("feature", "cell", "fov", "entity", "etype"):
        if c in kinds:
            change[c] = F.col(c).cast("string")
    for c in ("x", "y", "z"):
        if c in kinds:
            v = F.col(c).cast("double")
            change[c] = F.when(~F.isnan(v), v)
    if "nuclear" in kinds:
        change["nuclear"] = as_flag("nuclear", kinds["nuclear"])
    if "id" in kinds and kinds["id"] not in ("string", "bigint"):
        change["id"] = F.col("id").cast("bigint")
    if "z" not in kinds:
        change["z"] = F.lit(0.0)
    return out.withColumns(change)


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path, schema="gene_i string, gene_j string, value double") if not path.endswith(".parquet") else read_panel_parquet(spark, path)


def read_panel_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumnsRenamed({"value": "NPMI"})


def from_molecules(df: DataFrame, nuclear_from: float = 0.9) -> DataFrame:
    """Segmented molecule tables (x_um, y_um, z_um, gene, cell, confidence, ...): cells without a number are unassigned.

    Assignments at least ``nuclear_from`` confident count as nuclear.
    """
    pick = lambda *names: next((F.col(n) for n in names if n in df.columns), F.lit(None))
    cell = pick("cell", "cell_id").cast("string")
    return df.select(
        pick("molecule_id", "id").cast("bigint").alias("id"),
        pick("gene", "feature_name").cast("string").alias("feature"),
        F.when(cell.isNull() | cell.isin("", "0", "nan", "NA"), "-1").otherwise(cell).alias("cell"),
        pick("x_um", "x").cast("double").alias("x"),
        pick("y_um", "y").cast("double").alias("y"),
        F.coalesce(pick("z_um", "z").cast("double"), F.lit(0.0)).alias("z"),
        F.coalesce(pick("assignment_confidence", "confidence").cast("double") >= nuclear_from, F.lit(False)).alias("nuclear"),
    )


def polygons_of(vertices: DataFrame, key: str = "cell", least: int = 3) -> DataFrame:
    """(polygon, ring) from boundary vertices (cell, order, x, y) in their order; outlines of fewer vertices are left out."""
    rings = vertices.groupBy(F.col(key).alias("polygon")).agg(F.sort_array(F.collect_list(F.struct("order", "x", "y"))).alias("v"))
    return rings.where(F.size("v") >= least).select("polygon", F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("ring"))


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_chunks(chunked: DataFrame, path: str) -> None:
    """One folder a part, written by all tasks that hold rows of it."""
    write_parquet(chunked, path, "part")


def write_json(value: object, path: str | Path) -> None:
    """Small driver-side records: receipts, summaries."""
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str))


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A report table of a small result; of more than ``most`` rows, the last line says that some are left out."""
    found = rows.limit(most + 1).collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    lines = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found[:most]]
    return "\n".join([head, *lines, *([f"(more than {most} rows; the rest is left out)"] if len(found) > most else [])])
