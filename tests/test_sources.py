"""Readers, writers and predicates that pipelines rest on."""

import json

from pyspark.sql import functions as F

from entitygraph.functions import labels
from entitygraph.operators import entity, spatial_join, tiling
from entitygraph.sources import io


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_panels_and_molecules(spark, tmp_path):
    panel = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.25)], "gene_i string, gene_j string, value double")
    io.write_csv(panel, f"{tmp_path}/panel.csv")
    assert rows_of(io.read_panel_csv(spark, f"{tmp_path}/panel.csv")) == rows_of(panel)
    io.write_parquet(panel, f"{tmp_path}/panel.parquet")
    assert io.read_panel_csv(spark, f"{tmp_path}/panel.parquet").columns == ["gene_i", "gene_j", "NPMI"]
    assert rows_of(io.read_panel_parquet(spark, f"{tmp_path}/panel.parquet")) == rows_of(panel)
    raw = spark.createDataFrame([(7, "g1", "12", 1.0, 2.0, 3.0, 0.95), (8, "g2", "0", 1.5, 2.5, None, 0.2), (9, "g3", None, 0.0, 0.0, 1.0, None)], "molecule_id int, gene string, cell string, x_um double, y_um double, z_um double, assignment_confidence double")
    assert rows_of(io.from_molecules(raw)) == [(7, "g1", "12", 1.0, 2.0, 3.0, True), (8, "g2", "-1", 1.5, 2.5, 0.0, False), (9, "g3", "-1", 0.0, 0.0, 1.0, False)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0), (2, "y", 1), (3, "z", 1)], "id long, name string, part int")
    io.write_chunks(df, f"{tmp_path}/chunks")
    assert rows_of(spark.read.parquet(f"{tmp_path}/chunks/part=1").select("id", "name")) == [(2, "y"), (3, "z")]
    io.write_chunks(df.where("part = 0"), f"{tmp_path}/chunks")
    assert rows_of(spark.read.parquet(f"{tmp_path}/chunks").select("id", "name", "part")) == [(1, "x", 0)]
    io.write_json({"b": 1, "a": [1, 2]}, f"{tmp_path}/receipt.json")
    assert json.loads((tmp_path / "receipt.json").read_text()) == {"a": [1, 2], "b": 1}
    assert io.markdown_table(df.orderBy("id").limit(1)) == "| id | name | part |\n|---|---|---|\n| 1 | x | 0 |"
    assert io.markdown_table(df, 2).endswith("(more than 2 rows; the rest is left out)") and "left out" not in io.markdown_table(df, 3)


def test_predicates_bands_and_tiles(spark):
    named = spark.createDataFrame([("12",), ("12-1",), ("12-1-2",), ("UNASSIGNED_3",), ("-1",), ("DROP",), (None,)], "entity string")
    found = {r.entity: (r.w, r.p) for r in named.select("entity", labels.whole_cell("entity").alias("w"), labels.partial("entity").alias("p")).collect()}
    assert (found["12"], found["12-1"], found["12-1-2"]) == ((True, False), (False, True), (False, True))
    assert not any(any(bool(v) for v in found[e]) for e in ("UNASSIGNED_3", "-1", "DROP"))
    values = spark.createDataFrame([("f", 1.0), ("f", 2.0), ("f", 3.5), ("g", 2.0)], "feature string, v double")
    bands = spark.createDataFrame([("f", 1.5, 3.5), ("g", 3.0, 4.0)], "feature string, lo double, hi double")
    assert rows_of(spatial_join.within_band(values, bands, "v").select("feature", "v")) == [("f", 2.0), ("f", 3.5)]
    tiles = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.5, 5.0), (3, 9.0, 9.0)], "id int, x double, y double").withColumns({c: F.lit(v) for c, v in (("x0", 0.0), ("x1", 10.0), ("y0", 0.0), ("y1", 10.0))})
    assert [r.id for r in tiles.where(tiling.interior("x", "y", ("x0", "x1", "y0", "y1"), 1.0)).orderBy("id").collect()] == [1, 3]
    rows = spark.createDataFrame([(0, "cascade_1-1"), (1, "UNASSIGNED_2"), (1, "77-1"), (1, "-1")], "tile int, entity string")
    assert rows_of(tiling.disambiguate(rows)) == [(0, "tile0_cascade_1-1"), (1, "-1"), (1, "77-1"), (1, "tile1_UNASSIGNED_2")]


def test_single_features_count_as_zero(spark):
    sets = spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "b")], "entity string, feature string")
    panel = spark.createDataFrame([("a", "b", 0.5)], "gi string, gj string, w double")
    scored = entity.purity_conflict(entity.pair_aggregate(sets, panel), single=0.0)
    assert {r.entity: (r.purity, r.conflict) for r in scored.collect()} == {"one": (0.0, 0.0), "two": (1.0, 0.0)}
