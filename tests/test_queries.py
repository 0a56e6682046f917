"""Every registered query that has SQL against DuckDB at the smallest scale; the rest return rows."""

import duckdb
import pytest

from entitygraph.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def table(frame):
    c = sorted(frame.columns)
    rows = [tuple(None if v is None or v != v else v for v in r) for r in frame[c].itertuples(index=False)]
    return c, sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, sf_dir, db, name):
    got, want = table(Q.QUERIES[name](spark, sf_dir).toPandas()), table(db.sql(Q.SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_returns_rows(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize(("name", "plan", "passes"), [("pipeline_seg", "segmented", (3, 3, 3)), ("pipeline_noseg", "unsegmented", (3, 5, 3))])
def test_pipelines_run_all_passes_over_all_points(spark, sf_dir, monkeypatch, name, plan, passes):
    def run(points, panel, cfg):
        assert points.count() == Q._points(spark, sf_dir).count()
        assert (cfg.rescue.passes, cfg.rescue.post_group_passes, cfg.final_rescue.passes) == passes
        return Q.pipeline.Run(points.withColumns({"entity": points.cell, "etype": points.cell}))

    monkeypatch.setattr(Q.pipeline, plan, run)
    assert Q.QUERIES[name](spark, sf_dir).columns == ["id", "cell", "entity", "etype"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 300
    assert set(entry.oracle_sql()) <= set(entry.queries())
