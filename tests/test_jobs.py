"""The jobs on growing copies, after failures, by tile, and from the command line."""

import itertools
import logging
import math
import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from jobs import cell_report, queries, word_panel
from jobs.common import read_config, with_defaults

TABLES = "lineitem orders part documents benchmark".split()


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sorted(want.select(*sorted(want.columns)).fetchall(), key=str)


def texts_and_panel(texts, known, evidence):
    """(gi, gj, k_ij, k_i, k_j, n, tier) by counting."""
    held = [sorted(known & {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()}) for t in texts]
    held = [h for h in held if h]
    one, two = Counter(itertools.chain(*held)), Counter(p for h in held for p in itertools.combinations(h, 2))
    out, n = [], len(held)
    for i, j in itertools.combinations(sorted(one), 2):
        expected = one[i] * one[j] / n
        if two[i, j] or expected >= evidence:
            tier = "neg_one" if not two[i, j] else "bootstrap" if max(two[i, j], expected) >= evidence else "low_evidence"
            out.append((i, j, two[i, j], one[i], one[j], n, tier))
    return sorted(out)


@pytest.fixture
def place(spark, tmp_path):
    """A vocabulary, and two lots of documents: some without words, some null, ids that repeat and are null."""
    words = spark.createDataFrame([("red green",), ("red blue",), ("Red x",), ("blue green",)], "text string")
    words.write.parquet(f"{tmp_path}/words")
    first = [(1, "red green green"), (1, "Red, blue!"), (None, "red"), (2, None), (3, ""), (4, "grey")]
    second = [(5, "green blue"), (1, "red green"), (6, "blue blue"), (7, "nothing here")]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/lot{k}")
    os.mkdir(f"{tmp_path}/docs")

    def arrive(k):
        for f in os.listdir(f"{tmp_path}/lot{k}"):
            if f.endswith(".parquet"):
                # Copies keep an old time, as some tools do.
                shutil.copy(f"{tmp_path}/lot{k}/{f}", f"{tmp_path}/docs/{k}-{f}")
                os.utime(f"{tmp_path}/docs/{k}-{f}", (10**9, 10**9 + 10**6 * (1 - k)))

    run = lambda **config: word_panel.run(spark, f"{tmp_path}/docs", f"{tmp_path}/words", f"{tmp_path}/out", f"{tmp_path}/check", {"vocabulary_size": 3, "evidence": 1.0, **config})
    read = lambda: sorted(tuple(r[c] for c in ("gi", "gj", "k_ij", "k_i", "k_j", "n", "tier")) for r in spark.read.parquet(f"{tmp_path}/out/panel").collect())
    return arrive, run, read, [t for _, t in first], [t for _, t in second]


KNOWN = {"red", "green", "blue"}


def test_two_runs_over_growing_documents(place, caplog):
    caplog.set_level(logging.INFO, "jobs")
    arrive, run, read, first, second = place
    arrive(0)
    assert run()["rows"] == 6 and read() == texts_and_panel(first, KNOWN, 1.0)
    assert run() == {"batches": 0, "rows": 0, "pairs": len(read())}
    arrive(1)
    took = run()
    assert (took["batches"], took["rows"]) == (1, 4)
    assert read() == texts_and_panel(first + second, KNOWN, 1.0)
    assert "read 4 new rows" in caplog.text and "vocabulary of" in caplog.text and f"wrote {took['pairs']} pairs" in caplog.text


def test_a_batch_that_failed_is_taken_again(place, monkeypatch):
    arrive, run, read, first, second = place
    arrive(0)
    arrive(1)
    plain, calls = word_panel.counts, []

    def failing(docs, vocabulary):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return plain(docs, vocabulary)

    monkeypatch.setattr(word_panel, "counts", failing)
    with pytest.raises(Exception, match="lost"):
        run(files_per_batch=1)
    monkeypatch.setattr(word_panel, "counts", plain)
    run(files_per_batch=1)
    assert read() == texts_and_panel(first + second, KNOWN, 1.0)


def test_the_vocabulary_stays_that_of_the_first_run(spark, place, tmp_path):
    arrive, run, read, first, second = place
    arrive(0)
    run()
    spark.createDataFrame([("grey nothing here",)] * 9, "text string").write.mode("overwrite").parquet(f"{tmp_path}/words")
    arrive(1)
    run()
    assert read() == texts_and_panel(first + second, KNOWN, 1.0)


def test_panel_values(spark):
    found = spark.createDataFrame([(None, None, 10), ("a", "a", 5), ("b", "b", 4), ("a", "b", 3), ("c", "c", 6)], word_panel.COUNTS)
    rows = {(r.gi, r.gj): r for r in word_panel.panel_of(found, 2.5).collect()}
    assert rows["a", "b"].pmi == pytest.approx(math.log(3 * 10 / 20), abs=1e-6)
    assert (rows["a", "c"].npmi, rows["a", "c"].tier, rows["a", "c"].pmi) == (-1.0, "neg_one", None)
    assert ("b", "c") not in rows  # expected 2.4 times


def test_report_by_tile(spark, sf_dir, tmp_path):
    out = f"{tmp_path}/report"
    cell_report.run(spark, sf_dir, out, {"tile": 1.0, "conflict_from": 0.05})
    cells = "entity string, n_points long, n_features long, x double, y double, purity double, conflict double, band string, tile string"
    read = lambda: {r.entity: r for r in spark.read.schema(cells).parquet(f"{out}/cells").collect()}
    before = read()
    tiles = Counter(r.tile for r in before.values())
    assert len(tiles) > 3 and len({r.band for r in before.values()}) > 1
    some = max(tiles, key=tiles.get)
    took = cell_report.run(spark, sf_dir, out, {"tile": 1.0, "conflict_from": 0.05, "least_points": 10**6, "tiles": [some]})
    after = read()
    assert took["cells"] == tiles[some] and after.keys() == before.keys()
    assert all(r.band == "small" if r.tile == some else r == before[e] for e, r in after.items())
    summary = spark.read.schema("band string, n_cells long, n_points long, purity double, conflict double, tile string").parquet(f"{out}/summary").collect()
    assert sum(r.n_cells for r in summary) == len(before) and {r.tile for r in summary} == set(tiles)
    assert {r.band for r in summary if r.tile == some} == {"small"}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_settings():
    assert with_defaults({"tile": 3}, cell_report.DEFAULTS)["tile"] == 3
    for bad in ({"tiel": 3}, {"tile": "x"}, {"least_points": True}):
        with pytest.raises(ValueError):
            with_defaults(bad, cell_report.DEFAULTS)


def test_config_files_hold_the_defaults(spark):
    for job in (word_panel, cell_report):
        assert with_defaults(read_config(spark, job.__file__.replace(".py", ".toml")), job.DEFAULTS) == job.DEFAULTS


def test_command_line(sf_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = ["--documents", f"{sf_dir}/documents.parquet", "--vocabulary", f"{sf_dir}/benchmark.parquet", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/check", "--config", f"{root}/jobs/word_panel.toml"]
    done = subprocess.run([sys.executable, "-m", "jobs.word_panel", *args], cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 new rows" in done.stderr and os.path.isdir(f"{tmp_path}/out/panel/tier=bootstrap")


def test_the_cell_report_reads_its_points_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for f in batches:
            read.add(len(f))
            yield f

    rows = [(k, str(k % 3), "abc"[k % 2 + k // 7 % 2], float(k), 0.5 * k, 0.0) for k in range(40)] + [(99, "DROP", "a", 1.0, 1.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, cell string, feature string, x double, y double, z double")
    got = {r.entity: r for r in cell_report.report(points.mapInPandas(seen, points.schema), cell_report.DEFAULTS).collect()}
    assert read.value == len(rows)
    assert {e: (r.n_points, r.x, r.y) for e, r in got.items()} == {str(c): (len(range(c, 40, 3)), sum(range(c, 40, 3)) / len(range(c, 40, 3)), sum(range(c, 40, 3)) / len(range(c, 40, 3)) / 2) for c in range(3)}
