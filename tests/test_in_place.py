"""Stages that leave rows where they are: written seldom, files replaced are deleted, results as by id."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest

from entitygraph.functions.storage import at_hand, settle, shared_folder
from entitygraph.operators import kernels, stages
from entitygraph.plans import pipeline

COLUMNS = "id long, cell string, feature string, x double, y double, z double, nuclear boolean, entity string, etype string"


def table(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    data = []
    for k in range(n):
        cell = "-1" if k % 11 == 0 else f"c{int(r.integers(6))}"
        free = cell == "-1" or r.random() < 0.3
        feature = None if k % 97 == 5 else f"g{int(r.integers(7))}"
        data.append((k, cell, feature, float(r.integers(8)), float(r.integers(8)), None if k % 89 == 7 else float(r.integers(4)), bool(r.integers(2)), "-1" if free else cell, "unknown" if free else "cell"))
    return spark.createDataFrame(data, COLUMNS)


def panel_of(spark, seed=4):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(f"g{i}", f"g{j}", float(np.round(r.normal(0.1, 0.3), 3))) for i in range(6) for j in range(i + 1, 6)], "gi string, gj string, w double")


def labels(df):
    return {r.id: (r.entity, r.etype) for r in df.select("id", "entity", "etype").collect()}


def folders(spark, name):
    return [f for f in os.listdir(urlparse(shared_folder(spark)).path) if f.startswith(name)]


def test_rows_are_written_seldom_and_replaced_files_go(spark):
    run = pipeline.Run(settle(table(spark), "begun"))
    want, n = table(spark), len(folders(spark, "begun"))
    for k in range(8):
        run.step(f"Inplace {k}", lambda rows, k=k: stages.size_qc(rows, 35 + 3 * k))
        want = stages.size_qc(want, 35 + 3 * k)
    assert labels(run.rows) == labels(want) != labels(table(spark))
    assert len(folders(spark, "inplace")) == 1 and len(folders(spark, "begun")) == n - 1
    assert [p["n_unassigned"] for p in run.progression] == sorted(p["n_unassigned"] for p in run.progression)


@pytest.mark.parametrize("nuclear", [True, False])
def test_prune_by_groups(spark, nuclear):
    rows, panel = settle(table(spark), "rows"), stages.Panel(panel_of(spark))
    one, many = (stages.prune(rows, panel, nuclear, 0.0, 0.0, grouped=g) for g in (False, True))
    assert labels(one) == labels(many) and at_hand(many) and not at_hand(one)
    assert len({e for e, _ in labels(one).values()}) > 3
    one, many = settle(one, "one"), settle(many, "many")
    assert labels(stages.reassign(one, panel, 0.0, grouped=True)) == labels(stages.reassign(many, panel, 0.0))


@pytest.mark.parametrize(("peers", "shield"), [(None, "entity"), (1, "entity"), (1, "exclude")])
def test_rescue_pass(spark, monkeypatch, peers, shield):
    rows, panel = settle(table(spark), "rows"), panel_of(spark)
    rule = kernels.Admission(mean_threshold=0.1)
    args = (panel, 1.0, rule, "witness", None, 3, 2, 2, "gene_fit", peers, shield)
    after, n = stages.rescue_pass(rows, *args)
    assert at_hand(after)
    monkeypatch.setattr(stages, "GATE_ROWS", 5)  # points are paired
    taken = settle(stages.rescue(rows, *args), "taken")
    assert labels(after) == labels(stages.apply_rescue(rows, taken)) and n == taken.count() > 0


def test_cascade_in_place(spark):
    rows, panel = settle(table(spark), "rows"), stages.Panel(panel_of(spark))
    got = stages.apply_cascade(rows, panel, 1.0, None, None, 1, -0.2)
    want = stages.density_cascade(rows, panel, 1.0, threshold=-0.2)
    assert at_hand(got) and labels(got) == labels(rows) | labels(want) and want.count() > 0


def test_gaps_of_rows_without_a_number(spark):
    nan = float("nan")
    data = [(k, "a", "g1", 0.0, 0.0, z, True, "a", "cell") for k, z in enumerate([0.0, 0.0, 1.0, 9.0, 9.0, nan, nan, 9.5])] + [(20, "a", "g1", 0.0, 0.0, None, True, "a", "cell"), (21, "a", "g1", 0.0, 0.0, 9.0, True, "a", "unknown")]
    got = {i: e for i, (e, _) in labels(stages.z_gap_split(settle(spark.createDataFrame(data, COLUMNS), "rows"), 2.0, 1)).items()}
    assert got == {0: "a", 1: "a", 2: "a", 3: "a-1", 4: "a-1", 7: "a-1", 5: "a-2", 6: "a-3", 20: "a", 21: "a"}
