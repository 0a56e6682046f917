"""Embedding links and the Jaccard join against brute force."""

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from entitygraph.llm import embedding_links, jaccard_join, registry
from entitygraph.llm.shingles import shingle_sets


def close(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# --- embeddings ---------------------------------------------------------------------------------


def brute_links(vectors):
    ids = list(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    reach = close([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))], ids)
    return {i: (int(near[k].sum()), reach[i]) for k, i in enumerate(ids)}


def clustered(n=400, seed=0, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.25, 0.3], (n, 1))
    x[: n // 3] = centres[0] + rng.normal(size=(n // 3, dims)) * 0.1
    x[5:40] = x[4]
    return {1000 + k: v for k, v in enumerate(x)}


@pytest.mark.parametrize("tile", [2048, 32])
def test_links_equal_brute_force(spark, tile):
    vectors = clustered()
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, rep string, size int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links.link(df, tile=tile).collect()}
    assert got == brute_links(vectors)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 300, 24)))
    x, y = embedding_links.Side.of(u), embedding_links.Side.of(v)
    for q, p, e, f, unit in ((x.q, y.q, x.fine, y.fine, 1), (embedding_links.upper(x.q), embedding_links.upper(y.q), x.coarse, y.coarse, 256)):
        rough = (q.astype(float) @ p.astype(float).T) * (unit * x.scale)[:, None] * unit * y.scale
        assert (np.abs(rough - u @ v.T) <= e[:, None] + f * (1 + e[:, None]) + 1e-12).all()
    assert embedding_links.upper(x.q).dtype == np.int8 and (x.fine < 0.01 * x.coarse).all()


def test_tiles_miss_nothing_and_are_sure_of_nothing_wrong():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(40, 24))[rng.integers(0, 40, 500)] + 0.25 * rng.normal(size=(500, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    side = embedding_links.Side.of(u)
    true = u @ u.T
    i, j, sure = embedding_links.tile_links(side, side, 0.95)
    found = np.zeros(true.shape, bool)
    found[i, j] = True
    assert found[true >= 0.95].all() and (true[i[sure], j[sure]] >= 0.95).all() and (~sure).mean() < 0.01


def test_pairs_at_the_threshold(spark):
    """Cosines within rounding of the threshold are decided on the vectors: 0.95 and its neighbours."""
    rows = [(0, [1.0, 0.0])] + [(k, [c, (1 - c * c) ** 0.5]) for k, c in ((1, 0.95), (2, 0.95 - 1e-9), (3, 0.95 + 1e-9), (4, 0.95 - 1e-6), (5, 0.95 + 1e-6))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    dot, size = x @ x.T, np.sqrt((x * x).sum(1))
    want = (dot >= 0.95 * size[:, None] * size).sum(1) - 1
    assert [r.n_links for r in embedding_links.link(docs).orderBy("vec_id").collect()] == want.tolist()


def test_recall_over_many_vectors(spark):
    """All links of 50,000 vectors, most of them near the threshold, against brute force in blocks."""
    rng = np.random.default_rng(9)
    n, dims = 50_000, 32
    x = rng.normal(size=(n // 8, dims))[rng.integers(0, n // 8, n)] + rng.normal(size=(n, dims)) * rng.choice([0.1, 0.2, 0.24], (n, 1))
    x = np.round(x, 6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[a : a + 2000] @ u.T >= 0.95).sum(1) - 1 for a in range(0, n, 2000)])
    assert embedding_links.plan(n)[0] > 4 and want.sum() > 100_000
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    got = embedding_links.link(df).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    assert (got == want).all()


def test_more_bits_get_more_tables():
    for n in (10, 10_000, 10_000_000, 10**9):
        bits, tables = embedding_links.plan(n)
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** tables <= embedding_links.MISS


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (2, [2.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embedding_links.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 0, None, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((k, 0, k, True) for k in range(3, 10))]


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200, 1e-310])
def test_links_do_not_depend_on_the_scale(spark, scale):
    at = lambda cosine: [cosine, math.sqrt(1 - cosine * cosine)]
    rows = [(1, [1.0, 0.0]), (2, at(0.95 - 1e-9)), (3, [0.0, -1.0]), (4, at(0.95 + 1e-9))]
    df = spark.createDataFrame([(i, [x * scale for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_links.link(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (2, 1)}


def test_different_vectors_under_one_key(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (3, [0.01, 0.99]), (0, [0.02, 0.98])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_links.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 2, 0), (1, 1, 1), (1, 2, 0), (2, 1, 1), (3, 2, 0)]


def test_exact_mode_compares_all_tiles(spark):
    vectors = clustered(300, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links.link(df, tile=64, exact=True).collect()}
    assert got == brute_links(vectors)


def test_building_a_plan_does_not_widen_the_batches_of_others(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        registry.op2_token_counts(spark, sf_dir)
        bounded = int(spark.conf.get(name))
        registry.op1_embedding_links(spark, sf_dir)
        assert int(spark.conf.get(name)) == bounded <= 512
    finally:
        spark.conf.set(name, before)


def test_no_vectors(spark):
    assert embedding_links.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_embedding_query(spark, sf_dir):
    src = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert {r.vec_id: (r.n_links, r.component_id) for r in registry.op1_embedding_links(spark, sf_dir).collect()} == brute_links(src)


# --- texts --------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, pairs = defaultdict(list), set()
    for i, s in sets.items():
        for j, c in _overlaps(s, holders).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                pairs.add((i, j))
        for g in s:
            holders[g].append(i)
    reach = close(pairs, list(sets))
    return {i: (len(s), reach[i]) for i, s in sets.items()}


def _overlaps(s, holders):
    count = defaultdict(int)
    for g in s:
        for j in holders[g]:
            count[j] += 1
    return count


def corpus(seed=0, n=250):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[words[k] for k in rng.integers(0, 400, rng.integers(3, 120))] for _ in range(25)]
    out = {}
    for i in range(n):
        t = list(base[0 if i % 3 == 0 else rng.integers(0, len(base))])
        for _ in range(rng.integers(0, 5)):
            t[rng.integers(0, len(t))] = words[rng.integers(0, 400)]
        out[i + 10] = " ".join(t).upper() if i % 7 == 0 else "\n".join(t)
    return out


@pytest.mark.parametrize("tile", [1024, 16])
def test_join_equals_brute_force(spark, tile):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", None) for i, t in texts.items()], "doc_id long, text string, rep string, n string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, tile=tile).collect()} == brute_join(texts)


def test_search_finds_all_partners():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common, 50, replace=False), rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(60)]
    index = jaccard_join.Inverted(sets)
    for q, s in enumerate(sets):
        want = {d for d, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert set(index.search(index.lists(q), len(s), lambda m: np.ones(len(m), bool)).tolist()) == want


def test_shingle_sets_equal_words():
    texts = ["", " \t\n", "a b", "A b C d", "a b c d e", "a b c d e a b c d e", "x\x0by\x0cz é ß 1 2 3", "a b c d e f"]
    got = shingle_sets(texts)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert set(got[4].tolist()) < set(got[7].tolist()) and set(got[4].tolist()) < set(got[5].tolist())


def test_odd_documents(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, long), (7, long + " end"), (None, "one two"), (8, "one")]
    got = {(r.doc_id or 0): (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (59_996, 6), 7: (59_997, 6), 0: (1, None), 8: (1, 8)}


def test_no_documents(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_join_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op3_jaccard_join(spark, sf_dir).collect()} == brute_join(texts)


@pytest.mark.parametrize("name", ["op1_embedding_links", "op3_jaccard_join"])
def test_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf_dir).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
