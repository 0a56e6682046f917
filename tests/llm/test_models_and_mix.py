"""Language identification, quality classifier, source mixing and the pipeline."""

import re
import zlib

import numpy as np
import pytest

from entitygraph.llm import language_id, quality_classifier, registry, source_mix

SF = "/root/testdata/sf0.01"


def rows_of(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet")


def test_language_accuracy(spark):
    true = {r.doc_id: r.lang for r in rows_of(spark, "documents").collect()}
    got = registry.op6_language_id(spark, SF).collect()
    assert len(got) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.98


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en")] * 20 + [("der hund und die katze", "de")] * 20)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    ask = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 !!", 0), (4, "the mat", 0), (5, "und die " * 100_000, 0), (None, "der hund", 0)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(ask, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "de" and got[None][0] == "de"
    blank = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(ask, blank).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).collect() == []


def grams(text):
    """The distinct 1- to 3-grams of a text's symbols, plainly."""
    s = [c if c.isalpha() else "" for c in text.lower()]
    return {tuple(s[i : i + k]) for k in (1, 2, 3) for i in range(len(s) - k + 1)}


def test_kernel_equals_brute_force():
    texts = ["The cat, the mat", "der Hund 7", "日本語 と 中文", "", "a", "привет мир", "čeština áé", "the cat " * 50]
    codes = [language_id.codes_of(t) for t in texts]
    sets = [grams(t) for t in texts]
    assert [len(c) for c in codes] == [len(s) for s in sets]  # no two of these n-grams share a code
    model = language_id.fit([("x", c) for c in codes], per_language=len(texts))
    want = [[len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(model.kernel(codes), want, atol=1e-6)


def test_prediction_equals_plain_ridge_regression():
    """With all rows as landmarks the features are exact: primal weights give the plain weighted kernel ridge regression."""
    words = {"en": "the cat sat on a mat and looked at some other cat", "de": "der hund und die katze liegen auf der matte", "fr": "le chat est sur le tapis et regarde"}
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(w.split(), 6))) for k, w in words.items() for _ in range(5)]
    coded = [(k, language_id.codes_of(t)) for k, t in rows]
    model = language_id.fit(coded, per_language=5)
    sets = [grams(t) for _, t in rows]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if j == lang else -1.0 for lang in sorted(words)] for j, _ in rows])
    # All classes are of one size, so the weights of rows are all 1/5.
    dual = np.linalg.solve(k / 5 + language_id.RIDGE * np.eye(len(k)), y / 5)
    for t in ("the mat", "die matte", "le tapis est", "cat katze chat"):
        want = np.array([kernel(grams(t), s) for s in sets]) @ dual
        got = (model.kernel([language_id.codes_of(t)]) @ model.weights)[0]
        assert np.allclose(got, want, atol=1e-3) and model.predict([t])[0] == [sorted(words)[int(want.argmax())]]


def test_scripts_stay_apart(spark):
    """Scripts of many letters and languages told by what comes late in long texts."""
    rng = np.random.default_rng(0)
    han, hangul = ["".join(map(chr, rng.integers(0x4E00, 0x5200, 400))) for _ in range(2)], "".join(map(chr, rng.integers(0xAC00, 0xB000, 400)))
    late = "abc " * 8000
    rows = [(k, t, lang) for k, (t, lang) in enumerate([(h[i : i + 60], f"han{n}") for n, h in enumerate(han) for i in range(0, 300, 10)] + [(hangul[i : i + 60], "hangul") for i in range(0, 300, 10)] + [(late + "der hund", "de")] * 9 + [(late + "the cat", "en")] * 9)]
    model = language_id.train(spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, lang string"))
    assert model.predict([han[0][150:200], han[1][150:200], hangul[150:200], late + "the cat"])[0] == ["han0", "han1", "hangul", "en"]
    with pytest.raises(ValueError, match="distinct values"):
        language_id.train(spark.range(1100).selectExpr("id as doc_id", "'a' as text", "cast(id as string) as lang"))


def test_quality_accuracy(spark):
    label = {r.doc_id: r.quality for r in rows_of(spark, "labels").collect()}
    got = registry.op10_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.95


def test_quality_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (200, 4)), rng.normal(0.7, 2, (150, 4)) @ rng.normal(size=(4, 4))])
    y = np.repeat([0, 1], [200, 150])
    model = quality_classifier.fit(x, y, (0.4, 0.6))
    logs = []
    for k, prior in ((0, 0.4), (1, 0.6)):
        own, scale = x[y == k], x.var(0) + 1e-6
        s = np.cov(own.T)
        lam = max(quality_classifier.SHRINKAGE, 4 / (4 + len(own)))
        cov = (1 - lam) * s + lam * np.diag(0.1 * scale + 0.9 * np.minimum(np.diag(s), scale)) + 1e-4 * np.diag(scale)
        d = x - own.mean(0)
        logs.append(np.log(prior) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_variety_does_not_depend_on_length():
    from entitygraph.llm.doc_stats import MEASURES, measure

    at = lambda t: dict(zip(MEASURES, measure(t), strict=True))
    vary = lambda t: at(t)["n_window_distinct"] / at(t)["n_window_words"]
    circle = " ".join(f"w{k % 12}" for k in range(2000))
    clean = " ".join(f"w{k}" for k in range(2000))
    assert vary(circle) == pytest.approx(0.2) and vary(clean) == 1.0 and at("a b a")["n_window_distinct"] == 2 and at("")["n_window_words"] == 0
    words = [f"w{k}" for k in np.random.default_rng(0).integers(0, 40, 150)]
    assert at(" ".join(words))["n_window_distinct"] == sum(len(set(words[a : a + 60])) for a in (0, 60, 90))


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "word " * 100_000, 0.1), (None, "a b c", 0.1), (1, None, 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, none)
    assert [r.score for r in quality_classifier.score(docs, model).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 0, None), (3, None, 0), (None, 1, 0), (9, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score(docs.where("false"), model).collect() == []


# --- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, open_, done = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(done.values())
        share = {s: w[s] * left / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return done


def check_mix(rows, texts):
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id][1] or ""))
        assert 0 <= r.taken <= 2 * r.size
        s = texts[r.doc_id][0]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
    want = brute_targets(sizes)
    for r in rows:
        s = texts[r.doc_id][0]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=6)


def test_mix_query(spark):
    texts = {r.doc_id: (r.source, r.text) for r in rows_of(spark, "documents").collect()}
    rows = registry.op7_source_mix(spark, SF).collect()
    assert len(rows) == len(texts)
    check_mix(rows, texts)
    assert sorted(rows) == sorted(registry.op7_source_mix(spark, SF).collect())


def test_mix_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, size, source_size, round(target, 6), taken from ({source_mix.SQL})").fetchall()}
    assert {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in registry.op7_source_mix(spark, SF).collect()} == want


def test_mix_of_odd_rows(spark):
    data = [(1, "a", "x " * 30_000), (2, "a", None), (3, None, "y z"), (4, "b", ""), (5, "c", "p q r s t"), (6, "a", "one"), (7, "d", "u v w")]
    docs = spark.createDataFrame([(i, s, t, 1) for i, s, t in data], "doc_id long, source string, text string, size int")
    made = source_mix.mix(docs)
    rows = made.taken.collect()
    assert len(rows) == 7
    check_mix(rows, {i: (s, t) for i, s, t in data})
    slots = made.schedule.collect()
    assert len({r.slot for r in slots}) == len(slots)
    assert source_mix.mix(docs.where("false")).taken.collect() == []
    twice = source_mix.mix(docs.where("doc_id in (5, 7)").unionByName(docs.where("doc_id = 5"))).taken.collect()
    assert len(twice) == 3 and all(r.taken <= 2 * r.size for r in twice)


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "w " * 50) for k in range(300)], "doc_id long, source string, text string")
    slots = sorted(source_mix.mix(docs).schedule.select("slot", "source").collect())
    n = len(slots)
    for s in ("s0", "s1", "s2"):
        all_ = sum(r.source == s for r in slots) / n
        for a in range(0, n - 1000, 1000):
            assert abs(sum(r.source == s for r in slots[a : a + 1000]) / 1000 - all_) < 0.02


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = rows_of(spark, "documents").withColumns({"_copies": pipeline.F.lit(1), "_score": pipeline.F.lit(2)})
    names = docs.columns
    before = docs
    for name, stage in pipeline.STAGES:
        after = pipeline.settle(stage(spark, before, SF), name)
        if name != "bpe":
            assert after.columns == names
            if name != "source_mix":
                assert after.count() <= before.count()
        before = after
    assert {"doc_id", "n_tokens", "ids", "decoded"} <= set(before.columns)
    kept = {r.doc_id for r in before.collect()}
    one = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in pipeline.run(spark, SF).collect()}
    assert set(one) == kept


def test_pipeline_of_no_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows_of(spark, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    rows_of(spark, "labels").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_of_repeated_rows_and_null_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = [" ".join(f"{a}{k}" for k in range(60)) for a in "pqrst"]
    rows = [(1, text[0], "a"), (1, text[0], "b"), (1, text[1], "a"), (2, text[0] + " end", "a"), (3, text[0], "a"), (None, text[2], "a"), (None, text[2], "a"), (None, text[3], "a"), (4, None, "a"), (5, "", "a"), (5, "", "a"), (6, text[4] * 40, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = pipeline.keep_one_of_each_group(spark, docs, "").collect()
    got = sorted(((r.doc_id or 0), r.text or "") for r in kept)
    assert got == sorted([(0, text[2]), (0, text[3]), (1, text[0]), (1, text[1]), (4, ""), (5, ""), (6, text[4] * 40)])
    mixed = pipeline.mix_sources(spark, docs, "").collect()
    assert {r.doc_id for r in mixed} <= {None, 1, 2, 3, 6} and None in {r.doc_id for r in mixed} and not [r for r in mixed if not r.text]
    cleared = pipeline.remove_repeated_lines(spark, docs, "").collect()
    assert len(cleared) == len(rows) and sum(r.text is None for r in cleared) == 1
    empty = docs.where("false")
    assert pipeline.keep_one_of_each_group(spark, empty, "").collect() == [] == pipeline.mix_sources(spark, empty, "").collect()
