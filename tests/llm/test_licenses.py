"""Licence scans against a word-by-word reading and SQL, and on awkward input."""

import random
import re

import duckdb
import pytest

from entitygraph.llm import license_scan as L
from entitygraph.llm.registry import QUERIES, SQL

WORDS = re.compile(L.LICENSE_WORDS)
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def places(text):
    w = words(text)
    return sorted((i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def notice(label):
    return next(t for t in L.TEMPLATES if t.label == label and t.edits)


def edit(rng, said, n, kind):
    said = list(said)
    for i in rng.sample(range(len(said)), n):
        said[i] = {"replace": "qqq", "delete": "", "insert": said[i] + " qqq"}[kind]
    return " ".join(said)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    pieces = ["Under the MIT-License", "UNDER THE MIT LICENSE", "under the mit", "license", "apache license, version 2.0", "apache License version", "2", "CC BY-NC", "cc by", "nc", "CC\nBY/NC", "éa", "ünder the mit license", "\U0001f600"]
    return ["".join(rng.choice(pieces) + rng.choice([" ", ", ", "\n", ". "]) for _ in range(rng.randrange(0, 30))) for _ in range(200)]


def test_base_places_equal_a_reading_of_all_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.digest(L.scan(docs)).collect()}
    assert sum(len(places(t)) for t in texts) > 100
    for i, t in enumerate(texts):
        at, r = places(t), got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words(t)), len(at), ",".join(sorted({label for _, label in at})))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))


@pytest.mark.parametrize("kind", ["replace", "delete", "insert"])
def test_notices_stand_with_as_many_edits_as_allowed(spark, kind):
    rng, said = random.Random(3), notice("mit")
    n = said.allowed
    rows = [(k, f"before {edit(rng, said.words, k, kind)} after") for k in (0, 1, n // 2, n)]
    rows.append((99, edit(rng, said.words, 3 * n, kind) if kind != "insert" else edit(rng, said.words, len(said.words), kind)))
    got = {r.doc_id: r for r in L.digest(L.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k in (0, 1, n // 2, n):
        assert got[k].labels == "mit" and got[k].n_base == 0
        assert got[k].score >= 1 - k / len(said.words) - 1e-12
    assert got[0].score == 1.0 and (got[99].labels, got[99].score) == ("", 0.0)


def test_spans_of_notices(spark):
    said = " ".join(notice("isc").words)
    docs = spark.createDataFrame([(1, f"one two {said} three {said}")], "doc_id long, text string")
    n = len(said.split())
    assert [(s.start, s.stop, s.label, s.base) for s in L.scan(docs).first().licenses] == [(2, 2 + n, "isc", False), (3 + n, 3 + 2 * n, "isc", False)]


def test_awkward_rows(spark):
    long = "word " * 200_000 + "under the mit license " + "word " * 1_000 + "cc by nc"
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "cc by nc", "a", 1), (3, "cc by nc", "a", 1), (3, "other words here", None, 2), (None, "cc by nc", "a", 1), (None, None, None, None), (4, long, "a", 1), (5, "cc cc by nc by nc", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string, _kh int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in L.digest(L.scan(docs)).collect())
    assert got == [
        (False, 1, 0, 0, None, None, ""),
        (False, 2, 0, 0, None, None, ""),
        (False, 3, 3, 0, None, None, ""),
        (False, 3, 3, 1, 0, 0, "cc-by-nc"),
        (False, 3, 3, 1, 0, 0, "cc-by-nc"),
        (False, 4, 201_007, 2, 200_000, 201_004, "cc-by-nc,mit"),
        (False, 5, 6, 1, 1, 1, "cc-by-nc"),
        (True, 0, 0, 0, None, None, ""),
        (True, 0, 3, 1, 0, 0, "cc-by-nc"),
    ]
    assert L.digest(L.scan(docs.limit(0))).count() == 0


def test_templates_are_checked(spark):
    with pytest.raises(ValueError, match="3 words"):
        L.template_table(spark, [L.Template("x", "two words")])


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op12_license_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(SQL["op12_license_scan"])
    got = QUERIES["op12_license_scan"](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
