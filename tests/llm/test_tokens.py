"""Token counting and BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from entitygraph.llm import bpe, registry, token_counts

tokenizers = pytest.importorskip("tokenizers")
PIECES = [" ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ve", "'ll", "'d", "'r", "'v", "'l", "a", "b", "ll", "e", "re", "1", "²", "!", "..", " ", "　", "é", "日本", "🙂", "<|endoftext|>", "<|endof", "́", "A", "Ⅷ", "\x00", "\x85", "the", "aaaaaaaa", "=====", "0000", " the", "tion"]
SCHEMA = "doc_id long, text string, n_tokens string, ids string, lang string"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def samples(n=3000, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [""]


def test_counts_and_ids_equal_the_library(library):
    texts = samples()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    path = bpe.default_vocabulary()
    assert token_counts.count_texts(texts, path).tolist() == [len(w) for w in want]
    for t, w in zip(texts, want):
        assert list(bpe.unpack(bpe.encode(t, path))) == w
        assert bpe.vocabulary(path).decode(w) == library.decode(w, skip_special_tokens=False)


@pytest.mark.parametrize("chunk", [1, 3, 16, 512])
def test_marks_do_not_depend_on_the_chunks(chunk):
    kinds = np.random.default_rng(0).integers(0, 11, 2000).astype(np.uint8)
    kinds[[400, 401, 1999]] = token_counts.END
    assert token_counts.split_marks(kinds, chunk).tolist() == token_counts.split_marks(kinds, 4096).tolist()


def test_chunk_maps_compose_by_prefix_scan():
    maps = np.random.default_rng(1).integers(0, 13, (13, 37)).astype(np.uint8)
    want = maps.copy()
    for c in range(1, 37):
        want[:, c] = maps[want[:, c - 1], c]
    assert (token_counts.prefix_scan(maps) == want).all()


def test_words_beyond_the_compiled_states(library, monkeypatch):
    whole = token_counts.WordCounter(bpe.vocabulary(bpe.default_vocabulary()))
    monkeypatch.setattr(token_counts, "MOST_STATES", 4)
    counter = token_counts.WordCounter(bpe.vocabulary(bpe.default_vocabulary()))
    for word in ("tionthe", "aaaaaaaaaaaaaaaa", "日本語", "x" * 5000, "internationalisation"):
        assert whole.count(word.encode()) == counter.count(word.encode()) == counter.walk(word.encode()) == len(library.encode(word, add_special_tokens=False).ids)
    assert len(counter.keys) == 4


def test_old_words_come_back(monkeypatch):
    monkeypatch.setattr(token_counts, "WORD_MEMORY", 2)
    counts = token_counts.WordCounts(token_counts.WordCounter(bpe.vocabulary(bpe.default_vocabulary())))
    assert [counts[w] for w in ("a", "the", "zqzq", "a", "the", "zqzq")] == [1, 1, counts["zqzq"]] * 2 and len(counts) <= 2


def test_counts_of_every_code_point(library):
    texts = ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 64)]
    assert token_counts.count_texts(texts, bpe.default_vocabulary()).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_decoding_replaces_broken_bytes(library):
    vocab = bpe.vocabulary(bpe.default_vocabulary())
    for ids in ([255, 3, 200], [160, 161], [50256, 0]):
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def rows():
    long = "word " * 40_000 + "x" * 30_000
    return [(1, "Hello world", None, "k", "en"), (2, None, None, None, None), (3, "", "9", None, None), (4, long, None, None, None), (1, "Hello world", None, "k", "en"), (None, "It's", None, None, None)]


def test_operators_on_odd_rows(spark, library):
    docs = spark.createDataFrame(rows(), SCHEMA)
    found = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect()}
    assert token_counts.count_tokens(docs).count() == 6
    assert found[2, 0] == found[3, 0] == (0, False)
    n = len(library.encode(rows()[3][1], add_special_tokens=False).ids)
    assert found[4, 230_000] == (n, True)
    coded = bpe.encode_documents(docs)
    for r in coded.collect():
        assert r.decoded == next(t or "" for i, t, *_ in rows() if i == r.doc_id)
    back = bpe.decode_documents(coded.select("doc_id", "ids"))
    assert sorted(r.decoded for r in back.collect()) == sorted(t or "" for _, t, *_ in rows())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(none).collect() == [] and bpe.encode_documents(none).collect() == []


def test_queries_equal_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts = {r.doc_id: r for r in registry.op2_token_counts(spark, sf_dir).collect()}
    coded = {r.doc_id: r for r in registry.op4_bpe_round_trip(spark, sf_dir).collect()}
    assert counts.keys() == coded.keys() == docs.keys()
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(t.encode()), len(ids), len(ids) > 1024)
        assert coded[i].n_tokens == len(ids)
        assert coded[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
