"""The trie of conversations against a dictionary of prefixes, and its merge against a plain sort."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from entitygraph.llm import conversation_trie as C
from entitygraph.llm.registry import QUERIES, SQL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, heads=True):
    """Rows of the trie by its definition; turns are told apart by role and text."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = [n for n in below if not any(len(m) > len(n) and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        children = sum(len(n) == len(node) + 1 for n in below)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def made(seed, n):
    """Conversations that share turns, with copies, prefixes of others, and a hot first turn."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-40, 400), n):
        path = ["hot"] if rng.random() < 0.5 else []
        while rng.random() < 0.75:
            path.append(rng.choice(["a b", "c", "d e f", ""]))
        rows += [(c, i if i else None, "user" if i % 2 else "bot", t) for i, t in enumerate(path)]
    return rows


@pytest.mark.parametrize(("seed", "range_turns"), [(1, 1), (2, 1), (3, 7), (4, 200_000)])
def test_equals_brute_force_over_many_ranges(spark, seed, range_turns):
    rows = made(seed, 60)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert rows_of(C.prefix_trie(turns, range_turns=range_turns)) == brute(rows)


def test_ids_of_a_hot_node_are_hashed_in_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "IDS", 3)
    rows = [(c, 0, "user", "same") for c in range(1, 120, 2)] + [(1000, 0, "user", "same"), (1000, 1, "bot", "more")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(C.prefix_trie(turns, range_turns=4, shared_heads=False)) == brute(rows, heads=False)


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (2, 0, "", ""), (2, 0, "", ""), (None, 0, "user", "x"), (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (23, 0, "a", "only"), (40, 0, "a", "w " * 50_000)]
    rows += [(41, i, "user", f"turn {i}") for i in range(700)]
    clash = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, words int")
    assert rows_of(C.prefix_trie(clash, range_turns=3)) == brute(rows)
    assert rows_of(C.prefix_trie(clash.limit(0))) == []
    turnless = [(22, 0, "a", "goes")]  # its head is missing and its own first turns go
    assert zlib.crc32(b"22") % 4 > 0
    assert rows_of(C.prefix_trie(spark.createDataFrame(turnless, "conv_id long, turn long, role string, text string"))) == brute(turnless)


def test_an_injective_digest_of_role_and_text(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "a", "bc")]
    got = C.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert got[0].path == got[2].path != got[1].path and len(got[0].path) == C.TURN


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_the_loser_tree_merges_runs_and_tells_common_prefixes(k):
    rng = random.Random(k)
    runs, every = [], []
    for _ in range(k):
        run = sorted(("".join(rng.choice("ab") * C.TURN for _ in range(rng.randrange(8))).encode(), rng.randrange(10**6)) for _ in range(rng.randrange(0, 40)))
        runs.append([(p, c, [], C.shared(run[i - 1][0], p) if i else 7) for i, (p, c) in enumerate(run)])
        every += run
    got = list(C.LoserTree(runs))
    want = sorted(every)
    assert [(p, c) for p, c, *_ in got] == want
    assert [g[3] for g in got] == [C.shared(want[i - 1][0], p) if i else 0 for i, (p, _) in enumerate(want)]


def test_the_merge_compares_few_turns(monkeypatch):
    """Shared turns are not compared again: with long common prefixes nearly all matches are settled by LCPs."""
    head, rng = b"h" * C.TURN * 50, random.Random(1)
    paths = sorted(head + bytes(rng.choice(b"abcdefgh") for _ in range(6) for _ in range(C.TURN)) for _ in range(400))
    runs = [[(p, i, [], C.shared(q, p)) for i, (q, p) in enumerate(zip([b"", *paths[r::8]], paths[r::8], strict=False))] for r in range(8)]
    seen = []
    plain = C.shared
    monkeypatch.setattr(C, "shared", lambda a, b, known=0: seen.append(plain(a, b, known) - known) or plain(a, b, known))
    assert [p for p, *_ in C.LoserTree(runs)] == paths
    assert sum(seen) < 50 * 8 + 8 * 400


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert rows_of(QUERIES["op11_conversation_trie"](spark, sf_dir)) == sorted(con.sql(SQL["op11_conversation_trie"]).fetchall(), key=str)
