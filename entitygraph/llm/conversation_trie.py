"""The prefix trie of conversations, by a mergesort that knows common prefixes.

A conversation is a path: a row of fixed-width digests of its turns.  Tasks sort paths into runs
in which every path carries the number of turns that it shares with the one before it (its LCP).
The runs are dealt by ranges of paths; each range merges its pieces of the runs by a loser tree
that compares LCPs first, so shared turns are not compared again.  The merged stream opens and
closes nodes on a stack; a node is finished when a path leaves it.

Nodes on the first and the last path of a range may reach into its neighbours.  All measures of
a node are sums over its paths but for what two neighbours both count, and that hangs on the
turns that the last path of one range shares with the first of the next.  So each range hands on
its partial sums of those nodes and the two paths, and corrections are added by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.llm.common import WORD_PATTERN, broadcast_if_small, settle

#: Bytes of a turn's digest, cut from SHA-256: two of 10^12 different turns are alike with a chance of some 10^-15.
TURN = 16
#: Turns of a range (some 100 bytes each in a task), on average.
RANGE_TURNS = 200_000
#: Bytes of paths that a task sorts into one run.
RUN_BYTES = 4_000_000
#: Ids in one row of those handed on for a node between ranges.
IDS = 1_000
#: Rows of an Arrow batch made here.
OUT_ROWS = 4_096
#: Nodes between ranges (about 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000

RUNS = "run long, seq long, lcp int, path binary, words array<int>, conv_id long"
#: What a range tells: finished nodes, nodes that lack their parent's id, partial nodes between ranges, ids of those, and its two outer paths.
NODE, ORPHAN, BORDER, ENDS, FIRST, LAST = range(6)
FOUND = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, key binary, parent_key binary, part int, path binary, words array<int>"
COLUMNS = [f.split()[0] for f in FOUND.split(", ")]


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path, words): the digests of a conversation's turns in a row, and the words of each.

    Turns stand in the order of ``turn``, null first; equal ones in the order of their digests. A null
    role or text is an empty one, a repeated row a turn of its own.  Rows with a null key are
    left out.  A conversation is one row, some 20 bytes a turn; texts are not moved.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)), 1, TURN)
    one = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(t, F.lit(WORD_PATTERN)).alias("n")).alias("t"))
    rows = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x.digest)), "")).alias("path"), F.transform("t", lambda x: x.n).alias("words"))


def with_shared_heads(convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations whose first h turns, h the id's CRC-32 modulo ``most`` + 1, are those of the conversation at the last multiple of ``every``.

    A head that is missing or shorter gives what it has; the conversation's own first h turns go.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    donor = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.substring("path", 1, TURN * most).alias("_path"), F.slice("words", 1, most).alias("_words"))
    own = convs.withColumns({"donor": donor, "h": h}).join(broadcast_if_small(heads), "donor", "left")
    none, length = F.lit(bytearray()), F.octet_length("path")
    path = F.concat(F.coalesce(F.substr("_path", F.lit(1), TURN * F.col("h")), none), F.substr("path", TURN * F.col("h") + 1, length))
    words = F.concat(F.coalesce(F.slice("_words", F.lit(1), F.col("h")), F.array().cast("array<int>")), F.slice("words", F.col("h") + 1, F.size("words")))
    return own.select("conv_id", path.alias("path"), words.alias("words"))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns with which both paths begin, ``known`` of them known."""
    at, end = known * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def keys_of(path: bytes) -> list[bytes]:
    """A name for every prefix of a path, from the empty one on."""
    h, keys = hashlib.sha256(), []
    for at in range(0, len(path) + 1, TURN):
        keys.append(h.copy().digest()[:16])
        h.update(path[at : at + TURN])
    return keys


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of paths in order, each path with the number of turns shared with the one before it in its run."""
    task, n = TaskContext.get().partitionId(), 0
    rows, size = [], 0

    def run() -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[:2])
        lcps = [0] + [shared(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
        for a in range(0, len(rows), OUT_ROWS):
            part = rows[a : a + OUT_ROWS]
            paths, ids, words = zip(*part, strict=True)
            columns = [[(task << 32) + n] * len(part), range(a, a + len(part)), lcps[a : a + len(part)], paths, words, ids]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["run", "seq", "lcp", "path", "words", "conv_id"])

    for batch in batches:
        for conv, path, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words")), strict=True):
            rows.append((path, conv, words))
            size += len(path) + 64
            if size > RUN_BYTES:
                yield from run()
                n, rows, size = n + 1, [], 0
    if rows:
        yield from run()


class LoserTree:
    """Merges runs of (path, id, words, LCP with the one before) into one; yields (path, id, words, LCP with the last one yielded).

    Every inner node keeps the loser of its match with the LCP to the winner, which is the path
    last yielded wherever the next match is played.  The head with the longer LCP wins unseen; equal LCPs
    are compared from there on.
    """

    def __init__(self, runs: list[list[tuple[bytes, int, list[int], int]]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        # The heads begin as if an empty path had been yielded.
        self.lcp = [0] * self.k
        self.losers = [-1] * self.k

    def _beats(self, a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's LCP becomes the one with the winner."""
        if self.at[b] >= len(self.runs[b]):
            return True
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        p, q = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        n = shared(p[0], q[0], self.lcp[a])
        s, t = p[0][n * TURN : (n + 1) * TURN], q[0][n * TURN : (n + 1) * TURN]
        first = (s, p[1], a) < (t, q[1], b)
        self.lcp[b if first else a] = n
        return first

    def _play(self, run: int) -> int:
        """Play a run's head up the tree; at the first time it waits in the first free node."""
        node = (run + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = run
                return -1
            if not self._beats(run, other):
                self.losers[node], run = run, other
            node //= 2
        return run

    def __iter__(self) -> Iterator[tuple[bytes, int, list[int], int]]:
        winner = 0 if len(self.runs) == 1 else -1
        if len(self.runs) > 1:
            for run in range(self.k):
                winner = self._play(run)
        while winner >= 0 and self.runs and self.at[winner] < len(self.runs[winner]):
            path, conv, words, _ = self.runs[winner][self.at[winner]]
            yield path, conv, words, self.lcp[winner]
            self.at[winner] += 1
            if self.at[winner] < len(self.runs[winner]):
                self.lcp[winner] = self.runs[winner][self.at[winner]][3]
            if self.k > 1:
                winner = self._play(winner)


class Open:
    """A node on the path that is open, with what its closed children told."""

    __slots__ = ("children", "convs", "ends", "key", "least", "leaves", "saved", "waiting", "words")

    def __init__(self, words: int, key: bytes | None) -> None:
        self.words, self.key, self.least = words, key, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        #: Finished children that wait for this node's smallest id.
        self.waiting: list[tuple] = []


def ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def nodes(stream: Iterator[tuple[bytes, int, list[int], int]], part: int) -> Iterator[tuple]:
    """Rows of ``FOUND`` for a range of paths in order, each with its LCP."""
    stack: list[Open] = []
    keys: list[bytes] = []
    first, path, words = None, b"", []

    def close() -> Iterator[tuple]:
        depth, node = len(stack) - 1, stack.pop()
        node.saved += (node.convs - 1) * node.words
        node.leaves = node.leaves if node.children else 1
        above = stack[-1] if stack else None
        measures = (node.convs, node.children, node.leaves, node.saved)
        for child in node.waiting:
            if node.key is None:
                yield (NODE, child[0], depth + 1, node.least, *child[1:], None, None, None, None, None)
            else:
                yield (ORPHAN, child[0], depth + 1, None, *child[1:], None, node.key, None, None, None)
        if node.key is not None:
            yield (BORDER, node.least, depth, None, *measures, None, node.key, above.key if above else None, None, None, None)
            for a in range(0, len(node.ends), IDS):
                yield (ENDS, node.ends[a], None, None, None, None, None, None, ",".join(map(str, node.ends[a : a + IDS])), node.key, None, None, None, None)
        else:
            above.waiting.append((node.least, *measures, ids_digest(node.ends)))
        if above:
            above.convs += node.convs
            above.leaves += node.leaves
            above.saved += node.saved
            above.least = node.least if above.least is None else min(above.least, node.least)

    for path, conv, words, lcp in stream:
        if first is None:
            first, keys = path, keys_of(path)
            stack.append(Open(0, keys[0]))
        while len(stack) > lcp + 1:
            yield from close()
        for depth in range(len(stack), len(path) // TURN + 1):
            stack[-1].children += 1
            stack.append(Open(words[depth - 1], keys[depth] if path is first else None))
        top = stack[-1]
        top.convs += 1
        top.ends.append(conv)
        top.least = conv if top.least is None else min(top.least, conv)
    if first is None:
        return
    for node, key in zip(stack, keys_of(path), strict=True):
        node.key = key
    while stack:
        yield from close()
    yield (FIRST, *[None] * 10, part, first, None)
    yield (LAST, *[None] * 10, part, path, words)


def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``FOUND`` as Arrow batches."""
    types = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    pending: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pending, strict=True), types, strict=True)], names=COLUMNS)

    for row in rows:
        pending.append(row)
        if len(pending) >= OUT_ROWS:
            yield batch()
            pending.clear()
    if pending:
        yield batch()


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a range from its pieces of runs, which come one after the other."""
    runs: list[list[tuple]] = []
    last = None
    for batch in batches:
        for run, lcp, path, words, conv in zip(*(batch.column(c).to_pylist() for c in ("run", "lcp", "path", "words", "conv_id")), strict=True):
            if run != last:
                runs.append([])
                last = run
            runs[-1].append((path, conv, words, lcp))
    yield from packed(nodes(iter(LoserTree(runs)), TaskContext.get().partitionId()))


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges both count, for every node that the last path of one shares with the first of the next."""
    names = ["key", "n_children", "n_leaves", "saved_tokens"]
    for batch in batches:
        for last, first, words in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "words")), strict=True):
            n = shared(last, first)
            keys, rows, twice = keys_of(last), [], 0
            ended = n * TURN == len(last)
            for d in range(n, -1, -1):
                twice += words[d - 1] if d else 0
                rows.append((keys[d], -1 if d < n else 0, -1 if ended else 0, twice))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.binary(), *[pa.int64()] * 3], strict=True)], names=names)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the ids of each key; rows come by key and first id, and only a hash is kept of them."""
    key, h = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k == key:
                h.update(b",")
            else:
                if h is not None:
                    yield told()
                key, h = k, hashlib.sha256()
            h.update(ids.encode())
    if h is not None:
        yield told()


def trie(convs: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row per node of the trie of (conv_id, path, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Ids are expected to be unique.  Equal paths are members of the same nodes.  An empty path
    ends at the root; an empty table has no nodes.
    """
    runs = settle(convs.mapInArrow(sorted_runs, RUNS), "runs", compact=True)
    turns = runs.agg(F.sum(F.size("words")), F.count("*")).first()
    parts = max(runs.sparkSession.sparkContext.defaultParallelism, -(-((turns[0] or 0) + turns[1]) // range_turns))
    dealt = runs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("run", "seq")
    found = settle(dealt.mapInArrow(merged, FOUND), "trie")
    of = lambda kind: found.where(F.col("kind") == kind)
    # One number a range.
    after = of(FIRST).select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    pairs = of(LAST).select("part", "path", "words").join(F.broadcast(after), "part").join(of(FIRST).select(F.col("part").alias("next"), F.col("path").alias("first")), "next")
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    partial = of(BORDER).select("key", "conv_id", "depth", "parent_key", *measures)
    twice = pairs.select("path", "first", "words").mapInArrow(corrections, "key binary, n_children long, n_leaves long, saved_tokens long")
    whole = partial.unionByName(twice, allowMissingColumns=True).groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *[F.sum(m).alias(m) for m in measures])
    ends = of(ENDS).select("key", F.col("conv_id").alias("least"), "ends").repartition("key").sortWithinPartitions("key", "least").mapInArrow(hashed, "key binary, ends_sha256 string")
    border = settle(whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ids_digest([])))), "border", compact=True)
    above = broadcast_if_small(border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), limit=BROADCAST_ROWS)
    out = ["conv_id", "depth", "parent_conv_id", *measures, "ends_sha256"]
    inner = of(NODE).withColumnRenamed("ends", "ends_sha256").select(*out)
    orphans = of(ORPHAN).drop("parent_conv_id").withColumnRenamed("ends", "ends_sha256").join(above, "parent_key").select(*out)
    return inner.unionByName(orphans).unionByName(border.join(above, "parent_key", "left").select(*out))


def prefix_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", range_turns: int = RANGE_TURNS, shared_heads: bool = True) -> DataFrame:
    """The trie of the conversations of a table of turns; see :func:`conversations` and :func:`trie`.

    ``shared_heads`` first gives conversations the heads of :func:`with_shared_heads`.  Other columns
    are not read.  Long texts count by their digest; long conversations have a node per turn.
    """
    convs = settle(conversations(turns, key, turn, role, text), "conversations", compact=True, heavy=True)
    return trie(with_shared_heads(convs) if shared_heads else convs, range_turns)


SQL = """
with recursive o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
crc as (select distinct conv_id, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint),
  lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda i: 0::bigint), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) as x from o),
c as (select conv_id, conv_id - conv_id % 20 as donor, xor(x, 4294967295) % 4 as h from crc),
t as (
  select c.conv_id, o.pos as place, o.role, o.text from c join o on o.conv_id = c.donor and o.pos <= c.h
  union all select c.conv_id, o.pos + 1000000 as place, o.role, o.text from c join o on o.conv_id = c.conv_id and o.pos > c.h),
r as (select conv_id, row_number() over (partition by conv_id order by place) as depth, sha256(length(role)::varchar || ':' || role || text) as x, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as w from t),
m as (
  select conv_id, 0 as depth, '' as node, 0 as w, (select count(*) from r where r.conv_id = c.conv_id) as n from c
  union all select conv_id, depth, sha256(string_agg(x, '') over (partition by conv_id order by depth)) as node, w, count(*) over (partition by conv_id) as n from r),
node as (
  select node, depth, any_value(w) as w, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '') as ends from m group by node, depth),
pair as (select distinct a.node as above, b.node as below from m a join m b on a.conv_id = b.conv_id and b.depth >= a.depth),
edge as (select distinct a.node as parent, b.node as child from m a join m b on a.conv_id = b.conv_id and b.depth = a.depth + 1),
kids as (select n.node, count(e.child) as n_children from node n left join edge e on e.parent = n.node group by n.node),
sub as (select p.above as node, count(*) filter (where k.n_children = 0) as n_leaves, sum((n.n_convs - 1) * n.w) as saved_tokens from pair p join node n on n.node = p.below join kids k on k.node = p.below group by p.above)
select n.conv_id, n.depth::bigint as depth, up.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, k.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from node n join kids k using (node) join sub s using (node) left join edge e on e.child = n.node left join node up on up.node = e.parent
"""
