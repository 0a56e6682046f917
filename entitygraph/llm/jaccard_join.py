"""Jaccard self-join of word-shingle sets by T-occurrence search.

Documents with equal sets form one class.  Class representatives are dealt into
groups within which the join runs: representatives that agree on a band of
min-hash values belong to the same group, and so do chains of them.  Within a
group, each set queries the inverted lists of the sets before it.  A partner must
occur in at least T of the query's lists (T follows from the sizes and the
threshold), so the longest lists are set aside, the short ones are merged, and
whoever occurs often enough there is looked up in the long lists by binary search
(DivideSkip).  Documents that reach the required overlap are linked.

Large groups are cut into tiles that share the group's smallest member.  Where a
band of such a group still holds several components, the members outside its
largest component query all members of the band, tile by tile; two members of one
component need no further search, as only reachability is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from entitygraph.llm.common import broadcast_if_small, mix64, settle, slices, small_batches, texts_of
from entitygraph.operators.components import components
from entitygraph.llm.shingles import shingle_sets

#: 100 * intersection >= 80 * union.
PERCENT = 80
#: Bands and min-hash values of a band: a pair at the threshold agrees on no band with probability
#: (1 - 0.8^5)^48 < 1e-8.
BANDS, BAND_ROWS = 48, 5
#: Most sets of one search.
TILE = 1024
#: Most sets on a side where members of a band are asked across tiles; smaller, as bands repeat members.
BAND_TILE = 256
#: Most shingles of one search, on average over the tiles of a group (8 bytes each, and some 40 in the lists).
TILE_SHINGLES = 2_000_000
#: Rows of (id, group) up to which they are broadcast to the documents (about 24 bytes each).
BROADCAST_ROWS = 1_000_000
#: DivideSkip's weight of a binary search against a merge step.
MU = 0.01


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[: BANDS * BAND_ROWS], seeds[BANDS * BAND_ROWS :] | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of min-hash values."""
    xor, times = _multipliers()
    least = np.full(len(xor), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1024):
        part = (hashes[a : a + 1024, None] ^ xor) * times
        np.minimum(least, part.min(0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mix64(key ^ rows[:, k])
    return key.view(np.int64)


def required(size: np.ndarray | int, other: np.ndarray | int):
    """The least overlap of two sets whose Jaccard similarity reaches the threshold."""
    return -(-PERCENT * (size + other) // (100 + PERCENT))


class Inverted:
    """Inverted lists over sets of hashes, members numbered in the order given."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        self.values, self.list_of = np.unique(values, return_inverse=True)
        order = np.argsort(self.list_of, kind="stable")
        self.members = owners[order]
        self.lengths = np.bincount(self.list_of, minlength=len(self.values))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.count = len(sets)
        # (list, member) in one ascending key, for binary search within a list.
        self.keys = self.list_of[order].astype(np.int64) * max(1, self.count) + self.members

    def lists(self, k: int) -> np.ndarray:
        return self.list_of[self.offsets[k] : self.offsets[k + 1]]

    def search(self, lists: np.ndarray, size: int, wanted) -> np.ndarray:
        """Members among ``wanted(members)`` whose overlap with the query reaches what their sizes require."""
        least = required(size, -(-PERCENT * size // 100))
        if len(lists) < least:
            return np.zeros(0, np.int64)
        lengths = self.lengths[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        longest = int(self.lengths[lists[-1]])
        n_long = int(min(least - 1, least / (MU * math.log2(max(2, longest)) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        runs = self.lengths[short]
        at = np.repeat(self.begins[short] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        seen = np.bincount(self.members[at], minlength=self.count)
        found = np.flatnonzero(seen >= max(1, least - n_long))
        if not len(found):
            return found
        found = found[wanted(found)]
        small, large = np.minimum(self.sizes[found], size), np.maximum(self.sizes[found], size)
        found = found[100 * small >= PERCENT * large]
        if not len(found):
            return found
        overlap = seen[found]
        step = max(1, 1_000_000 // len(found))
        for a in range(0, len(long), step):
            probe = long[a : a + step, None].astype(np.int64) * max(1, self.count) + found[None, :]
            place = np.searchsorted(self.keys, probe)
            overlap = overlap + (self.keys[np.minimum(place, len(self.keys) - 1)] == probe).sum(0)
        return found[overlap >= required(size, self.sizes[found])]


def join_group(sets: list[np.ndarray], ask: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the members: ``ask`` marks the queries, ``label`` the components known so far."""
    n = len(sets)
    index = Inverted(sets)
    _, parent = np.unique(label, return_inverse=True)
    root = parent.copy()
    made: list[tuple[int, int]] = []
    number = np.arange(n)
    for q in np.flatnonzero(ask):
        before = ~ask | (number < q)
        for d in index.search(index.lists(q), int(index.sizes[q]), lambda m: before[m] & (root[m] != root[q])).tolist():  # noqa: B023
            if root[d] != root[q]:
                made.append((d, int(q)))
                root[root == root[d]] = root[q]
    return made


def _joiner(kind: pa.DataType):
    schema = pa.schema([("a", kind), ("b", kind)])

    def join(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return schema.empty_table()
        table = table.sort_by([("n", "ascending"), ("rep", "ascending")])
        lists = table["shingles"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        ends = ends - ends[0]
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        ids = table["rep"].combine_chunks()
        made = join_group(sets, table["ask"].to_numpy(zero_copy_only=False).astype(bool), table["label"].to_numpy())
        return pa.Table.from_arrays([ids.take(pa.array([x for x, _ in made], pa.int64())), ids.take(pa.array([y for _, y in made], pa.int64()))], schema=schema)

    return join


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, n, k1, k2, bands): the set's size, 128 bits of it, and its band keys (null for empty sets)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t"))
    schema = f"_id {source.schema['_id'].dataType.simpleString()}, n bigint, k1 bigint, k2 bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "_t")
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                k1 = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                k2 = [int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                bands = [band_keys(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["_id", "n", "k1", "k2", "bands"])

    return source.mapInArrow(run, schema)


def shingles_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, key: str, text: str) -> DataFrame:
    """(rep, the other columns of ``wanted``, n, shingles) of the documents that ``wanted`` names by ``rep``."""
    wanted = broadcast_if_small(wanted, n_wanted, BROADCAST_ROWS)
    rows = docs.select(F.col(key).alias("rep"), F.col(text).alias("_t")).join(wanted, "rep")
    more = [c for c in rows.columns if c != "_t"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*more).schema) + ", n bigint, shingles array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "_t")
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                kept = [batch.column(i).slice(a, b - a) for i in range(len(more))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=[*more, "n", "shingles"])

    return rows.select(*more, "_t").mapInArrow(run, schema)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """The components of the Jaccard join: (key, n_shingles, component_id).

    Null and empty texts, and texts without words, have an empty set and link with
    nothing; their component is their own key.  Repeated texts share a class and
    link.  Several texts under one key are one node with all their links; rows with a null
    key are returned with an empty component.  Keys are of any type that has an order.  Other columns are not read.  An empty table gives an
    empty result.
    """
    sig = settle(signatures(docs, key, text), "signatures")
    kind = sig.schema["_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(sig.schema["_id"].dataType)
    classes = sig.where("n > 0 and _id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("_id", "bands")).alias("s"))
    classes = settle(classes.select("k1", "k2", "n", F.col("s._id").alias("rep"), F.col("s.bands").alias("bands")), "classes")
    keyed = classes.select("rep", F.explode("bands").alias("band"))
    # Written before it is joined back, so that a band of a third of all rows is split by the skew join.
    shared = settle(keyed.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("c")).where("c > 1").select("band", "first"), "shared", compact=True, heavy=True)
    near = keyed.join(shared, "band").where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    groups = components(near).withColumnsRenamed({"node": "rep", "component": "gid"})
    # Groups of several tiles alone are looked up, and they are few: at most (representatives / tile).
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    groups = settle(groups.join(sizes, "rep"), "reach", compact=True)
    parts = F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / TILE_SHINGLES)).cast("int")
    wide = settle(groups.groupBy("gid").agg(parts.alias("m")).where("m > 1"), "wide", compact=True)
    groups = groups.drop("n")
    groups = settle(groups.join(broadcast_if_small(wide, wide.count(), BROADCAST_ROWS), "gid", "left").withColumn("m", F.coalesce("m", F.lit(1))), "groups", compact=True)
    n_groups = groups.count()
    own = F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("m")).cast("int")
    # The smallest member stands in every tile of its group.
    dealt = shingles_of(docs, groups, n_groups, key, text).withColumn("tile", F.explode(F.when(F.col("rep") == F.col("gid"), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array(own))))
    dealt = dealt.withColumns({"ask": F.lit(True), "label": F.xxhash64("rep")})
    links = settle(dealt.groupBy("gid", "tile").applyInArrow(_joiner(arrow_kind), f"a {kind}, b {kind}"), "links", compact=True, heavy=True)
    reach = components(links)
    wide = groups.where("m > 1").select("rep")
    if wide.limit(1).count():
        more = _across_tiles(docs, classes, wide, reach, key, text, min(tile, BAND_TILE), kind, arrow_kind)
        if more is not None:
            reach = components(links.unionByName(more))
    known = classes.select("k1", "k2", "n", "rep").join(reach.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    full = sig.where("n > 0 and _id is not null").select("_id", "n", "k1", "k2").join(known, ["k1", "k2", "n"]).select("_id", "n", "component")
    rest = sig.where("n = 0 or _id is null").select("_id", "n", F.col("_id").alias("component"))
    return full.unionByName(rest).select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _across_tiles(docs, classes, wide, reach, key, text, tile, kind, arrow_kind) -> DataFrame | None:
    """Links across the tiles of large groups, in the bands that still hold several components."""
    members = classes.join(wide, "rep", "left_semi").join(reach.withColumnRenamed("node", "rep"), "rep", "left")
    members = members.select("rep", F.xxhash64(F.coalesce("component", "rep")).alias("label"), F.explode("bands").alias("band"))
    members = settle(members, "members", compact=True)
    parts = members.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"))
    open_ = parts.groupBy("band").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("k"), F.sum("h").alias("h")).where("k > 1")
    # Bands with the same members are searched once.
    open_ = open_.groupBy("c", "h").agg(F.min(F.struct("band", "top")).alias("s")).select(F.col("s.band").alias("band"), F.col("s.top.label").alias("top"), F.ceil(F.col("c") / tile).cast("int").alias("m"), F.ceil((F.col("c") - F.col("s.top.c")) / tile).cast("int").alias("mq"))
    open_ = settle(open_, "open", compact=True)
    rows = settle(members.join(open_, "band"), "asked", compact=True)
    if not rows.limit(1).count():
        return None
    reps = settle(rows.select("rep").distinct(), "reps", compact=True)
    sets = settle(shingles_of(docs, reps, reps.count(), key, text), "sets")
    own, mine = F.pmod(F.xxhash64("rep", F.lit("index")), F.col("m")).cast("int"), F.pmod(F.xxhash64("rep", F.lit("query")), F.col("mq")).cast("int")
    asks = rows.where("label != top").select("band", "rep", "label", F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("tile"), mine.alias("part"))
    held = rows.select("band", "rep", "label", F.lit(False).alias("ask"), own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("mq") - 1)).alias("part"))
    dealt = asks.unionByName(held).join(sets, "rep")
    return settle(dealt.groupBy("band", "tile", "part").applyInArrow(_joiner(arrow_kind), f"a {kind}, b {kind}"), "more", compact=True, heavy=True)


#: The join in DuckDB SQL, for small tables: all pairs that share a shingle, counted.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a),
m AS (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
