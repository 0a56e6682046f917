"""Near-duplicate embeddings by tile products of int8 vectors with rigorous error bounds.

Vectors meet in the buckets of several sign-hash tables; the number of tables
follows from the number of bits so that a pair at the threshold meets nowhere
with probability at most ``MISS``.  A vector is quantised once, to 16 bits a component
whose upper byte is its int8 code; codes, scale and error bounds are all that is dealt to the tables.
Within a bucket, tiles of bounded size are multiplied as int8: with u = s q + e and
v = t r + f, the true product differs from s t <q, r> by at most |f| (1 + |e|) + |e|.
Pairs that this bound leaves possible are multiplied with both bytes, whose bound is some
250 times narrower, and the few that still straddle the threshold are recomputed in
double precision from the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitygraph.llm.common import broadcast_if_small, settle
from entitygraph.operators.components import components

THRESHOLD = 0.95
#: Most vectors on each side of a tile product.
TILE = 2048
#: Vectors that a bucket holds on average.
BUCKET = 1200
#: Chance that a pair exactly at the threshold meets in no table.
MISS = 1e-7
SEED = 20240607
#: Rows up to which the table of buckets with several tiles is broadcast (24 bytes each).
BROADCAST_ROWS = 500_000


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a table and number of tables for ``n`` vectors."""
    bits = max(2, math.ceil(math.log2(max(2, n / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return min(bits, 31), math.ceil(math.log(MISS) / math.log1p(-meet))


def signs_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The side of every hyperplane of every table on which a vector lies."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    return x @ planes > 0


def buckets(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of every vector in every table."""
    return (signs.reshape(len(signs), tables, bits) * (1 << np.arange(bits))).sum(2).astype(np.int32)


def quantize(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of unit rows, and their scales; the int8 code of a component is :func:`upper` of it."""
    scale = np.abs(u).max(1) / 32_512  # 127 * 256
    return np.rint(u / scale[:, None]).astype(np.int16), scale


def upper(q: np.ndarray) -> np.ndarray:
    return ((q.astype(np.int32) + 128) >> 8).astype(np.int8)


def lost(u: np.ndarray, q: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Bounds on the length of what rounding has lost."""
    return np.sqrt(((u - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-12) + 1e-12


@dataclass
class Side:
    """One side of a tile: 16-bit codes, scales, and the bounds of upper bytes and of whole codes."""

    q: np.ndarray
    scale: np.ndarray
    coarse: np.ndarray
    fine: np.ndarray

    def part(self, rows) -> Side:
        return Side(self.q[rows], self.scale[rows], self.coarse[rows], self.fine[rows])

    @classmethod
    def of(cls, u: np.ndarray) -> Side:
        q, scale = quantize(u)
        return cls(q, scale, lost(u, upper(q), 256 * scale), lost(u, q, scale))


def tile_links(left: Side, right: Side, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs whose product may reach the threshold, and whether it surely does."""
    # Integer products below 2^24 are exact in single precision; wider vectors use double.
    exact = np.float32 if left.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = upper(left.q).astype(exact) @ upper(right.q).astype(exact).T
    least = threshold - left.coarse - right.coarse.max() * (1 + left.coarse)
    # The margin covers what single precision rounds off the bound itself.
    least -= np.abs(least) * 1e-6
    bound = np.multiply.outer((least / (256 * left.scale)).astype(exact), (1 / (256 * right.scale)).astype(exact))
    i, j = np.divmod(np.flatnonzero(product >= bound), len(right.scale))
    near, error = np.empty(len(i)), left.fine[i] + right.fine[j] * (1 + left.fine[i]) + 1e-12
    for a in range(0, len(i), 65536):
        x, y = i[a : a + 65536], j[a : a + 65536]
        near[a : a + 65536] = np.einsum("ij,ij->i", left.q[x].astype(np.float64), right.q[y].astype(np.float64)) * left.scale[x] * right.scale[y]
    keep = near + error >= threshold
    return i[keep], j[keep], (near - error >= threshold)[keep]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from every index through the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def link(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", tile: int = TILE, exact: bool = False) -> DataFrame:
    """Links of every vector: (key, n_links, component_id, kept).

    Keys may be of any type that has an order.  Vectors that are null, zero, or hold null or
    non-finite components link with nothing, and neither do vectors of different lengths.  Rows are vectors: repeated
    rows link with each other, and different vectors under one key have links of their own.
    Rows with a null key are returned with no links and a null component.  Equal vectors
    are first taken together as a class, by a partially aggregated group; links are found
    between classes and weighted by their sizes, so copies are never expanded into
    pairs.  An empty table gives an empty result.

    ``exact`` compares all tiles with all instead of dealing vectors to tables: no pair is missed
    with any chance, at a cost that grows with the square of the number of classes.
    """
    inf = F.lit(float("inf"))
    usable = F.col("_id").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("_v", lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("_id"), F.col(vector).alias("_v")).withColumn("_ok", F.coalesce(usable, F.lit(False)))
    bits, tables = (1, 1) if exact else plan(rows.count(), threshold)
    classes = rows.where("_ok").groupBy("_v").agg(F.min("_id").alias("least"), F.count("*").alias("size"))
    # Numbers are written once and read from then on; a key may have several classes.
    classes = classes.select("_v", "least", "size", F.monotonically_increasing_id().alias("rep"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            widths = np.diff(ends)
            made: list = [None] * len(lists)
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                x = flat[ends[own][:, None] + np.arange(width)].astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                side, signs = Side.of(x / np.sqrt((x * x).sum(1, keepdims=True))), signs_of(x, bits, tables)
                rest = zip(side.scale.tolist(), side.coarse.tolist(), side.fine.tolist(), np.packbits(signs, axis=1), buckets(signs, bits, tables) * (not exact), strict=True)
                for k, q, (scale, coarse, fine, packed, codes) in zip(own.tolist(), side.q.astype("<i2"), rest, strict=True):
                    made[k] = (q.tobytes(), scale, coarse, fine, packed.tobytes(), codes)
            q, scale, coarse, fine, signs, codes = ([m[k] for m in made] for k in range(6))
            more = [pa.array(q, pa.binary()), *(pa.array(c, pa.float64()) for c in (scale, coarse, fine)), pa.array(signs, pa.binary()), pa.array(codes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "q", "scale", "coarse", "fine", "signs", "codes"])

    element = classes.schema["_v"].dataType.simpleString()
    kind = classes.schema["least"].dataType.simpleString()
    classes = settle(classes.mapInArrow(coded, f"_v {element}, least {kind}, size bigint, rep bigint, q binary, scale double, coarse double, fine double, signs binary, codes array<int>"), "classes")
    placed = classes.select("rep", "size", "q", "scale", "coarse", "fine", "signs", F.size("_v").alias("width"), F.posexplode("codes").alias("t", "code"))
    # Buckets of more than one tile: at most (vectors * tables / tile) rows.
    wide = classes.select(F.size("_v").alias("width"), F.posexplode("codes").alias("t", "code")).groupBy("width", "t", "code").count().where(F.col("count") > tile)
    wide = settle(wide.select("width", "t", "code", F.ceil(F.col("count") / tile).cast("int").alias("m")), "wide", compact=True)
    n_wide = wide.count()
    if n_wide:
        placed = placed.join(broadcast_if_small(wide, n_wide, BROADCAST_ROWS), ["width", "t", "code"], "left")
    else:
        placed = placed.withColumn("m", F.lit(None).cast("int"))
    placed = placed.withColumn("m", F.coalesce("m", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("m")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("width", "t", "code", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "size", "q", "scale", "coarse", "fine", "signs")

    def tiles(table: pa.Table) -> pa.Table:
        lo, hi, t = table["lo"][0].as_py(), table["hi"][0].as_py(), table["t"][0].as_py()
        n = table.num_rows
        if n < 2:
            return out_schema.empty_table()
        ids, size = table["rep"].combine_chunks(), table["size"].to_numpy()
        bytes_of = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind).reshape(n, -1)
        all_ = Side(bytes_of("q", "<i2"), *(table[c].to_numpy() for c in ("scale", "coarse", "fine")))
        codes = buckets(np.unpackbits(bytes_of("signs", np.uint8), axis=1)[:, : bits * tables], bits, tables)
        own = table["own"].to_numpy()
        left, right = (np.arange(n), np.arange(n)) if lo == hi else (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        links, pairs, open_ = np.zeros(n, np.int64), [], []
        for a in range(0, len(left), tile):
            for b in range(0, len(right), tile):
                if lo == hi and b < a:
                    continue
                x, y = left[a : a + tile], right[b : b + tile]
                i, j, sure = tile_links(all_.part(x), all_.part(y), threshold)
                i, j = x[i], y[j]
                # A pair counts in the first table in which it meets.
                first = (i < j) if lo == hi else np.ones(len(i), bool)
                for k in range(t):
                    first &= codes[i, k] != codes[j, k]
                open_.append((i[first & ~sure], j[first & ~sure]))
                i, j = i[first & sure], j[first & sure]
                links += np.bincount(i, size[j], n).astype(np.int64) + np.bincount(j, size[i], n).astype(np.int64)
                pairs.append((i, j))
        (i, j), (x, y) = (tuple(np.concatenate(c) for c in zip(*p, strict=True)) if p else (np.zeros(0, int),) * 2 for p in (pairs, open_))
        found = np.flatnonzero(links)
        root = local_roots(n, i, j)[found]
        ends = [ids.take(pa.array(np.concatenate(c))) for c in ((found, x), (root, y))]
        return pa.Table.from_arrays([ends[0], pa.array(np.concatenate([links[found], np.zeros(len(x), np.int64)])), ends[1], pa.array(np.arange(len(found) + len(x)) >= len(found))], schema=out_schema)

    out_schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("open", pa.bool_())])
    found = settle(dealt.groupBy("width", "t", "code", "lo", "hi").applyInArrow(tiles, "rep bigint, links bigint, root bigint, open boolean"), "links", compact=True, heavy=True)
    # What the bounds leave open is decided on the vectors themselves.
    # Divided by the power of two at their largest component, which rounds nothing, products neither vanish nor overflow.
    largest = F.array_max(F.transform("_v", lambda x: F.abs(x.cast("double"))))
    scaled = F.transform("_v", lambda x: x.cast("double") / F.pow(F.lit(2.0), F.floor(F.log2(largest))))
    end = lambda s: classes.select(F.col("rep").alias(s), scaled.alias(f"v_{s}"), F.col("size").alias(f"size_{s}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v)
    doubtful = found.where("open").select(F.col("rep").alias("a"), F.col("root").alias("b")).join(end("a"), "a").join(end("b"), "b")
    sure = doubtful.where(dot("v_a", "v_b") >= threshold * F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b"))).select("a", "b", "size_a", "size_b")
    sure = settle(sure, "decided", compact=True)
    links = found.where("not open").select("rep", "links").unionByName(sure.select(F.col("a").alias("rep"), F.col("size_b").alias("links"))).unionByName(sure.select(F.col("b").alias("rep"), F.col("size_a").alias("links")))
    reach = components(found.where("not open").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(sure.select("a", "b")))
    reach = settle(reach.withColumnRenamed("node", "rep"), "reach", compact=True)
    lowest = reach.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("lowest"))
    known = classes.select("_v", "rep", "size", "least").join(links.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(reach, "rep", "left")
    known = known.join(broadcast_if_small(lowest, limit=BROADCAST_ROWS), "component", "left")
    known = known.select("_v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "least").alias("component"))
    good = rows.where("_ok").join(known, "_v").select("_id", "n_links", "component")
    out = good.unionByName(rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component")))
    return out.select(F.col("_id").alias(key), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("_id") == F.col("component"), F.lit(False)).alias("kept"))


#: The links in DuckDB SQL, for small tables: every pair is compared.
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, len(e) AS d, sqrt(list_inner_product(e, e)) AS h FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND a.d = b.d AND list_inner_product(a.e, b.e) >= 0.95 * a.h * b.h),
c AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id AS a, vec_id AS c FROM g UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a AS vec_id, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m.c, vec_id) AS component_id, vec_id = coalesce(m.c, vec_id) AS kept FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN m USING (vec_id)
"""
