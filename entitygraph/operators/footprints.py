"""Footprints of entities in bins of the plane: parts that hang together, enclosed bins, bridges between parts.

Bins of a row that touch are one run.  Runs, and the gaps between runs, of neighbouring rows
are linked where they overlap; parts are components of runs, and enclosed bins are
components of gaps that nowhere reach the outside.  No task holds such an entity or its box.
Entities of few bins in a small box travel as one row each, and a worker fills many of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.functions.scalars import bin_of
from entitygraph.functions.storage import broadcast_if_small, settle
from entitygraph.operators.components import AT_ONCE, components

#: Runs meet in blocks of 2^6 bins.
BLOCK_BITS = 6
#: Bins of an entity, and of its box, up to which it travels as one row.
SMALL_BINS = 512
SMALL_BOX = 4096
#: Bins of boxes and pairs of bins that a worker holds at a time (about 100 MB).
AT_A_TIME = 500_000


def bins_of(rows: DataFrame, size: float, entity: str = "entity") -> DataFrame:
    """(entity, bx, by): the occupied bins of each entity; rows without label, x or y are left out."""
    placed = F.col(entity).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.where(placed).select(F.col(entity).alias("entity"), bin_of("x", size).cast("int").alias("bx"), bin_of("y", size).cast("int").alias("by")).distinct()


def runs(bins: DataFrame) -> DataFrame:
    """(entity, by, x0, x1): bins of a row without a gap, ends included."""
    along = Window.partitionBy("entity", "by").orderBy("bx")
    cut = bins.withColumn("_run", F.col("bx") - F.row_number().over(along))
    return cut.groupBy("entity", "by", "_run").agg(F.min("bx").alias("x0"), F.max("bx").alias("x1")).drop("_run")


def _node(by: Column, x: Column) -> Column:
    """A run as a text; numbers stand last, so names with colons are told apart."""
    return F.concat_ws(":", F.col("entity").cast("string"), by.cast("string"), x.cast("string"))


def _reach(spans: DataFrame) -> DataFrame:
    """(node, component) of spans (entity, by, x0, x1) that overlap one of a neighbouring row; a node is entity:by:x0.

    Spans are cut into blocks, and a pair counts in the block in which its overlap begins.
    """
    cut = spans.withColumn("block", F.explode(F.sequence(F.shiftright("x0", BLOCK_BITS), F.shiftright("x1", BLOCK_BITS))))
    below = cut.select("entity", (F.col("by") + 1).alias("by"), "block", F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    met = below.join(cut, ["entity", "by", "block"]).where("u0 <= x1 and x0 <= u1").where(F.shiftright(F.greatest("u0", "x0"), BLOCK_BITS) == F.col("block"))
    return components(met.select(_node(F.col("by") - 1, F.col("u0")).alias("a"), _node(F.col("by"), F.col("x0")).alias("b")), at_once=AT_ONCE)


def _with_component(spans: DataFrame, name: str) -> DataFrame:
    own = spans.withColumn("node", _node(F.col("by"), F.col("x0")))
    return own.join(_reach(spans), "node", "left").withColumn(name, F.coalesce("component", "node")).drop("node", "component")


def _bins(spans: DataFrame, *more: str) -> DataFrame:
    return spans.select("entity", F.explode(F.sequence("x0", "x1")).alias("bx"), "by", *more)


def parts(bins: DataFrame) -> DataFrame:
    """Bins with ``part``: the name of one run of those they reach over common sides."""
    return _bins(_with_component(settle(runs(bins), "runs"), "part"), "part")


def holes(bins: DataFrame) -> DataFrame:
    """(entity, bx, by) of the empty bins from which no way over common sides leads outside.

    A gap is open where it reaches beyond the outermost runs of the row above or below, or where that row is empty.
    """
    spans = settle(runs(bins), "runs")
    along = Window.partitionBy("entity", "by").orderBy("x0")
    gaps = spans.select("entity", "by", (F.col("x1") + 1).alias("x0"), (F.lead("x0").over(along) - 1).alias("x1")).where("x1 is not null")
    rows = spans.groupBy("entity", "by").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    for step, name in ((1, "up"), (-1, "down")):
        beside = rows.select("entity", (F.col("by") + step).alias("by"), "lo", "hi")
        gaps = gaps.join(beside, ["entity", "by"], "left").withColumn(name, F.col("lo").isNull() | (F.col("x0") < F.col("lo")) | (F.col("x1") > F.col("hi"))).drop("lo", "hi")
    gaps = settle(gaps.select("entity", "by", "x0", "x1", (F.col("up") | F.col("down")).alias("open")), "gaps")
    joined = settle(_with_component(gaps, "hollow"), "hollows")
    closed = joined.groupBy("hollow").agg(F.max("open").alias("any")).where("not any").select("hollow")
    return _bins(joined.join(closed, "hollow", "left_semi"))


def _cells(where: DataFrame, level: int) -> list[Column]:
    return [F.shiftright(c, 2 * level).alias(c) for c in ("bx", "by")]


def nearest_parts(where: DataFrame) -> DataFrame:
    """(entity, part, other, d, lo, hi): for every part (entity, bx, by, part) of several the nearest bins of another part.

    The distance is that along the axes; of equal ones the smallest ends (lo, then hi) come
    first.  Coordinates are at least 0.  Squares of 4^k bins are compared from coarse to fine: pairs
    that lie farther apart than the closest pair of the part must lie are dropped.  A square knows
    the first and last part in it, so a part meets squares and not other parts one by one.
    """
    far = where.agg(F.greatest(F.max("bx"), F.max("by"))).first()[0]
    top = 0
    while far is not None and far >> (2 * top):
        top += 1
    foreign = "p0 <> part or p1 <> part"
    pairs = None
    for level in range(top, -1, -1):
        side = 4**level
        own = where.select("entity", "part", *_cells(where, level)).distinct()
        full = where.select("entity", "part", *_cells(where, level)).groupBy("entity", "bx", "by").agg(F.min("part").alias("p0"), F.max("part").alias("p1"))
        full = full.withColumnsRenamed({"bx": "cx", "by": "cy"})
        if pairs is None:
            met = own.join(full, "entity")  # one square an entity
        else:
            up = lambda c: F.shiftright(c, 2).alias(f"_{c}")
            coarse = pairs.select("entity", "part", *(F.col(c).alias(f"_{c}") for c in ("bx", "by", "cx", "cy")))
            met = coarse.join(own.select("*", up("bx"), up("by")), ["entity", "part", "_bx", "_by"])
            met = met.join(full.select("*", up("cx"), up("cy")), ["entity", "_cx", "_cy"])
        dx, dy = F.abs(F.col("bx") - F.col("cx")) * side, F.abs(F.col("by") - F.col("cy")) * side
        least = F.greatest(dx - (side - 1), F.lit(0)) + F.greatest(dy - (side - 1), F.lit(0))
        met = met.where(foreign).select("entity", "part", "bx", "by", "cx", "cy", F.col("p0").alias("other"), least.alias("d"), (dx + dy + 2 * (side - 1)).alias("most"))
        met = settle(met, "near")
        bound = met.groupBy("entity", "part").agg(F.min("most").alias("bound"))
        pairs = met.join(bound, ["entity", "part"]).where("d <= bound")
    a, b = F.struct("bx", "by"), F.struct(F.col("cx").alias("bx"), F.col("cy").alias("by"))
    best = pairs.groupBy("entity", "part").agg(F.min(F.struct("d", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "other")).alias("t"))
    return best.select("entity", "part", "t.other", "t.d", "t.lo", "t.hi")


def line(ends: DataFrame) -> DataFrame:
    """(entity, bx, by) of straight lines between bins lo and hi: a step of the longer axis each, the shorter one rounded, halves towards lo."""
    dx, dy = F.col("hi.bx") - F.col("lo.bx"), F.col("hi.by") - F.col("lo.by")
    long_, short = F.greatest(F.abs(dx), F.abs(dy)), F.least(F.abs(dx), F.abs(dy))
    steps = ends.withColumns({"dx": dx, "dy": dy, "long": long_, "short": short}).withColumn("k", F.explode(F.sequence(F.lit(0), "long")))
    minor = F.ceil((2 * F.col("k") * F.col("short") - F.col("long")) / F.nullif(2 * F.col("long"), F.lit(0))).cast("int")
    off = lambda d: F.signum(d).cast("int") * F.when(F.abs(d) == F.col("long"), F.col("k")).otherwise(F.coalesce(minor, F.lit(0)))
    return steps.select("entity", (F.col("lo.bx") + off(F.col("dx"))).alias("bx"), (F.col("lo.by") + off(F.col("dy"))).alias("by"))


def spanning_links(bins: DataFrame) -> DataFrame:
    """(entity, d, lo, hi): the shortest set of links that makes one of each entity's parts, ends in coordinates from the entity's corner.

    Every part takes its nearest other part, what is linked becomes one part, and so on.  As pairs
    are in a total order, the links are those of the minimal spanning tree.  Links run between parts, not from earlier links.
    """
    where = settle(parts(bins), "parts")
    links = None
    while True:
        several = where.groupBy("entity").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1").select("entity")
        where = settle(where.join(several, "entity", "left_semi"), "parts")
        if where.isEmpty():
            return where.selectExpr("entity", "0 AS d", "struct(bx, by) AS lo", "struct(bx, by) AS hi") if links is None else links
        near = settle(nearest_parts(where), "links", compact=True)
        found = near.select("entity", "d", "lo", "hi").distinct()
        links = found if links is None else links.unionByName(found)
        merged = components(near.select(F.col("part").alias("a"), F.col("other").alias("b")), at_once=AT_ONCE).withColumnRenamed("node", "part")
        where = where.join(merged, "part").drop("part").withColumnRenamed("component", "part")


def bridges(bins: DataFrame) -> DataFrame:
    """(entity, bx, by) of the empty bins on straight lines that link each entity's parts to one."""
    corner = bins.groupBy("entity").agg(F.min("bx").alias("x0"), F.min("by").alias("y0"))
    moved = bins.join(corner, "entity").select("entity", (F.col("bx") - F.col("x0")).alias("bx"), (F.col("by") - F.col("y0")).alias("by"))
    lines = line(spanning_links(moved)).join(corner, "entity").select("entity", (F.col("bx") + F.col("x0")).alias("bx"), (F.col("by") + F.col("y0")).alias("by"))
    return lines.distinct().join(bins, ["entity", "bx", "by"], "left_anti")


# --- small entities ------------------------------------------------------------------------------


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (u, v) lead to."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, root[u], low)
        np.minimum.at(after, root[v], low)
        while (after[after] != after).any():
            after = after[after]
        root = after
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return root


def _sides(mask: np.ndarray, stride: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between bins of the mask that share a side; the next row of a box lies ``stride`` bins on."""
    u = np.flatnonzero(mask)
    links = []
    for v, rims_too in ((u + 1, True), (u + stride[u], False)):
        ok = v < len(mask)
        ok[ok] = mask[v[ok]] & (rims_too | (box[v[ok]] == box[u[ok]]))
        links.append((u[ok], v[ok]))
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def _tree(owner: np.ndarray, x: np.ndarray, y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (lo, hi) of the minimal spanning tree of every owner's parts, as places in the bins, which come by owner, x and y.

    Pairs are numbered in the order (distance, lo, hi), so every part takes its first, what is linked becomes one part, and so on.
    """
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[first, len(owner)])
    after = np.repeat(first + size, size) - np.arange(len(owner)) - 1
    lo = np.repeat(np.arange(len(owner)), after)
    hi = lo + 1 + np.arange(len(lo)) - np.repeat(np.cumsum(after) - after, after)
    cross = part[lo] != part[hi]
    lo, hi = lo[cross], hi[cross]
    order = np.argsort(np.abs(x[lo] - x[hi]) + np.abs(y[lo] - y[hi]), kind="stable")
    lo, hi = lo[order], hi[order]
    rank, label, found = np.arange(len(lo)), np.unique(part, return_inverse=True)[1], []
    while len(rank):
        a, b = label[lo[rank]], label[hi[rank]]
        best = np.full(label.max() + 1, len(lo))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        taken = np.unique(best[best < len(lo)])
        found.append(taken)
        label = _roots(len(best), label[lo[taken]], label[hi[taken]])[label]
        rank = rank[label[lo[rank]] != label[hi[rank]]]
    taken = np.concatenate(found) if found else rank
    return lo[taken], hi[taken]


def _steps(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the line, x, y) of the bins of :func:`line` from (x0, y0) to (x1, y1)."""
    dx, dy = x1 - x0, y1 - y0
    long_, short = np.maximum(np.abs(dx), np.abs(dy)), np.minimum(np.abs(dx), np.abs(dy))
    of = np.repeat(np.arange(len(dx)), long_ + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(long_ + 1) - long_ - 1, long_ + 1)
    minor = -((long_[of] - 2 * k * short[of]) // (2 * long_[of]))
    off = lambda d: np.sign(d[of]) * np.where(np.abs(d[of]) == long_[of], k, minor)
    return of, x0[of] + off(dx), y0[of] + off(dy)


def fill(owner: np.ndarray, x: np.ndarray, y: np.ndarray, bridged: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, x, y, kind) of the footprints of many small entities from their distinct bins; owners are 0, 1, ...; kinds are 0 raw, 1 bridge, 2 hole.

    Each box, with a rim of empty bins, is laid out bin by bin in one row; rims touch, so what is linked to the first bin is outside.
    """
    order = np.lexsort((y, x, owner))
    owner, x, y = owner[order], x[order].astype(np.int64), y[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    x0, y0 = np.minimum.reduceat(x, first) - 1, np.minimum.reduceat(y, first) - 1
    high = np.maximum.reduceat(y, first) - y0 + 2
    cells = (np.maximum.reduceat(x, first) - x0 + 2) * high
    start = np.cumsum(cells) - cells
    box, stride = np.repeat(np.arange(len(first)), cells), np.repeat(high, cells)
    own = np.cumsum(np.r_[True, owner[1:] != owner[:-1]]) - 1
    place = lambda b, x, y: start[b] + (x - x0[b]) * high[b] + (y - y0[b])
    at = place(own, x, y)
    kind = np.full(len(box), 3, np.int8)
    kind[at] = 0
    if bridged:
        part = _roots(len(box), *_sides(kind == 0, stride, box))[at]
        several = np.repeat(np.minimum.reduceat(part, first) < np.maximum.reduceat(part, first), np.diff(np.r_[first, len(x)]))
        if several.any():
            b, bx, by = own[several], x[several], y[several]
            lo, hi = _tree(b, bx, by, part[several])
            of, lx, ly = _steps(bx[lo], by[lo], bx[hi], by[hi])
            on = place(b[lo][of], lx, ly)
            kind[on[kind[on] == 3]] = 1
    out = _roots(len(box), *_sides(kind == 3, stride, box))
    kind[(kind == 3) & (out > 0)] = 2
    found = np.flatnonzero(kind < 3)
    b, within = box[found], found - start[box[found]]
    return owner[first][b], x0[b] + within // high[b], y0[b] + within % high[b], kind[found]


def _in_turns(batches: Iterator[pa.RecordBatch], bridged: bool) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """Rows (entity, n_points, bins) so many at a time as a worker can hold, with their footprints."""
    for batch in (b for b in batches if b.num_rows):
        n = pc.list_value_length(batch.column("bins")).to_numpy(zero_copy_only=False).astype(np.int64)
        turn = np.cumsum(n * n // 2 + batch.column("box").to_numpy(zero_copy_only=False)) // AT_A_TIME
        ends = np.r_[np.flatnonzero(np.diff(turn)) + 1, len(n)]
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            part = batch.slice(a, b - a)
            x, y = (c.to_numpy(zero_copy_only=False) for c in part.column("bins").flatten().flatten())
            yield part, fill(np.repeat(np.arange(b - a), n[a:b]), x, y, bridged)


KINDS = ("raw", "bridge", "hole")


def _counted(rows: DataFrame, size: float, entity: str) -> DataFrame:
    """(entity, bx, by, n): occupied bins with their rows."""
    placed = F.col(entity).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    at = (F.col(entity).alias("entity"), bin_of("x", size).cast("int").alias("bx"), bin_of("y", size).cast("int").alias("by"))
    return settle(rows.where(placed).groupBy(*at).agg(F.count("*").alias("n")), "bins")


def _by_size(counted: DataFrame, small_bins: int) -> tuple[DataFrame, DataFrame | None]:
    """Small entities as rows (entity, n_points, bins, box), and the bins of the others, if there are any."""
    side = lambda c: F.max(c).cast("long") - F.min(c).cast("long") + 3
    box = (side("bx") * side("by")).alias("box")
    # A product beyond a long is no small box either.
    wide = (side("bx") > SMALL_BOX) | (side("by") > SMALL_BOX)
    large = counted.groupBy("entity").agg(F.count("*").alias("c"), wide.alias("wide"), F.when(~wide, side("bx") * side("by")).alias("box"))
    large = settle(large.where((F.col("c") > small_bins) | F.col("wide") | (F.col("box") > SMALL_BOX)).select("entity"), "large", compact=True)
    n_large = large.count()
    mine = counted.join(broadcast_if_small(large, n_large), "entity", "left_anti") if n_large else counted
    small = mine.groupBy("entity").agg(F.sum("n").alias("n_points"), F.collect_list(F.struct("bx", "by")).alias("bins"), box)
    return small, counted.join(broadcast_if_small(large, n_large), "entity", "left_semi") if n_large else None


def _kinds_of_large(counted: DataFrame, bridged: bool) -> DataFrame:
    raw = settle(counted.select("entity", "bx", "by"), "bins")
    known = raw.withColumn("kind", F.lit("raw"))
    if bridged:
        known = settle(known.unionByName(bridges(raw).withColumn("kind", F.lit("bridge"))), "bridged")
    return known.unionByName(holes(known.select("entity", "bx", "by")).withColumn("kind", F.lit("hole")))


def kinds(rows: DataFrame, size: float, entity: str = "entity", bridged: bool = True, small_bins: int = SMALL_BINS) -> DataFrame:
    """(entity, bx, by, kind) of each entity's footprint: bins that are ``raw`` (occupied), a ``bridge``, or a ``hole`` enclosed by these."""
    counted = _counted(rows, size, entity)
    small, large = _by_size(counted, small_bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (owner, x, y, kind) in _in_turns(batches, bridged):
            names = pa.array(KINDS).take(pa.array(kind))
            yield pa.RecordBatch.from_arrays([part.column("entity").take(pa.array(owner)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), names], ["entity", "bx", "by", "kind"])

    found = small.mapInArrow(run, f"entity {dict(counted.dtypes)['entity']}, bx int, by int, kind string")
    return found if large is None else found.unionByName(_kinds_of_large(large, bridged))


def footprint(rows: DataFrame, size: float, entity: str = "entity", bridged: bool = False) -> DataFrame:
    """(entity, bx, by) of the occupied bins of each entity, with all empty bins that they enclose on four sides filled.

    With ``bridged``, bins that link its parts count as occupied.
    """
    return kinds(rows, size, entity, bridged).select("entity", "bx", "by")


def footprint_density(rows: DataFrame, size: float, entity: str = "entity", small_bins: int = SMALL_BINS) -> DataFrame:
    """Per entity: its points, raw, bridge, hole and filled bins, and points a filled bin.

    Entities that merge what does not belong together have many bridges and holes, and so a low density.
    """
    counted = _counted(rows, size, entity)
    small, large = _by_size(counted, small_bins)
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (owner, _, _, kind) in _in_turns(batches, True):
            of_kind = np.bincount(owner * len(KINDS) + kind, minlength=part.num_rows * len(KINDS)).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([part.column("entity"), part.column("n_points"), *(pa.array(c.astype(np.int64)) for c in of_kind.T)], ["entity", "n_points", *names])

    found = small.mapInArrow(run, f"entity {dict(counted.dtypes)['entity']}, n_points long, " + ", ".join(f"{n} long" for n in names))
    if large is not None:
        of_kind = _kinds_of_large(large, True).groupBy("entity").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))
        found = found.unionByName(large.groupBy("entity").agg(F.sum("n").alias("n_points")).join(of_kind, "entity"))
    filled = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return found.withColumn("n_filled", filled).withColumn("density", F.col("n_points") / F.col("n_filled"))
