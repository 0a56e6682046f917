"""Delaunay neighbours in the plane and in space, point by point, without one triangulation.

Two points are neighbours where their Voronoi cells share a side.  A point's cell is a large box cut
by the planes halfway to other points, nearest first.  Once all corners lie within R of the point and
all others within 2 R have been tried, no farther one can cut it: the cell is certified.  So
tiles with a halo settle most points.  A corner is as far from the point as from its neighbours there: two
points that share one beyond the halo's reach both stay open.  So open points meet only each other in
wider halos, beside what bounded them so far, and those on the outer rim, whose cells have no end, meet all
open ones part by part: what bounds a cell among all points bounds it in its own part too.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitygraph.functions.scalars import bin_of
from entitygraph.functions.storage import settle

#: Points of the fullest tile of the first turn; a halo has three tiles in every direction.
TILE_POINTS = 150
#: Tiles along a side of a block, by the number of axes.
BLOCK = {2: 8, 3: 4}
#: Points of a part that open cells are cut by.
PART_POINTS = 20_000
#: Open points from which halos are not widened any more.
OPEN_POINTS = 500
#: Half the side of the box, in extents: a simplex whose centre lies farther out is flat and counts as none.
BOX = 1e4
#: Share of a squared distance by which a plane must pass a corner to cut it.
TOUCH = 1e-10
#: Nearest points that are tried before all of a tile's are sorted.
FIRST = 48


def cell_of(at: np.ndarray, others: np.ndarray, box: float) -> tuple[np.ndarray, float]:
    """Numbers of the points that bound the Voronoi cell of ``at`` among ``others``, and the distance of its farthest corner.

    Corners are kept by the planes that meet there, so the form of the cell never hangs on
    rounding; a plane that only touches a corner does not bound it.
    """
    dims = len(at)
    d = others - at
    far = (d * d).sum(1)
    order = np.argsort(far, kind="stable") if len(far) <= FIRST else np.argpartition(far, FIRST)[:FIRST]
    order = order[np.argsort(far[order], kind="stable")]
    # Planes -1, -2, ... are sides of the box: in pairs by axis.
    corners: dict[tuple[int, ...], np.ndarray] = {}
    for bits in range(1 << dims):
        sides = tuple(-1 - 2 * k - (bits >> k & 1) for k in range(dims))
        corners[tuple(sorted(sides))] = np.array([box if bits >> k & 1 else -box for k in range(dims)])
    reach, tried = box * dims**0.5, 0
    while tried < len(order):
        k = int(order[tried])
        if far[k] > 4 * reach * reach:
            break
        tried += 1
        if far[k] > 0:
            over = {c: float(v @ d[k] - far[k] / 2) for c, v in corners.items()}
            over = {c: o if o > TOUCH * far[k] else min(o, 0.0) for c, o in over.items()}
            gone = [c for c, o in over.items() if o > 0]
            if gone:
                ends: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
                for c in corners:
                    for edge in combinations(c, dims - 1):
                        ends.setdefault(edge, []).append(c)
                for c in gone:
                    for edge in combinations(c, dims - 1):
                        for other in ends[edge]:
                            if over[other] <= 0:
                                planes = tuple(sorted((*edge, k)))
                                share = over[other] / (over[other] - over[c])
                                corners[planes] = corners[other] + share * (corners[c] - corners[other])
                                if planes[0] >= 0:  # away from the box, whose far corners would cost digits
                                    corners[planes] = _meet(d[list(planes)], far[list(planes)] / 2, corners[planes])
                for c in gone:
                    del corners[c]
                reach = max(float(v @ v) for v in corners.values()) ** 0.5
        if tried == len(order) < len(far):
            rest = np.setdiff1d(np.flatnonzero(far <= 4 * reach * reach), order, assume_unique=True)
            if not len(rest):
                break
            order = np.concatenate([order, rest[np.argsort(far[rest], kind="stable")]])
    return np.array(sorted({p for c in corners for p in c if p >= 0}), int), reach


def _meet(normals: np.ndarray, offsets: np.ndarray, else_: np.ndarray) -> np.ndarray:
    """Where planes meet; ``else_`` where they hardly do."""
    try:
        return np.linalg.solve(normals, offsets)
    except np.linalg.LinAlgError:
        return else_


#: Cells that one worker cuts at a time, and distances that it holds at once.
CELLS, MOST_DISTANCES = 4_096, 2_000_000


def _cut(d: np.ndarray, far: np.ndarray, box: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """:func:`cell_of` for many points in step: what bounds each cell, its reach, which cells lost their form, and all corners.

    ``d`` (cell, turn, axis) are the others' displacements, nearest first, and ``far`` their squared lengths, infinite where there are no
    more.  Corners of all cells are one table; an edge is the two corners of a cell that share all planes but one.
    """
    n, turns, dims = d.shape
    base, signs = [], []
    for bits in range(1 << dims):
        base.append(sorted(-1 - 2 * k - (bits >> k & 1) for k in range(dims)))
        signs.append([box if bits >> k & 1 else -box for k in range(dims)])
    own, planes, v = np.repeat(np.arange(n), 1 << dims), np.tile(np.array(base), (n, 1)), np.tile(np.array(signs), (n, 1))
    reach2, lost = np.full(n, box * box * dims), np.zeros(n, bool)
    at_rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = turns + 2 * dims + 1
    for j in range(turns):
        f = far[:, j]
        live = (f <= 4 * reach2) & np.isfinite(f) & ~lost
        if not live.any():
            break
        if j % 8 == 7:
            rests = ~live[own]
            at_rest.append((own[rests], planes[rests], v[rests]))
            own, planes, v = own[~rests], planes[~rests], v[~rests]
        at = np.flatnonzero(live[own])
        o = own[at]
        over = np.einsum("ij,ij->i", v[at], d[o, j]) - f[o] / 2
        gone = over > TOUCH * f[o]
        if not gone.any():
            continue
        hit = np.zeros(n, bool)
        hit[o[gone]] = True
        among = hit[o]
        at, o, over, gone = at[among], o[among], np.where(gone, over, np.minimum(over, 0.0))[among], gone[among]
        keys = []
        for k in range(dims):
            key = o.astype(np.int64)
            for m in range(dims):
                if m != k:
                    key = key * width + planes[at, m] + 2 * dims
            keys.append(key)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, corner = key[order], order % len(o)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        long = np.diff(np.append(starts, len(key)))
        if (long != 2).any():  # rounding left a cell without its form
            lost[o[corner[starts[long != 2]]]] = True
            starts = starts[long == 2]
        a, b = corner[starts], corner[starts + 1]
        crosses = (gone[a] != gone[b]) & ~lost[o[a]]
        a, b, edge = a[crosses], b[crosses], key[starts[crosses]]
        out, stays = np.where(gone[a], a, b), np.where(gone[a], b, a)
        made = np.empty((len(out), dims), np.int64)
        made[:, -1] = j
        for m in range(dims - 2, -1, -1):
            made[:, m] = edge % width - 2 * dims
            edge = edge // width
        share = over[stays] / (over[stays] - over[out])
        new = v[at[stays]] + share[:, None] * (v[at[out]] - v[at[stays]])
        inner = np.flatnonzero(made[:, 0] >= 0)  # away from the box, whose far corners would cost digits
        if len(inner):
            c = o[stays[inner]][:, None]
            new[inner] = _meet_all(d[c, made[inner]], far[c, made[inner]] / 2, new[inner])
        keep = np.ones(len(own), bool)
        keep[at[gone]] = False
        own, planes, v = np.concatenate([own[keep], o[stays]]), np.concatenate([planes[keep], made]), np.concatenate([v[keep], new])
        mine = hit[own]
        reach2[hit] = 0.0
        np.maximum.at(reach2, own[mine], (v[mine] ** 2).sum(1))
    at_rest.append((own, planes, v))
    own, planes, v = (np.concatenate(x) for x in zip(*at_rest, strict=True))
    bounds = np.zeros((n, turns), bool)
    for k in range(dims):
        bounds[own[planes[:, k] >= 0], planes[planes[:, k] >= 0, k]] = True
    return bounds, np.sqrt(reach2), lost, (own, v)


def _meet_all(normals: np.ndarray, offsets: np.ndarray, else_: np.ndarray) -> np.ndarray:
    """:func:`_meet` of many sets of planes."""
    try:
        return np.linalg.solve(normals, offsets[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.stack([_meet(*x) for x in zip(normals, offsets, else_, strict=True)])


def _nearest(at: np.ndarray, pool: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest of the pool (or all) for each point, in rising order of their numbers."""
    if len(pool) <= k:
        return np.tile(np.arange(len(pool)), (len(at), 1))
    out, step = [], max(1, MOST_DISTANCES // len(pool))
    for s in range(0, len(at), step):
        far = sum((at[s : s + step, None, c] - pool[None, :, c]) ** 2 for c in range(at.shape[1]))
        out.append(np.sort(np.argpartition(far, k, axis=1)[:, :k], axis=1))
    return np.concatenate(out)


def cells_of(at: np.ndarray, pool: np.ndarray, box: float, tiles: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, other) by number, and the reach of every cell: :func:`cell_of` for many points at a time.

    ``tiles`` are (numbers of points, numbers of the pool that they meet); by default all meet all.  Cells are cut by the
    nearest first.  Where others may still reach a cell, those nearest to its corners cut it, until no corner lies nearer to another point.
    """
    cells, others, reach = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(at))
    todo: list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]] = []  # (cell, its pool, what cuts it, what was tried before)

    def turn() -> None:
        which = np.array([t[0] for t in todo])
        near = np.full((len(todo), max(len(t[2]) for t in todo)), -1)
        for i, t in enumerate(todo):
            near[i, : len(t[2])] = t[2]
        d = pool[near] - at[which][:, None]
        far = (d * d).sum(2)
        far[(near < 0) | (far == 0)] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        near, far, d = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(d, order[..., None], 1)
        bounds, r, lost, (own, v) = _cut(d, far, box)
        reach[which] = r
        by_cell = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[by_cell], np.arange(len(todo) + 1))
        last = np.where(np.isfinite(far), far, 0.0).max(1)
        asks = lost | np.array([len(t[2]) < len(t[1]) if t[3] is None else True for t in todo]) & (np.array([t[3] is not None for t in todo]) | (last <= 4 * r * r))
        final, more = ~lost, []
        for i in np.flatnonzero(asks):
            cell, mine, cuts, tried = todo[i]
            if lost[i]:
                found, reach[cell] = cell_of(at[cell], pool[mine], box)
                cells.append(np.full(len(found), cell))
                others.append(mine[found])
                continue
            tried = cuts if tried is None else np.union1d(tried, cuts)
            rest = np.setdiff1d(mine, tried, assume_unique=True)
            e = pool[rest] - at[cell]
            e2 = (e * e).sum(1)
            can = (e2 > 0) & (e2 <= 4 * r[i] * r[i])
            rest, e, e2 = rest[can], e[can], e2[can]
            if len(rest):
                over = v[by_cell[ends[i] : ends[i + 1]]] @ e.T - e2 / 2
                over[over <= TOUCH * e2] = -np.inf
                new = rest[np.unique(over.argmax(1)[over.max(1) > -np.inf])]
                if len(new):
                    more.append((cell, mine, np.concatenate([near[i][bounds[i]], new]), tried))
                    final[i] = False
        i, j = np.nonzero(bounds & final[:, None])
        cells.append(which[i])
        others.append(near[i, j])
        todo[:] = more

    everyone = [(np.arange(len(at)), np.arange(len(pool)))]
    for who, mine in (everyone if tiles is None else tiles) if len(pool) else []:
        for s in range(0, len(who), CELLS):
            part = who[s : s + CELLS]
            todo += [(c, mine, row, None) for c, row in zip(part.tolist(), mine[_nearest(at[part], pool[mine], FIRST)], strict=True)]
            while len(todo) >= CELLS:
                turn()
    while todo:
        turn()
    return np.concatenate(cells), np.concatenate(others), reach


def _tiles(at: np.ndarray, pool: np.ndarray, size: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Points by squares or cubes of ``size``, with all of the pool in them and around."""
    dims = at.shape[1]
    mine, theirs = np.floor(at / size).astype(np.int64), np.floor(pool / size).astype(np.int64)
    low = np.minimum(mine.min(0), theirs.min(0)) - 1
    width = np.maximum(mine.max(0), theirs.max(0)) + 2 - low
    key = lambda b: np.ravel_multi_index(tuple((b - low).T), tuple(width.tolist()))
    order = np.argsort(key(theirs), kind="stable")
    places, (names, first) = key(theirs)[order], np.unique(key(mine), return_index=True)
    by_tile = np.argsort(key(mine), kind="stable")
    ends = np.append(np.searchsorted(key(mine)[by_tile], names), len(at))
    out = []
    for k, f in enumerate(first):
        # Tiles that follow one another along the last axis are one run of the sorted pool.
        rows = [mine[f] + np.array([*o, -1]) for o in product((-1, 0, 1), repeat=dims - 1)]
        runs = [(int(key(row[None])[0]), int(key(row[None])[0]) + 2) for row in rows]
        met = [order[np.searchsorted(places, a) : np.searchsorted(places, b, "right")] for a, b in runs]
        out.append((by_tile[ends[k] : ends[k + 1]], np.sort(np.concatenate(met))))
    return out


def _names(axes: tuple[str, ...]) -> list[str]:
    return [f"b{k}" for k in range(len(axes))]


def _found(kind: str, axes: tuple[str, ...]) -> str:
    return f"id {kind}, other {kind}, length double, sure boolean, " + ", ".join(f"{c}{s} double" for s in ("", "_o") for c in axes)


def _bound(table: pa.Table, axes: tuple[str, ...], box: float, size: float | None) -> pa.Table:
    """Of the table's own points, what bounds their cells among its others; ``sure`` where nothing farther than ``size`` can (None: always).

    Each point has a row at least, and its place and the other's.
    """
    own = table["own"].to_numpy()
    x = np.stack([table[c].to_numpy() for c in axes], 1)
    ids = table["id"].combine_chunks()
    mine, theirs = np.flatnonzero(own), np.flatnonzero(~own)
    # In the order of their places, each once: results never hang on the order of rows.
    theirs = theirs[np.lexsort(x[theirs].T)]
    if len(theirs):
        theirs = theirs[np.concatenate([[True], (np.diff(x[theirs], axis=0) != 0).any(1)])]
    at, pool = x[mine], x[theirs]
    tiles = _tiles(at, pool, size) if size is not None and len(at) and len(pool) else None
    cell, other, reach = cells_of(at, pool, box, tiles)
    lone = np.setdiff1d(np.arange(len(at)), cell)
    sure = np.ones(len(at), bool) if size is None else 2 * reach <= size * (1 - 1e-6)
    a, b = np.concatenate([mine[cell], mine[lone]]), np.concatenate([theirs[other], np.full(len(lone), -1)])
    to = pa.array(b, mask=b < 0)
    d = x[a] - x[b]
    columns = {"id": ids.take(pa.array(a)), "other": ids.take(to), "length": pa.array(np.sqrt((d * d).sum(1)), mask=b < 0), "sure": pa.array(np.concatenate([sure[cell], sure[lone]]))}
    for k, c in enumerate(axes):
        columns[c] = pa.array(x[a, k])
    for k, c in enumerate(axes):
        columns[f"{c}_o"] = pa.array(x[b, k], mask=b < 0)
    return pa.table(columns)


def _others(open_: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """What bounded open cells so far, as others beside the place of the cell."""
    return open_.where("other is not null").select(F.col("other").alias("id"), *(F.col(f"{c}_o").alias(c) for c in axes), *(F.col(c).alias(f"{c}_at") for c in axes))


def _settle_tiles(points: DataFrame, open_: DataFrame | None, axes: tuple[str, ...], size: float, box: float) -> DataFrame:
    """What bounds the cells of ``points`` among themselves within ``size``, and among what bounded them so far (``open_``); see :func:`_bound`.

    Tiles meet in blocks, so that a point is repeated at the rims of blocks only.
    """
    bins, edge, slack = _names(axes), size * BLOCK[len(axes)], size * (1 + 1e-9)
    place = lambda cs: [F.floor(F.col(c) / edge).alias(b) for c, b in zip(cs, bins, strict=True)]
    own = points.select("id", *axes, *place(axes), F.lit(True).alias("own"))
    around = [F.sequence(F.floor((F.col(c) - slack) / edge), F.floor((F.col(c) + slack) / edge)).alias(b) for c, b in zip(axes, bins, strict=True)]
    halo = points.select("id", *axes, *around)
    for b in bins:
        halo = halo.withColumn(b, F.explode(b))
    both = own.unionByName(halo.withColumn("own", F.lit(False)))
    if open_ is not None:
        both = both.unionByName(_others(open_, axes).select("id", *axes, *place([f"{c}_at" for c in axes])).distinct().withColumn("own", F.lit(False)))
    return both.groupBy(*bins).applyInArrow(lambda t: _bound(t, axes, box, size), _found(dict(points.dtypes)["id"], axes))


def _settle_parts(points: DataFrame, open_: DataFrame | None, axes: tuple[str, ...], n: int, part_points: int, box: float) -> DataFrame:
    """What bounds the cells of the n ``points`` among themselves and what bounded them so far: that of every part of them, cut once more."""
    kind = dict(points.dtypes)["id"]
    parts, shares = max(1, -(-n // part_points)), max(1, -(-n // OPEN_POINTS))
    share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share")
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    dealt = points.select("id", *axes, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("own")).select("*", every(shares, "share"))
    asked = points.select("id", *axes, share, F.lit(True).alias("own")).select("*", every(parts, "part"))
    found = dealt.unionByName(asked).groupBy("part", "share").applyInArrow(lambda t: _bound(t, axes, box, None), _found(kind, axes))
    if parts == 1 and open_ is None:
        return found
    cut = found if open_ is None else found.unionByName(open_)
    own = points.select("id", *axes, F.lit(True).alias("own"), share)
    cut = cut.where("other is not null").select(F.col("other").alias("id"), *(F.col(f"{c}_o").alias(c) for c in axes), F.lit(False).alias("own"), share).distinct()
    return own.unionByName(cut).groupBy("share").applyInArrow(lambda t: _bound(t, axes, box, None), _found(kind, axes))


def neighbours(points: DataFrame, axes: tuple[str, ...] = ("x", "y"), tile_points: int = TILE_POINTS, open_points: int = OPEN_POINTS, part_points: int = PART_POINTS) -> DataFrame:
    """(a, b, length), a < b, of all Delaunay neighbours of points (id, *axes) in two or three dimensions.

    Of points in one place the first by id takes part; points with a null coordinate do not.
    Where more points than needed lie on one empty circle or sphere, only those whose cells share
    a side of some extent are neighbours.
    """
    if len(axes) not in (2, 3):
        raise ValueError("two or three axes")
    placed = points.where(" and ".join(f"{c} is not null" for c in axes)).groupBy(*(F.col(c).cast("double").alias(c) for c in axes)).agg(F.min("id").alias("id"))
    placed = settle(placed.select("id", *axes), "placed")
    ends = placed.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{s}") for c in axes for s, f in ((0, F.min), (1, F.max)))).first()
    extent = max(((ends[f"{c}1"] - ends[f"{c}0"]) if ends.n else 0.0 for c in axes), default=0.0) or 1.0
    box, size = BOX * extent, extent
    fullest = lambda s: placed.groupBy(*(bin_of(c, s).alias(b) for c, b in zip(axes, _names(axes), strict=True))).count().agg(F.max("count")).first()[0] or 0
    most = fullest(size)
    while most > tile_points and size > extent * 1e-6:
        size = size * max(0.25, min(0.8, (tile_points / most) ** (1 / len(axes))))
        most = fullest(size)
    todo, open_, found, left = placed, None, [], ends.n
    while left > open_points and size < extent:
        told = settle(_settle_tiles(todo, open_, axes, size, box), "tiles")
        found.append(told.where("sure"))
        open_ = told.where("not sure")
        todo = settle(open_.select("id", *axes).distinct(), "open", compact=True)
        before, left = left, todo.count()
        size *= 2
        if left > before // 2 and left <= 20 * open_points:
            break
    found.append(_settle_parts(todo, open_, axes, left, part_points, box))
    rows = [f.where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "length") for f in found]
    return reduce(DataFrame.unionByName, rows).groupBy("a", "b").agg(F.min("length").alias("length"))
