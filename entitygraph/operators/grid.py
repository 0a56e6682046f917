"""Grid bins of entities: indexes, neighbour witnesses and candidate pairs.

Points are aggregated to (bin, entity, count) before anything is paired, so the cost
of a dense bin is that of its entities, not of its points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.functions import labels as L
from entitygraph.functions.scalars import bin_of, offsets_column, xy_half_offsets, xy_offsets

#: Bins must fit a signed 32-bit number (checked by :func:`build_index`).
LARGEST_BIN = 2**31 - 1


def _live(rows: DataFrame, entity: str) -> DataFrame:
    return rows.where(~L.is_unassigned(entity) & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))


def build_index(rows: DataFrame, size: float, z_size: float | None = None, entity: str = "entity") -> DataFrame:
    """(bx, by, bz, entity, n) of assigned rows with coordinates; bz is 0 without ``z_size``."""
    if size <= 0 or (z_size is not None and z_size <= 0):
        raise ValueError("bin sizes must be positive")
    live = _live(rows, entity)
    bz = bin_of("z", z_size) if z_size is not None else F.lit(0)
    far = F.greatest(F.abs(F.col("x")), F.abs(F.col("y"))) / F.lit(float(size)) >= F.lit(float(LARGEST_BIN))
    live = live.where(F.when(far, F.raise_error(F.lit("coordinates lie beyond the largest bin")).cast("boolean")).otherwise(F.lit(True)))
    return live.groupBy(bin_of("x", size).alias("bx"), bin_of("y", size).alias("by"), bz.alias("bz"), F.col(entity).alias("entity")).agg(F.count("*").alias("n"))


def witness_pairs(index: DataFrame, neighborhood: str = "8", z_depth: int = 0, witness_min: int = 1, cap_at_size: bool = False) -> DataFrame:
    """(lo, hi, n_lo, n_hi, n_records) of entities in equal or neighbouring bins.

    n_records sums the products of counts over pairs of bins; n_lo and n_hi count each
    entity's points over its distinct bins that face the other.  Both must reach
    ``witness_min`` (or the entity's size, if smaller and ``cap_at_size``).
    """
    offsets = [(dx, dy, dz) for dx, dy in xy_half_offsets(neighborhood) for dz in range(-z_depth, z_depth + 1) if (dx, dy) != (0, 0) or dz >= 0]
    left = index.withColumn("o", F.explode(offsets_column(offsets))).select((F.col("bx") + F.col("o.d0")).alias("bx"), (F.col("by") + F.col("o.d1")).alias("by"), (F.col("bz") + F.col("o.d2")).alias("bz"), F.struct("bx", "by", "bz").alias("bin_a"), F.col("entity").alias("a"), F.col("n").alias("n_a"), ((F.col("o.d0") == 0) & (F.col("o.d1") == 0) & (F.col("o.d2") == 0)).alias("own"))
    right = index.select("bx", "by", "bz", F.struct("bx", "by", "bz").alias("bin_b"), F.col("entity").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, ["bx", "by", "bz"]).where((F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b"))))
    flip = F.col("a") > F.col("b")
    met = met.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.when(flip, F.col("bin_b")).otherwise(F.col("bin_a")).alias("bin_lo"), F.when(flip, F.col("bin_a")).otherwise(F.col("bin_b")).alias("bin_hi"), F.when(flip, F.col("n_b")).otherwise(F.col("n_a")).alias("c_lo"), F.when(flip, F.col("n_a")).otherwise(F.col("n_b")).alias("c_hi"))
    low = met.groupBy("lo", "hi", "bin_lo").agg(F.max("c_lo").alias("c"), F.sum(F.col("c_lo") * F.col("c_hi")).alias("records")).groupBy("lo", "hi").agg(F.sum("c").alias("n_lo"), F.sum("records").alias("n_records"))
    high = met.groupBy("lo", "hi", "bin_hi").agg(F.max("c_hi").alias("c")).groupBy("lo", "hi").agg(F.sum("c").alias("n_hi"))
    out = low.join(high, ["lo", "hi"]).select("lo", "hi", "n_lo", "n_hi", "n_records")
    if not cap_at_size:
        return out.where((F.col("n_lo") >= witness_min) & (F.col("n_hi") >= witness_min))
    size = index.groupBy("entity").agg(F.sum("n").alias("s"))
    out = out.join(size.select(F.col("entity").alias("lo"), F.col("s").alias("s_lo")), "lo").join(size.select(F.col("entity").alias("hi"), F.col("s").alias("s_hi")), "hi")
    return out.where((F.col("n_lo") >= F.least(F.lit(witness_min), "s_lo")) & (F.col("n_hi") >= F.least(F.lit(witness_min), "s_hi"))).select("lo", "hi", "n_lo", "n_hi", "n_records")


def supported(met: DataFrame, least: int | str, index: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`witness_pairs` that at least ``least`` pairs of points speak for.

    ``"min"`` asks for as many as the smaller entity of a pair has points in ``index``.
    """
    if least != "min":
        return met.where(F.col("n_records") >= int(least))
    if index is None:
        raise ValueError("'min' needs the index that the pairs come from")
    size = index.groupBy("entity").agg(F.sum("n").alias("s"))
    sized = met.join(size.select(F.col("entity").alias("lo"), F.col("s").alias("s_lo")), "lo").join(size.select(F.col("entity").alias("hi"), F.col("s").alias("s_hi")), "hi")
    return sized.where(F.col("n_records") >= F.least("s_lo", "s_hi")).select(*met.columns)


#: Parts of a unit of z that distances in z are counted in, so that bounds are met exactly.
Z_PARTS = 10**9


def _near_in_z(pairs: DataFrame, rows: DataFrame, bound: int, entity: str) -> DataFrame:
    """(a, b, n_all, n_near, below, above) of pairs (a, b): their pairs of points, those at most ``bound`` parts apart in z,
    the greatest such distance and the least beyond.

    Both entities' levels of z are put on one line, a's twice, where its reach begins and
    ends; running sums of b's points then count, so no pair of points is made.
    """
    level = _live(rows, entity).where(F.col("z").isNotNull() & ~F.isnan("z")).groupBy(F.col(entity).alias("e"), F.round(F.col("z") * Z_PARTS).cast("long").alias("z")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("long")
    ends = F.explode(F.array(*(F.struct((F.col("z") + k * bound).alias("at"), F.lit(k).alias("kind")) for k in (-1, 1))))
    a = pairs.select("a", "b").join(level.withColumnRenamed("e", "a"), "a").select("a", "b", ends.alias("end"), "z", "n").select("a", "b", "end.at", "end.kind", F.col("z").alias("za"), none.alias("zb"), "n", none.alias("m"))
    b = pairs.select("a", "b").join(level.withColumnRenamed("e", "b"), "b").select("a", "b", F.col("z").alias("at"), F.lit(0).alias("kind"), none.alias("za"), F.col("z").alias("zb"), none.alias("n"), F.col("n").alias("m"))
    up = Window.partitionBy("a", "b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("a", "b").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    line = a.unionByName(b).withColumns({"seen": F.coalesce(F.sum("m").over(up), F.lit(0)), "last": F.max("zb").over(up)}).withColumn("next", F.min("zb").over(down))
    inner, outer = (F.when(F.col("kind") == s, F.col("last")).when(F.col("kind") == -s, F.col("next")) for s in (1, -1))
    reach = F.abs(inner - F.col("za"))
    return line.groupBy("a", "b").agg(
        (F.sum(F.when(F.col("kind") == 1, F.col("n"))) * F.sum("m")).alias("n_all"),
        F.sum(F.col("kind") * F.col("n") * F.col("seen")).alias("n_near"),
        F.max(F.when(reach <= bound, reach)).alias("below"),
        F.min(F.abs(outer - F.col("za"))).alias("above"),
    )


def close_in_z(pairs: DataFrame, rows: DataFrame, most_median: float | None = None, close: float | None = None, least_close: int = 0, entity: str = "entity") -> DataFrame:
    """The pairs (a, b) of entities whose pairs of points lie close enough in z; other columns are dropped.

    ``most_median`` bounds the median of all their distances in z; ``least_close`` pairs of
    points must be nearer than ``close``.  Pairs of entities without z drop out where a gate is set.
    """
    if (most_median is not None and most_median < 0) or (close is not None and close <= 0):
        raise ValueError("bounds of distances in z must be positive")
    out = pairs.select("a", "b")
    if most_median is not None:
        bound = round(most_median * Z_PARTS)
        half = (2 * F.col("n_near") == F.col("n_all")) & (F.col("below") + F.col("above") <= 2 * bound)
        out = _near_in_z(out, rows, bound, entity).where((2 * F.col("n_near") > F.col("n_all")) | half).select("a", "b")
    if close is not None and least_close > 0:
        out = _near_in_z(out, rows, round(close * Z_PARTS) - 1, entity).where(F.col("n_near") >= least_close).select("a", "b")
    return out


def neighbor_entities(index: DataFrame, bx: int, by: int, bz: int = 0, neighborhood: str = "8", z_depth: int = 0) -> DataFrame:
    """(entity, bins): the entities in the bins around one bin, and their bins there."""
    near = [(bx + dx, by + dy, bz + dz) for dx, dy in xy_offsets(neighborhood) for dz in range(-z_depth, z_depth + 1)]
    hit = index.where(F.struct("bx", "by", "bz").isin([F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("bx", "by", "bz"), strict=True))) for b in near]))
    return hit.groupBy("entity").agg(F.array_sort(F.collect_set(F.struct("bx", "by", "bz"))).alias("bins"))


def center_bin_pairs(index: DataFrame, z_depth: int = 1) -> DataFrame:
    """Distinct (a, b), a < b, of entities that both lie around one centre bin (up to two bins apart)."""
    offsets = [(dx, dy, dz) for dx, dy in xy_offsets("8") for dz in range(-z_depth, z_depth + 1)]
    spread = index.select("bx", "by", "bz", "entity").withColumn("o", F.explode(offsets_column(offsets))).select((F.col("bx") + F.col("o.d0")).alias("cx"), (F.col("by") + F.col("o.d1")).alias("cy"), (F.col("bz") + F.col("o.d2")).alias("cz"), "entity").distinct()
    return spread.withColumnRenamed("entity", "a").join(spread.withColumnRenamed("entity", "b"), ["cx", "cy", "cz"]).where("a < b").select("a", "b").distinct()


def degrade(rows: DataFrame, size: float) -> DataFrame:
    """Points snapped to the centres of their bins in the plane, without prior cells; ``bin_id`` names the bin."""
    bx, by = bin_of("x", size), bin_of("y", size)
    return rows.withColumns({"_bx": bx, "_by": by}).withColumns(
        {"bin_id": F.concat_ws("_", F.lit("BIN"), "_bx", "_by"), "x": (F.col("_bx") + 0.5) * F.lit(float(size)), "y": (F.col("_by") + 0.5) * F.lit(float(size)), "z": F.lit(0.0), "cell": F.lit("-1")}
    ).drop("_bx", "_by")
