"""Connected components of link tables, for groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitygraph.functions.storage import discard, settle

#: Edges that one task takes at once where callers allow it (about 100 MB).
AT_ONCE = 100_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Components of a table (u, v) of bounded size by union-find; names are in the order of the engine's text, by code point."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(frames) or [pd.DataFrame({"u": [], "v": []})])
        if not len(e):
            return
        names, at = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]), return_inverse=True)
        root = list(range(len(names)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(at[: len(e)].tolist(), at[len(e) :].tolist(), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        yield pd.DataFrame({"node": names, "component": names[[find(i) for i in range(len(names))]]})

    kind = dict(edges.dtypes)["u"]
    return edges.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates large-star and small-star steps: every node points its larger
    neighbours, then its smaller ones, at the smallest node it knows.  Minima come
    from partial aggregation and are written before they are joined back, so that the
    join has a plain shuffle on both sides: a hub with a third of all edges is then split
    by the skew join and never gathered.  Each round is written to the shared folder.  Edges with nulls or equal ends are ignored.

    Up to ``at_once`` edges between numbers or texts are worked off in one task instead, with equal results.
    """
    e = settle(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v"))).distinct(), "edges", compact=True)
    if at_once and dict(e.dtypes)["u"] in ("string", "bigint", "int") and e.limit(at_once + 1).count() <= at_once:
        return _in_one_task(e)
    state = None
    for _ in range(most_rounds):
        # Large star: each larger neighbour v of u moves to the smallest of u and its neighbours.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least", compact=True)
        large = e.join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = settle(large.groupBy("v").agg(F.min("u").alias("m")), "low", compact=True)
        small = large.join(low, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        small = small.unionByName(low.select(F.col("m").alias("u"), "v")).where("u < v").distinct()
        after = settle(small, "edges", compact=True)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e, least, low)
        e = after
        if state == now:
            roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
        state = now
    raise RuntimeError("components did not settle")
