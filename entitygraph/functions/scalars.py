"""Scalar expressions: association measures, symmetric thresholding, grid keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def relu_symmetric(x: Column | str, tau: float) -> Column:
    """x drawn towards 0 by tau; 0 within [-tau, tau]."""
    x = _c(x)
    return F.when(x > tau, x - tau).when(x < -tau, x + tau).otherwise(0.0)


def pmi(k_ij, k_i, k_j, n) -> Column:
    """ln(p_ij / (p_i p_j)); null when a count is 0."""
    k_ij, k_i, k_j, n = (_c(v).cast("double") for v in (k_ij, k_i, k_j, n))
    return F.when((k_ij > 0) & (k_i > 0) & (k_j > 0), F.ln((k_ij / n) / ((k_i / n) * (k_j / n))))


def npmi(k_ij, k_i, k_j, n) -> Column:
    """PMI / -ln p_ij; null where the pair is never or always present."""
    p = _c(k_ij).cast("double") / _c(n)
    return F.when((p > 0) & (p < 1), pmi(k_ij, k_i, k_j, n) / -F.ln(p))


def conditional(k_ij, k_given) -> Column:
    """P(i | given); null when the condition never holds."""
    return F.when(_c(k_given) > 0, _c(k_ij).cast("double") / _c(k_given))


def smoothed_pmi(k_ij, k_i, k_j, n, alpha: float) -> Column:
    """PMI after (k + a) / (n + 2a) on all three counts."""
    share = lambda k: (_c(k).cast("double") + alpha) / (_c(n).cast("double") + 2 * alpha)
    return F.ln(share(k_ij) / (share(k_i) * share(k_j)))


def bin_of(x: Column | str, size: float) -> Column:
    return F.floor(_c(x) / F.lit(float(size))).cast("int")


#: Neighbour offsets by topology; halves hold one of each opposite pair.
def xy_offsets(topology: str) -> list[tuple[int, int]]:
    """``0`` (own bin), ``4``, ``8`` or ``R<N>`` (square of radius N), own bin included."""
    if topology == "0":
        return [(0, 0)]
    if topology == "4":
        return [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    r = 1 if topology == "8" else int(topology[1:]) if topology[:1] == "R" and topology[1:].isdigit() else -1
    if r < 0:
        raise ValueError(f"unknown topology {topology!r}")
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]


def xy_half_offsets(topology: str) -> list[tuple[int, int]]:
    """The own bin and of each opposite pair of offsets the one with dx > 0, or dx = 0 and dy > 0."""
    return [(dx, dy) for dx, dy in xy_offsets(topology) if dx > 0 or (dx == 0 and dy >= 0)]


def offsets_column(offsets: list[tuple[int, ...]]) -> Column:
    """A literal array of structs (d0, d1, ...) to explode against bins."""
    return F.array(*(F.struct(*(F.lit(v).alias(f"d{k}") for k, v in enumerate(o))) for o in offsets))
