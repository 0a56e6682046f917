"""Order-dependent algorithms on numpy arrays, run by workers on one bounded group at a time.

Features are numbered 0..G-1; weights are a dense symmetric matrix whose unobserved
pairs are NaN.  Every tie is broken by the smaller number or identifier.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np


def percentile(values: np.ndarray, at: float) -> float:
    """Linear interpolation between order statistics."""
    return float(np.percentile(values, at))


def greedy_prune(genes: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """Features that stay when the one in most conflicts (observed weight below threshold) goes, again and again."""
    genes = np.sort(np.asarray(genes))
    sub = w[np.ix_(genes, genes)]
    bad = (~np.isnan(sub)) & (np.where(np.isnan(sub), 0, sub) < threshold)
    np.fill_diagonal(bad, False)
    active, count = np.ones(len(genes), bool), bad.sum(1)
    while active.sum() > 1:
        r = int(np.argmax(np.where(active, count, -1)))
        if count[r] <= 0:
            break
        active[r] = False
        count = count - bad[:, r]
    return genes[active]


def greedy_prune_weighted(genes: np.ndarray, sizes: np.ndarray, w: np.ndarray, threshold: float) -> np.ndarray:
    """As :func:`greedy_prune`, weighing conflicts by the other feature's rows; a feature with more rows than its
    conflicts together is protected."""
    order = np.argsort(genes)
    genes, sizes = np.asarray(genes)[order], np.asarray(sizes, float)[order]
    sub = w[np.ix_(genes, genes)]
    bad = (~np.isnan(sub)) & (np.where(np.isnan(sub), 0, sub) < threshold)
    np.fill_diagonal(bad, False)
    active, score = np.ones(len(genes), bool), bad @ sizes
    while active.sum() > 1:
        open_ = active & ~(sizes > score)
        if not open_.any():
            break
        r = int(np.argmax(np.where(open_, score, -np.inf)))
        if score[r] <= 0:
            break
        active[r] = False
        score = score - bad[:, r] * sizes[r]
    return genes[active]


def mean_internal(genes: np.ndarray, w: np.ndarray) -> float:
    """Mean observed weight within a set: infinite below two features, 0 without an observed pair."""
    if len(genes) < 2:
        return np.inf
    v = w[np.ix_(genes, genes)][np.triu_indices(len(genes), 1)]
    v = v[~np.isnan(v)]
    return float(v.mean()) if len(v) else 0.0


@dataclass(frozen=True)
class Admission:
    """How a feature is tested against a set of features."""

    mode: str = "hybrid"  # min, mean or hybrid
    mean_threshold: float = 0.2
    min_threshold: float = 0.0
    negative: float = -0.2
    percentile: float = 25.0
    real_signal: float = 0.05
    guard: int = 0
    inclusive: bool = False


def admit(gene: int, seed: np.ndarray, w: np.ndarray, rule: Admission) -> bool:
    """Whether a feature may join a set: no set, no; no observed signal is no objection under ``real_signal``."""
    seed = seed[seed != gene] if len(seed) else seed
    if not len(seed):
        return False
    v = w[gene, seed]
    v = v[~np.isnan(v)]
    if rule.mode == "min":
        return not (v < rule.negative).any()
    if rule.real_signal > 0:
        v = v[np.abs(v) > rule.real_signal]
        if not len(v):
            return True
        if rule.mode == "hybrid" and v.min() > rule.min_threshold:
            return True
        level = percentile(v, rule.percentile)
    else:
        if rule.mode == "mean" and rule.guard > 0 and len(v) < rule.guard:
            return not (v < rule.negative).any()
        if not len(v):
            return False
        if rule.mode == "hybrid" and v.min() > rule.min_threshold:
            return True
        level = float(v.mean())
    return level >= rule.mean_threshold if rule.inclusive and rule.mode == "mean" else level > rule.mean_threshold


def nuclear_seed(genes: np.ndarray, nuclear: np.ndarray, w: np.ndarray, threshold: float = -0.1, floor: float = 0.1, rule: Admission | None = None, nuclear_rows_only: bool = False, least: int = 3, n: np.ndarray | None = None) -> np.ndarray:
    """Codes of one cell's rows: 0 main, 1 partial, 2 unassigned; a feature of -1 is outside the panel.

    A row may stand for ``n`` rows of its feature and flag, which all get its code.
    """
    rule = rule or Admission(mode="mean", inclusive=True)
    if rule.mode == "mean":
        # The plain mean of all observed pairs: weak ones count here.
        rule = replace(rule, real_signal=0.0)
    code = np.full(len(genes), 2)
    known = genes >= 0

    def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, place = np.unique(genes[rows & known], return_inverse=True)
        return u, np.bincount(place, None if n is None else n[rows & known], len(u))

    u, sizes = counted(nuclear)
    if len(u) < least:
        u, sizes = counted(np.ones(len(genes), bool))
    seed = greedy_prune_weighted(u, sizes, w, threshold) if len(u) else u
    if not len(seed) or mean_internal(seed, w) < floor:
        return code
    verdict = {g: g in set(seed.tolist()) or admit(g, seed, w, rule) for g in np.unique(genes[known]).tolist()}
    rejected = np.zeros(len(genes), bool)
    for r, g in enumerate(genes.tolist()):
        if g < 0:
            rejected[r] = True
        elif nuclear_rows_only and not nuclear[r]:
            continue
        elif verdict[g]:
            code[r] = 0
        else:
            rejected[r] = True
    u, sizes = counted(rejected & nuclear)
    if len(u) < least:
        return code
    seed = greedy_prune_weighted(u, sizes, w, threshold)
    if not len(seed) or mean_internal(seed, w) < floor:
        return code
    inside = set(seed.tolist())
    for r in np.flatnonzero(rejected & known):
        g = int(genes[r])
        if (nuclear[r] or not nuclear_rows_only) and (g in inside or admit(g, seed, w, rule)):
            code[r] = 1
    return code


def whole_cell_prune(genes: np.ndarray, w: np.ndarray, threshold: float = -0.1) -> np.ndarray:
    """Codes by pruning twice: what the first pass removes is the partial, what the second removes from it is unassigned.

    Rows outside the panel stay in the main part.
    """
    known = np.unique(genes[genes >= 0])
    main = greedy_prune(known, w, threshold)
    rest = np.setdiff1d(known, main)
    part = greedy_prune(rest, w, threshold) if len(rest) else rest
    return np.where((genes < 0) | np.isin(genes, main), 0, np.where(np.isin(genes, part), 1, 2))


def mean_observed(gene: int, others: np.ndarray, w: np.ndarray) -> float:
    v = w[gene, others[others != gene]]
    v = v[~np.isnan(v)]
    return float(v.mean()) if len(v) else np.nan


def reassign_rows(genes: np.ndarray, movable: np.ndarray, main: np.ndarray, parts: list[np.ndarray], w: np.ndarray, margin: float = 0.05) -> np.ndarray:
    """For movable rows of the main part: the partial (1..) whose mean weight exceeds the running best by the margin, else 0.

    Partials are walked in the order given; the best moves along.
    """
    to = np.zeros(len(genes), int)
    for r in np.flatnonzero(movable & (genes >= 0)):
        g = int(genes[r])
        best = mean_observed(g, main, w)
        for k, part in enumerate(parts, 1):
            fit = mean_observed(g, part, w)
            if not np.isnan(fit) and (np.isnan(best) or fit > best + margin):
                best, to[r] = fit, k
    return to


def cascade(bx: np.ndarray, by: np.ndarray, genes: np.ndarray, w: np.ndarray, ceiling: int, floor: int, radius: int = 1, threshold: float = 0.2, least: int = 3, n: np.ndarray | None = None) -> list[tuple[int, int, int, int, np.ndarray]]:
    """Anchors of one island as (t, density, bx, by, places), by falling density; a place stands for ``n`` rows of a bin and feature, or for one.

    For every threshold from the ceiling down, bins that hold as many free rows become
    centres, densest first (then by bin); a centre's square of bins is pruned to a set of
    agreeing features, all of whose rows it takes.  A centre that failed is tried again once a
    row around it is gone; thresholds at which there is nothing to try are passed over.
    """
    n = np.ones(len(genes), np.int64) if n is None else n
    bins: dict[tuple[int, int], list[int]] = {}
    for r, b in enumerate(zip(bx.tolist(), by.tolist(), strict=True)):
        if genes[r] >= 0:
            bins.setdefault(b, []).append(r)
    free, out = np.ones(len(genes), bool), []
    count = {b: int(n[rows].sum()) for b, rows in bins.items()}
    around = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    failed: set[tuple[int, int]] = set()
    t = ceiling
    while t >= floor:
        hot = sorted(((c, b) for b, c in count.items() if c >= t), key=lambda x: (-x[0], x[1]))
        for density, b in hot:
            if count[b] < t or b in failed:
                continue
            failed.add(b)
            near = np.array([r for dx, dy in around for r in bins.get((b[0] + dx, b[1] + dy), ()) if free[r]], int)
            if n[near].sum() < least:
                continue
            seed = greedy_prune(np.unique(genes[near]), w, threshold)
            if len(seed) < 2:
                continue
            taken = near[np.isin(genes[near], seed)]
            if n[taken].sum() < least:
                continue
            free[taken] = False
            for r in taken.tolist():
                x, y = int(bx[r]), int(by[r])
                count[x, y] -= int(n[r])
                failed.difference_update((x + dx, y + dy) for dx, dy in around)
            out.append((t, density, *b, taken))
        t = min(t - 1, max((c for b, c in count.items() if b not in failed), default=floor - 1))
    return out


def coherence(genes: np.ndarray, w: np.ndarray, tau: float = 0.0, absent_counts: bool = True) -> float:
    if len(genes) < 2:
        return 0.0
    v = w[np.ix_(genes, genes)][np.triu_indices(len(genes), 1)]
    seen = v[~np.isnan(v)]
    total = len(v) if absent_counts else len(seen)
    return float(((seen > tau).sum() - (seen < -tau).sum()) / total) if total else 0.0


@dataclass(frozen=True)
class Cloud:
    """Number, mean and centred scatter matrix of points: all that merging and distances need."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Cloud:
        if not len(points):
            return cls(0, np.zeros(points.shape[1]), np.zeros((points.shape[1],) * 2))
        d = points - points.mean(0)
        return cls(len(points), points.mean(0), d.T @ d)

    def merged(self, other: Cloud) -> Cloud:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Cloud(n, self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))


def mahalanobis(a: Cloud | np.ndarray, b: Cloud | np.ndarray) -> float:
    """Distance of two clouds' centres under their pooled covariance; NaN where it is not defined."""
    a, b = (c if isinstance(c, Cloud) else Cloud.of(c) for c in (a, b))
    if a.n < 2 or b.n < 2:
        return np.nan
    pooled = (a.scatter + b.scatter) / (a.n + b.n - 2)
    if np.linalg.matrix_rank(pooled) < pooled.shape[0] or np.linalg.cond(pooled) > 1e12:
        return np.nan
    d = a.mean - b.mean
    return float(np.sqrt(d @ np.linalg.solve(pooled, d)))


@dataclass(frozen=True)
class Counts:
    """Pairs of features: how many lie above tau, how many below -tau, and how many count at all.

    Counts of disjoint sets of pairs add up, so the coherence of a merger is a sum over its segments.
    """

    above: int = 0
    below: int = 0
    total: int = 0

    @classmethod
    def of(cls, values: np.ndarray, tau: float, absent_counts: bool) -> Counts:
        with np.errstate(invalid="ignore"):
            return cls(int((values > tau).sum()), int((values < -tau).sum()), values.size if absent_counts else int((~np.isnan(values)).sum()))

    def __add__(self, other: Counts) -> Counts:
        return Counts(self.above + other.above, self.below + other.below, self.total + other.total)

    def __sub__(self, other: Counts) -> Counts:
        return Counts(self.above - other.above, self.below - other.below, self.total - other.total)

    @property
    def coherence(self) -> float:
        return (self.above - self.below) / self.total if self.total else 0.0


#: Weights among features: a matrix over their numbers, or a function that cuts the rows and columns of two sets out of one.
Weights = np.ndarray | Callable[[np.ndarray, np.ndarray], np.ndarray]


def cut(w: Weights, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return w(a, b) if callable(w) else w[np.ix_(a, b)]


def within(genes: np.ndarray, w: Weights, tau: float = 0.0, absent_counts: bool = True) -> Counts:
    """Counts of the pairs of a set."""
    if len(genes) < 2:
        return Counts()
    return Counts.of(cut(w, genes, genes)[np.triu_indices(len(genes), 1)], tau, absent_counts)


def across(a: np.ndarray, b: np.ndarray, w: Weights, tau: float = 0.0, absent_counts: bool = True) -> Counts:
    """Counts of the pairs of one feature each of two disjoint sets."""
    return Counts.of(cut(w, a, b), tau, absent_counts) if len(a) and len(b) else Counts()


def union_counts(a: np.ndarray, in_a: Counts, b: np.ndarray, in_b: Counts, w: Weights, tau: float = 0.0, absent_counts: bool = True) -> Counts:
    """Counts of the union of two sets from theirs: the pairs of what both hold count once, those between what only one holds are added."""
    both = np.intersect1d(a, b, assume_unique=True)
    only_a, only_b = np.setdiff1d(a, both, assume_unique=True), np.setdiff1d(b, both, assume_unique=True)
    return in_a + in_b - within(both, w, tau, absent_counts) + across(only_a, only_b, w, tau, absent_counts)


@dataclass(frozen=True)
class Rim:
    """The smallest and the largest coordinates of a cloud of ``n`` points, ascending, per axis.

    With ``most`` values kept at either end, rims merge exactly: the ends of a union are among the
    ends of its parts.  None keeps all.
    """

    n: int
    low: tuple[np.ndarray, ...]
    high: tuple[np.ndarray, ...]
    most: int | None = None

    @classmethod
    def of(cls, points: np.ndarray, most: int | None = None) -> Rim:
        axes = [np.sort(c) for c in points.T]
        return cls(len(points), tuple(c[:most] for c in axes), tuple(c if most is None else c[max(0, len(c) - most) :] for c in axes), most)

    def merged(self, other: Rim) -> Rim:
        low = tuple(np.sort(np.concatenate(p))[: self.most] for p in zip(self.low, other.low, strict=True))
        high = tuple(np.sort(np.concatenate(p)) for p in zip(self.high, other.high, strict=True))
        return Rim(self.n + other.n, low, high if self.most is None else tuple(c[max(0, len(c) - self.most) :] for c in high), self.most)

    def surrounds(self, centre: np.ndarray, k: int) -> bool:
        """Whether k points lie beyond a centre on every side; for k = 1 the box with its sides decides."""
        if not self.n:
            return False
        if k <= 1:
            return all(low[0] <= c <= high[-1] for c, low, high in zip(centre, self.low, self.high, strict=True))
        if self.n < 2 * k or any(len(v) < k for v in (*self.low, *self.high)):
            return False
        return all(low[k - 1] < c < high[-k] for c, low, high in zip(centre, self.low, self.high, strict=True))


@dataclass(frozen=True)
class StitchRule:
    least_gain: float = 0.03
    bypass: float = 0.9
    bypass_size: int = 50
    depth: int = 3
    tau: float = 0.0
    absent_counts: bool = True
    rescue_floor: float = -0.2
    rescue_distance: float | None = 1.0
    #: Whether the gain pays for small sets of features (less one over their number each).
    penalized: bool = True
    #: Greatest distance of two centres that may merge; None: any.
    reach: float | None = None
    #: Greatest number of members of a merger; None: any.
    most_members: int | None = None
    #: A pair whose smaller entity's centre lies inside the larger one's points merges "first", whatever the gain, or "last", where the gain fails; None: no such gate.
    centre_gate: str | None = None
    #: Points that must lie beyond the centre on every side, a third of the larger entity's at least.
    centre_k: int = 1
    #: Ask whether the larger entity's centre lies inside the smaller one's points, of which a third at most must lie beyond.
    flipped: bool = False

    @property
    def rim(self) -> int | None:
        """How many coordinates at either end the gate on centres needs; a third of a merger can be any of its points."""
        return max(1, self.centre_k) if self.flipped else None


@dataclass
class Part:
    """An entity, or a merger of some."""

    genes: np.ndarray
    n: int
    is_cell: bool
    cloud: Cloud | np.ndarray
    depth: int = 0
    members: int = 1
    counts: Counts | None = None
    rim: Rim | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.cloud, Cloud):
            if self.rim is None:
                self.rim = Rim.of(self.cloud)
            self.cloud = Cloud.of(self.cloud)


#: The gain of a pair that the gate on centres lets merge first.
FIRST = 1e9


class Mergers:
    """Parts and what has become of them: values, permissions and merging by a rule."""

    def __init__(self, parts: list[Part], w: Weights, rule: StitchRule) -> None:
        self.now, self.w, self.rule = list(parts), w, rule
        self.parent = list(range(len(parts)))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def counts(self, k: int) -> Counts:
        p = self.now[k]
        if p.counts is None:
            p.counts = within(p.genes, self.w, self.rule.tau, self.rule.absent_counts)
        return p.counts

    def union(self, a: int, b: int) -> Counts:
        return union_counts(self.now[a].genes, self.counts(a), self.now[b].genes, self.counts(b), self.w, self.rule.tau, self.rule.absent_counts)

    def inside(self, a: int, b: int) -> bool:
        """The gate on centres, for two mergers as they are now."""
        small, large = (self.now[a], self.now[b]) if self.now[a].n <= self.now[b].n else (self.now[b], self.now[a])
        if small.rim is None or large.rim is None:
            return False
        if self.rule.flipped:
            return small.rim.surrounds(large.cloud.mean, min(self.rule.centre_k, max(1, -(-small.n // 3))))
        return large.rim.surrounds(small.cloud.mean, max(self.rule.centre_k, -(-large.n // 3)))

    def gain(self, a: int, b: int) -> tuple[float, float]:
        """What merging gains in coherence, and the coherence of the union."""
        if self.rule.centre_gate == "first" and self.inside(a, b):
            return FIRST, 1.0
        union = self.union(a, b).coherence
        # The penalty counts features, those of both twice.
        na, nb = max(1, len(self.now[a].genes)), max(1, len(self.now[b].genes))
        cost = 1.0 if self.rule.penalized else 0.0
        return union - cost / (na + nb) - max(self.counts(a).coherence - cost / na, self.counts(b).coherence - cost / nb), union

    def passes(self, dc: float, union: float, a: int, b: int) -> bool:
        return dc >= self.rule.least_gain or (union >= self.rule.bypass and self.now[a].n + self.now[b].n <= self.rule.bypass_size)

    def rescued(self, dc: float) -> bool:
        return self.rule.rescue_distance is not None and self.rule.rescue_floor < dc < 0

    def first_gain(self, a: int, b: int) -> float | None:
        """The gain by which a pair of parts is ranked, None where it never merges."""
        dc, union = self.gain(a, b)
        wanted = self.passes(dc, union, a, b) or self.rescued(dc) or (self.rule.centre_gate == "last" and self.inside(a, b))
        return dc if wanted else None

    def barred(self, a: int, b: int) -> bool:
        """Whether two mergers can't merge, now or later."""
        p, q = self.now[a], self.now[b]
        if (p.is_cell and q.is_cell) or max(p.depth, q.depth) >= self.rule.depth:
            return True
        return self.rule.most_members is not None and p.members + q.members > self.rule.most_members

    def accepts(self, a: int, b: int) -> bool:
        p, q = self.now[a], self.now[b]
        if self.rule.reach is not None and float(np.linalg.norm(p.cloud.mean - q.cloud.mean)) > self.rule.reach:
            return False
        dc, union = self.gain(a, b)
        if self.passes(dc, union, a, b):
            return True
        if self.rule.centre_gate == "last" and self.inside(a, b):
            return True
        return self.rescued(dc) and mahalanobis(p.cloud, q.cloud) <= self.rule.rescue_distance

    def merge(self, a: int, b: int) -> int:
        keep, gone = min(a, b), max(a, b)
        p, q = self.now[keep], self.now[gone]
        rim = p.rim.merged(q.rim) if p.rim is not None and q.rim is not None else None
        merged = Part(np.union1d(p.genes, q.genes), p.n + q.n, p.is_cell or q.is_cell, p.cloud.merged(q.cloud), max(p.depth, q.depth) + 1, p.members + q.members, self.union(a, b), rim)
        self.parent[gone], self.now[keep] = keep, merged
        return keep


def stitch_some(parts: list[Part], edges: list[tuple[tuple, int, int]], limits: list[tuple | None], w: Weights, rule: StitchRule) -> tuple[Mergers, list[tuple[tuple, int, int]]]:
    """Greedy merging along ranked edges (rank, a, b), as far as it can't be overtaken by what is not here.

    An edge is tried on the mergers that its ends belong to by then.  ``limits`` is the least rank of the
    edges of a part that lead elsewhere: edges of its merger beyond that wait, and what waits
    holds up later edges of its own mergers.  So every edge is tried on just the mergers that a
    single walk over all edges would have made.  Returns the mergers and the edges that wait.
    """
    m, limit, waiting = Mergers(parts, w, rule), list(limits), []
    for rank, a, b in sorted(edges):
        a, b = m.find(a), m.find(b)
        if a == b or m.barred(a, b):
            continue
        if any(limit[k] is not None and limit[k] < rank for k in (a, b)):
            waiting.append((rank, a, b))
            for k in (a, b):
                limit[k] = rank if limit[k] is None else min(limit[k], rank)
        elif m.accepts(a, b):
            known = [limit[k] for k in (a, b) if limit[k] is not None]
            limit[m.merge(a, b)] = min(known, default=None)
    return m, [(rank, m.find(a), m.find(b)) for rank, a, b in waiting]


def stitch(parts: list[Part], candidates: list[tuple[int, int]], w: Weights, rule: StitchRule) -> np.ndarray:
    """The root of every part after greedy merging by falling gain of the candidate pairs.

    Never two cells; no deeper than ``depth``; pairs are valued again on the current mergers when their turn comes.
    """
    first = Mergers(parts, w, rule)
    edges = []
    for a, b in sorted({(min(p), max(p)) for p in candidates if p[0] != p[1]}):
        dc = first.first_gain(a, b)
        if dc is not None:
            edges.append(((-dc, a, b), a, b))
    m, _ = stitch_some(parts, edges, [None] * len(parts), w, rule)
    return np.array([m.find(k) for k in range(len(parts))], int)


def weighted_percentile(values: np.ndarray, counts: np.ndarray, at: float) -> float:
    """``percentile`` of sorted values that occur ``counts`` times each."""
    till = np.cumsum(counts)
    place = (till[-1] - 1) * at / 100
    low = int(np.floor(place))
    a, b = values[np.searchsorted(till, [low, min(low + 1, till[-1] - 1)], side="right")]
    return float(a + (b - a) * (place - low))


def two_modes(values: np.ndarray, rounds: int = 200, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and shares of a two-component Gaussian mixture in one dimension (EM from quantiles).

    ``counts`` says how often each of the values, sorted then, occurs.
    """
    v = np.asarray(values, float)
    c = np.ones(len(v)) if counts is None else np.asarray(counts, float)
    mean = np.percentile(v, [25, 75]) if counts is None else np.array([weighted_percentile(v, counts, at) for at in (25, 75)])
    sd, share = np.full(2, np.sqrt(np.average((v - np.average(v, weights=c)) ** 2, weights=c)) + 1e-9), np.full(2, 0.5)
    for _ in range(rounds):
        density = share * np.exp(-0.5 * ((v[:, None] - mean) / sd) ** 2) / sd
        r = c[:, None] * density / np.maximum(density.sum(1, keepdims=True), 1e-300)
        n = r.sum(0) + 1e-9
        new = (r * v[:, None]).sum(0) / n
        sd = np.sqrt((r * (v[:, None] - new) ** 2).sum(0) / n) + 1e-9
        share = n / c.sum()
        if np.abs(new - mean).max() < 1e-9:
            mean = new
            break
        mean = new
    order = np.argsort(mean)
    return mean[order], sd[order], share[order]


def z_threshold(dz: np.ndarray, separation: float = 3.0, counts: np.ndarray | None = None) -> float:
    """The 90th percentile of the small mode where two modes are far apart, else the median of all.

    ``counts`` says how often each distance occurs.
    """
    return z_modes(dz, separation, counts)[0]


def z_modes(dz: np.ndarray, separation: float = 3.0, counts: np.ndarray | None = None, least: float = 1.0) -> tuple[float, float, bool]:
    """The threshold of :func:`z_threshold`, the bin in z that goes with it, and whether there are two modes.

    With two modes the bin is rounded down, to leave empty bins between them, else up; ``least`` at the least.
    """
    threshold, two = _z_threshold(dz, separation, counts)
    return threshold, z_bin(threshold, two, least), two


def _z_threshold(dz: np.ndarray, separation: float, counts: np.ndarray | None) -> tuple[float, bool]:
    order = np.argsort(dz, kind="stable")
    dz = np.asarray(dz, float)[order]
    n = np.ones(len(dz), np.int64) if counts is None else np.asarray(counts, np.int64)[order]
    cut_at = mode_cut(dz, n, separation)
    if cut_at is None:
        return (weighted_percentile(dz, n, 50) if len(dz) else np.nan), False
    return weighted_percentile(dz[dz <= cut_at], n[dz <= cut_at], 90), True


def mode_cut(values: np.ndarray, counts: np.ndarray, separation: float = 3.0) -> float | None:
    """Where two modes of sorted values that occur ``counts`` times part; None where they don't lie far apart."""
    if counts.sum() < 4:
        return None
    mean, sd, _ = two_modes(values, counts=counts)
    pooled = np.sqrt((sd**2).mean())
    return float((mean[0] * sd[1] + mean[1] * sd[0]) / (sd[0] + sd[1])) if pooled > 0 and (mean[1] - mean[0]) / pooled >= separation else None


def z_bin(threshold: float, two: bool, least: float = 1.0) -> float:
    """The bin in z that goes with a threshold: rounded down between two modes, to leave empty bins between them, else up."""
    return np.nan if np.isnan(threshold) else max(least, float(np.floor(threshold) if two else np.ceil(threshold)))


#: Cells of a table of values and bounds that is held at once.
MOST_BOUNDS = 500_000
#: Distinct values up to which their differences are simply listed.
FEW_VALUES = 64


def differences_up_to(z: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many pairs differ by no more than each bound, and the sum of their differences.

    ``z`` are distinct values in order that occur ``c`` times each.  Pairs are counted by places in the running
    counts, so their number never matters.
    """
    till, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0.0], np.cumsum(c * z)])
    same, after = int((c * (c - 1) // 2).sum()), np.arange(1, len(z) + 1)
    n, s = np.zeros(len(bounds), np.int64), np.zeros(len(bounds))
    step = max(1, MOST_BOUNDS // max(1, len(z)))
    for a in range(0, len(bounds), step):
        bound = np.asarray(bounds[a : a + step], float)[:, None]
        to = np.searchsorted(z, z + bound, "right")
        # The difference itself decides, as the sum may be rounded either way.
        to += (to < len(z)) & (z[np.minimum(to, len(z) - 1)] - z <= bound)
        to -= z[to - 1] - z > bound
        to = np.maximum(to, after)
        met = till[to] - till[after]
        n[a : a + step] = np.where(bound[:, 0] < 0, 0, same + (c * met).sum(1))
        s[a : a + step] = (c * (total[to] - total[after] - z * met)).sum(1)
    return n, s


def kth_differences(z: np.ndarray, c: np.ndarray, ranks: list[int], parts: int = 16, rounds: int = 13) -> np.ndarray:
    """The differences of pairs at some ranks (from 0) among all in order, by narrowing a span around each."""
    if len(z) <= FEW_VALUES:
        i, j = np.triu_indices(len(z), 1)
        d, n = np.concatenate([np.zeros(len(z)), z[j] - z[i]]), np.concatenate([c * (c - 1) // 2, c[i] * c[j]])
        order = np.argsort(d, kind="stable")
        return d[order][np.searchsorted(np.cumsum(n[order]), ranks, "right")]
    out = []
    for rank in ranks:
        low, high, below, below_s, value = None, float(z[-1] - z[0]), 0, 0.0, 0.0
        for _ in range(rounds):
            bounds = (low or 0.0) + (high - (low or 0.0)) * np.arange(1, parts + 1) / parts
            bounds[-1] = high
            n, s = differences_up_to(z, c, bounds)
            k = int(np.searchsorted(n, rank, "right"))
            if k:
                low, below, below_s = float(bounds[k - 1]), int(n[k - 1]), float(s[k - 1])
            high, value = float(bounds[k]), (s[k] - below_s) / (n[k] - below)
            if n[k] - below == 1 or high <= (low or 0.0):
                break
        out.append(value)
    return np.array(out)


def density_floor(counts: np.ndarray, coverage: float = 0.65, hard_min: int = 2, radius: int = 1, ceiling: int | None = None) -> int:
    """The largest threshold whose bins, spread by ``radius``, hold enough of all rows of a 2-D count grid."""
    total = int(counts.sum())
    top = int(counts.max(initial=0)) if ceiling is None else ceiling
    for t in range(top, hard_min - 1, -1):
        if total and counts[dilate(counts >= t, radius)].sum() / total >= coverage:
            return t
    return hard_min


def dilate(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    """A mask spread to the square neighbourhood."""
    out = np.zeros_like(mask)
    n, m = mask.shape
    for dx in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            out[max(0, dx) : n + min(0, dx), max(0, dy) : m + min(0, dy)] |= mask[max(0, -dx) : n + min(0, -dx), max(0, -dy) : m + min(0, -dy)]
    return out


@dataclass(frozen=True)
class NearRule:
    """How rows choose among admitted entities nearby."""

    z_bound: float
    rank: str = "distance"
    tie: str = "distance"
    cap: int = 3
    divisor: int = 2
    least: int = 3


#: Pairs of points, and cells of a table of rows and entities, that are held at once.
MOST_NEAR = 2_000_000


def choose_near(free: np.ndarray, f: np.ndarray, held: np.ndarray, e: np.ndarray, size: np.ndarray, pairs: np.ndarray, fits: np.ndarray, n_e: int, rule: NearRule) -> np.ndarray:
    """The number of the entity that each free point takes, -1 for none.

    Points are rows of (x, y, z).  ``f`` and ``e`` number features and entities, ``size`` counts
    a held point's entity, ``pairs`` holds the admitted f * n_e + e in ascending order and
    ``fits`` their fits.  Only points near in z are paired, found in their order by z.
    """
    out = np.full(len(free), -1, np.int64)
    if not len(free) or not len(held) or not len(pairs):
        return out
    by_z = np.argsort(held[:, 2], kind="stable")
    held, (names, own) = held[by_z], np.unique(e[by_z], return_inverse=True)
    kinds, kind = np.unique(f, return_inverse=True)
    # Admission and fit of what there is here; sizes are those of the entities.
    wanted = kinds[:, None].astype(np.int64) * n_e + names[None, :]
    at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
    good, fit = pairs[at] == wanted, np.round(np.nan_to_num(fits[at], nan=-1e9), 9)
    weight = np.zeros(len(names), np.int64)
    weight[own] = size[by_z]
    # The margin keeps points at the bound, which are then tested as they are.
    lo = np.searchsorted(held[:, 2], free[:, 2] - rule.z_bound - 1e-9, "left")
    hi = np.searchsorted(held[:, 2], free[:, 2] + rule.z_bound + 1e-9, "right")
    till = np.cumsum(hi - lo)
    a = 0
    while a < len(free):
        done = till[a - 1] if a else 0
        b = max(a + 1, min(int(np.searchsorted(till, done + MOST_NEAR, "right")), a + max(1, MOST_NEAR // len(names))))
        runs = (hi - lo)[a:b]
        owner = np.repeat(np.arange(b - a), runs)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + lo[a:b][owner]
        entity = own[place]
        keep = good[kind[a:b][owner], entity] & (np.abs(free[a:b, 2][owner] - held[place, 2]) <= rule.z_bound)
        owner, place, entity = owner[keep], place[keep], entity[keep]
        if rule.rank == "witness" and len(owner):
            cell = owner * len(names) + entity
            count = np.bincount(cell, minlength=(b - a) * len(names)).reshape(b - a, -1)
            eff = np.minimum(np.minimum(count, rule.cap), -(-weight // rule.divisor)[None, :])
            top = np.where(count > 0, eff, -1).max(1)
            keep = (eff[owner, entity] == top[owner]) & (top[owner] >= rule.least)
            owner, place, entity = owner[keep], place[keep], entity[keep]
        if len(owner):
            if rule.rank == "witness" and rule.tie == "gene_fit":
                score = -fit[kind[a:b][owner], entity]
            else:
                d = free[a:b][owner] - held[place]
                score = np.round((d * d).sum(1), 9)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.repeat(np.minimum.reduceat(score, starts), np.diff(starts, append=len(owner)))
            out[a + owner[starts]] = names[np.minimum.reduceat(np.where(score == best, entity, len(names)), starts)]
        a = b
    return out


def choose_counted(free_z: np.ndarray, f: np.ndarray, z: np.ndarray, e: np.ndarray, size: np.ndarray, n: np.ndarray, pairs: np.ndarray, fits: np.ndarray, n_e: int, rule: NearRule) -> np.ndarray:
    """What :func:`choose_near` tells by witnesses with ties by gene fit, of held points counted (``n``) by entity and z.

    An entity's points within the bound are counted by two searches in their order by z, so no pair of points is made.
    """
    out = np.full(len(f), -1, np.int64)
    if not len(f) or not len(e) or not len(pairs):
        return out
    names, first, own = np.unique(e, return_index=True, return_inverse=True)
    levels, at_z = np.unique(z, return_inverse=True)
    order = np.argsort(own * (len(levels) + 1) + at_z, kind="stable")
    key = (own * (len(levels) + 1) + at_z)[order]
    till = np.concatenate([[0], np.cumsum(n[order])])
    kinds, kind = np.unique(f, return_inverse=True)
    wanted = kinds[:, None].astype(np.int64) * n_e + names[None, :]
    at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
    good, fit = pairs[at] == wanted, np.round(np.nan_to_num(fits[at], nan=-1e9), 9)
    most = np.minimum(rule.cap, -(-size[first] // rule.divisor))
    heights, height = np.unique(free_z, return_inverse=True)
    # The margin keeps levels at the bound, which are then tested as they are.
    lo = np.searchsorted(levels, heights - rule.z_bound - 1e-9, "left")
    hi = np.searchsorted(levels, heights + rule.z_bound + 1e-9, "right")
    while (off := (lo < hi) & (heights - levels[np.minimum(lo, len(levels) - 1)] > rule.z_bound)).any():
        lo[off] += 1
    while (off := (lo < hi) & (levels[np.maximum(hi, 1) - 1] - heights > rule.z_bound)).any():
        hi[off] -= 1
    base = np.arange(len(names)) * (len(levels) + 1)
    by_height = np.argsort(height, kind="stable")
    step = max(1, MOST_NEAR // len(names))
    for a in range(0, len(f), step):
        some = by_height[a : a + step]
        here, row = np.unique(height[some], return_inverse=True)
        count = till[np.searchsorted(key, base[None, :] + hi[here, None])] - till[np.searchsorted(key, base[None, :] + lo[here, None])]
        eff = np.where(good[kind[some]] & (count > 0)[row], np.minimum(count, most)[row], -1)
        top = eff.max(1)
        score = np.where(eff == top[:, None], -fit[kind[some]], np.inf)
        out[some] = np.where((top >= rule.least) & (top > -1), names[score.argmin(1)], -1)
    return out
