"""Pipeline settings: frozen dataclasses, layered TOML, validation and receipts."""

from __future__ import annotations

import dataclasses
import json
import tomllib
import typing
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np


MODES = ("min", "mean", "hybrid")


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class PruneConfig:
    threshold: float = 0.2
    floor: float = 0.1
    mode: str = "hybrid"
    mean_threshold: float = 0.2
    min_threshold: float = 0.0
    percentile: float = 25.0
    real_signal: float = 0.05
    negative: float = -0.2
    nuclear_only: bool = True
    remerge: bool = True
    remerge_floor: float = -0.2
    remerge_distance: float = 1.0

    def __post_init__(self) -> None:
        _require(self.mode in MODES, "mode is min, mean or hybrid")
        _require(self.remerge_floor <= 0 < self.remerge_distance, "the remerge floor is not positive, its distance positive")


@dataclass(frozen=True)
class SplitConfig:
    gap: float = 2.0
    min_size: int = 1
    min_entity_size: int = 2

    def __post_init__(self) -> None:
        _require(self.gap > 0 and self.min_size >= 1 and self.min_entity_size >= 1, "the gap is positive, sizes are at least 1")


@dataclass(frozen=True)
class QcConfig:
    min_size: int = 3
    coherence_floor: float = 0.05
    coherence_tau: float = 0.2
    real_signal: float = 0.05

    def __post_init__(self) -> None:
        _require(self.min_size >= 1 and self.real_signal >= 0, "sizes are at least 1, signals not negative")


@dataclass(frozen=True)
class RerankConfig:
    enabled: bool = True
    margin: int = 1


@dataclass(frozen=True)
class ReassignConfig:
    enabled: bool = True
    margin: float = 0.05


@dataclass(frozen=True)
class DemoteConfig:
    min_size: int = 5


@dataclass(frozen=True)
class RescueConfig:
    passes: int = 3
    post_group_passes: int = 3
    bin_um: float = 2.0
    z_bound_um: float | None = None
    rank: str = "witness"
    mode: str = "hybrid"
    mean_threshold: float = 0.5
    min_threshold: float = 0.0
    negative: float = -0.2
    percentile: float = 25.0
    real_signal: float = 0.05
    guard_peers: int = 3
    guard_shield: str = "entity"
    small_entity_guard: int = 0
    witness_min: int = 3
    witness_cap: int = 3
    witness_divisor: int = 2
    witness_tie: str = "gene_fit"
    early_exit_ratio: float = 0.0

    def __post_init__(self) -> None:
        _require(self.bin_um > 0, "the bin is positive")
        _require(self.rank in ("distance", "witness"), "rank is distance or witness")
        _require(self.witness_tie in ("distance", "gene_fit"), "ties go by distance or gene_fit")
        _require(self.mode in MODES, "mode is min, mean or hybrid")
        _require(self.guard_shield in ("entity", "exclude"), "the shield is entity or exclude")


@dataclass(frozen=True)
class GroupConfig:
    bin_um: float = 2.0
    ceiling: int | None = None
    floor: int | None = None
    coverage: float = 0.65
    hard_min: int = 2
    radius: int = 1
    threshold: float = 0.2
    min_size: int = 3

    def __post_init__(self) -> None:
        _require(self.bin_um > 0 and self.radius >= 0, "the bin is positive, the radius not negative")
        _require(0 < self.coverage <= 1 and self.hard_min >= 2, "coverage lies in (0, 1], single rows form no group")


@dataclass(frozen=True)
class StitchConfig:
    bin_um: float = 2.0
    z_bin_um: float | None = 1.0
    z_depth: int = 1
    neighborhood: str = "8"
    #: Where candidate pairs come from: bins that entities share or touch ("grid"), or the Delaunay neighbours of their centres ("delaunay").
    source: str = "grid"
    #: Greatest length of a Delaunay candidate.
    reach_um: float | None = 5.0
    witness_min: int = 3
    tau: float = 0.2
    penalized: bool = True
    least_gain: float = 0.03
    bypass: float = 0.9
    bypass_size: int = 50
    depth: int = 3
    rescue_floor: float = -0.2
    rescue_distance: float | None = 1.0
    housekeeping_tau: float | None = None
    #: Pairs of points that must speak for a candidate ("min": as many as its smaller entity has).
    least_records: int | str = 0
    #: Greatest median distance in z of a candidate's pairs of points.
    most_median_dz: float | None = None
    #: How many of these pairs must be nearer in z than ``close_dz``.
    close_dz: float | None = None
    close_n: int = 0
    #: The gate on centres: "first" (it overrides the gain), "last" (where the gain fails) or None; see ``kernels.StitchRule``.
    centre_gate: str | None = None
    centre_k: int = 1
    centre_flipped: bool = False
    #: Greatest number of entities of a merger.
    most_members: int | None = None

    def __post_init__(self) -> None:
        _require(self.source in ("grid", "delaunay") and self.centre_gate in (None, "first", "last"), "sources are grid and delaunay, gates first and last")
        _require((self.reach_um is None or self.reach_um > 0) and self.centre_k >= 1, "the reach is positive, the gate takes a point or more")
        _require(self.most_members is None or self.most_members >= 2, "a merger has two members or more")
        _require(self.least_records == "min" or (not isinstance(self.least_records, str) and self.least_records >= 0), "least_records is a number or 'min'")
        _require(self.most_median_dz is None or self.most_median_dz >= 0, "distances in z are not negative")
        _require(self.close_n >= 0 and (self.close_dz is None or self.close_dz > 0), "close_dz is positive, close_n not negative")
        _require(self.depth >= 1 and self.rescue_floor <= 0, "the depth is at least 1, the rescue floor not positive")
        _require(self.rescue_distance is None or self.rescue_distance > 0, "the rescue distance is positive")


@dataclass(frozen=True)
class BootstrapConfig:
    metric: str = "pmi"
    tau_low: float = 0.05
    tau_high: float = 0.20
    alpha: float = 0.1
    ci: float = 0.95
    max_bootstraps: int = 10_000
    coarse: int = 200
    refine: int = 500
    least_draws: int = 30
    subsample: int | None = 25_000
    least: int = 2
    evidence: float = 10.0
    evidence_boot: float | None = 10.0
    set_negative: bool = True
    bands: tuple[float, float] | None = (0.05, 0.95)
    sizes: tuple[float, float] | None = None
    nuclear_only: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        _require(0 < self.ci < 1 and 0 <= self.tau_low <= self.tau_high, "ci lies between 0 and 1, taus ascend from 0")
        _require(self.metric in ("pmi", "npmi"), "the metric is pmi or npmi")


@dataclass(frozen=True)
class PipelineConfig:
    prune: PruneConfig = field(default_factory=PruneConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    qc: QcConfig = field(default_factory=QcConfig)
    rerank: RerankConfig = field(default_factory=RerankConfig)
    reassign: ReassignConfig = field(default_factory=ReassignConfig)
    demote: DemoteConfig = field(default_factory=DemoteConfig)
    rescue: RescueConfig = field(default_factory=RescueConfig)
    final_rescue: RescueConfig = field(default_factory=RescueConfig)
    group: GroupConfig = field(default_factory=GroupConfig)
    stitch: StitchConfig = field(default_factory=StitchConfig)
    bootstrap: BootstrapConfig = field(default_factory=BootstrapConfig)


#: What platforms change.
PLATFORMS: dict[str, dict] = {
    "xenium": {"bootstrap": {"nuclear_only": True}},
    "noseg": {"rescue": {"post_group_passes": 5}, "final_rescue": {"passes": 5}},
}


def merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, table by table."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve_inherit(tables: dict) -> dict:
    """A section with ``inherit = "other"`` starts from that section's own values (one level)."""
    out = {}
    for name, t in tables.items():
        if isinstance(t, dict) and "inherit" in t:
            parent = t["inherit"]
            if parent not in tables or "inherit" in tables[parent]:
                raise ValueError(f"[{name}] inherits from {parent!r}, which is missing or inherits itself")
            t = {**tables[parent], **{k: v for k, v in t.items() if k != "inherit"}}
        out[name] = t
    return out


def build(tables: dict) -> PipelineConfig:
    """Settings from tables; unknown sections are ignored, unknown keys of a known section are an error."""
    made = {}
    for f in dataclasses.fields(PipelineConfig):
        kind = typing.get_type_hints(PipelineConfig)[f.name]
        given = tables.get(f.name, {})
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
        known = {x.name for x in dataclasses.fields(kind)}
        if extra := set(given) - known:
            raise ValueError(f"unknown keys in [{f.name}]: {sorted(extra)}")
        made[f.name] = kind(**given)
    return PipelineConfig(**made)


def load_config(path: str | Path | None = None, platform: str | None = None) -> PipelineConfig:
    """Defaults, then the platform's changes, then a user file."""
    tables: dict = {}
    if platform is not None:
        if platform not in PLATFORMS:
            raise ValueError(f"unknown platform {platform!r}; there are {sorted(PLATFORMS)}")
        tables = merge(tables, PLATFORMS[platform])
    if path is not None:
        tables = merge(tables, resolve_inherit(tomllib.loads(Path(path).read_text())))
    # The final rescue starts from the settings of the rescue.
    tables["final_rescue"] = merge(tables.get("rescue", {}), tables.get("final_rescue", {}))
    return build(tables)


def to_dict(cfg: PipelineConfig) -> dict:
    return dataclasses.asdict(cfg)


def dump_receipt(cfg: PipelineConfig, path: str | Path, **more: object) -> None:
    Path(path).write_text(json.dumps({"config": to_dict(cfg), **more}, indent=2, sort_keys=True, default=str))


def set_seed(seed: int) -> None:
    """Seed numpy's global generator; the operators themselves are seeded by their arguments."""
    np.random.seed(seed)


def reproducibility_smoke_test(spark) -> bool:
    """Whether neighbours with near ties come out alike from two partitionings."""
    from entitygraph.operators.spatial_join import knn_capped

    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0), (3, 0.0, 1.0 + 1e-9, 0.0), (4, 0.0, -1.0, 0.0), (5, 0.0, 0.0, 1.0)], "id long, x double, y double, z double")
    first, second = (sorted(map(tuple, knn_capped(points.repartition(n), 2, 1.5).collect())) for n in (1, 5))
    return first == second
