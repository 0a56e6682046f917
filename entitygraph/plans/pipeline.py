"""The two canonical pipelines: refinement of prior cells, and grouping without any."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitygraph.functions import labels as L
from entitygraph.functions.scalars import bin_of
from entitygraph.functions.storage import discard, in_place, settle
from entitygraph.operators import assoc, graph, grid, kernels, stages, tiling
from entitygraph.plans.config import PipelineConfig, RescueConfig, StitchConfig


#: Stages between two writings of all rows, where they leave rows where they are.
MOST_IN_PLACE = 5


@dataclass
class Run:
    """The rows as they stand, and what each stage left; files of settled rows belong to the run, which deletes them when it has replaced them."""

    rows: DataFrame
    progression: list[dict] = field(default_factory=list)

    def step(self, name: str, stage: Callable[[DataFrame], DataFrame]) -> None:
        """Apply a stage and count entities.

        The result is written to the shared folder where the stage moved rows, or several stages have not; files that it replaces are deleted.
        """
        began = time.time()
        before, self.rows = self.rows, stage(self.rows)
        if getattr(self.rows, "_base", (None, MOST_IN_PLACE + 1))[1] > MOST_IN_PLACE:
            self.rows = settle(self.rows, name.lower().replace(" ", "-"))
            old = getattr(before, "_base", (before,))[0]
            if hasattr(old, "_settled"):
                discard(old)
        counts = L.stage_counts(self.rows, kind="etype").first().asDict()
        self.progression.append({"stage": name, **counts, "stage_seconds": time.time() - began})


def bootstrap_panel(points: DataFrame, cfg: PipelineConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The panel of points (cell, feature[, nuclear]), all pairs, and diagnostics, by the settings."""
    b = (cfg or PipelineConfig()).bootstrap
    return assoc.pmi_bootstrap(
        points, b.metric, b.least, b.evidence, None, b.evidence_boot, b.bands, b.subsample, b.set_negative, nuclear=b.nuclear_only, sizes=b.sizes,
        tau=(b.tau_low, b.tau_high), ci=b.ci, budget=b.max_bootstraps, coarse=b.coarse, refine=b.refine, seed=b.seed, alpha=b.alpha, least_draws=b.least_draws,
    )


#: Side of the squares of space whose rows are written together.
PLACE_SIDE = 4.0


def _placed(rows: DataFrame) -> DataFrame:
    """The rows, written with their neighbours, so that stages that count them by place or entity add most of them up before a shuffle."""
    placed = rows.withColumns({f"_b{c}": bin_of(c, PLACE_SIDE) for c in "xy"}).hint("rebalance", "_bx", "_by")
    return settle(placed.drop("_bx", "_by"), "points")


def _rule(r: RescueConfig) -> kernels.Admission:
    return kernels.Admission(mode=r.mode, mean_threshold=r.mean_threshold, min_threshold=r.min_threshold, negative=r.negative, percentile=r.percentile, real_signal=r.real_signal, guard=r.small_entity_guard)


def _rescue(run: Run, name: str, passes: int, r: RescueConfig, panel: DataFrame, guard: bool) -> None:
    """Passes until none admits a row; the final rescue also ends when one admits too few of the unassigned."""
    for k in range(passes):
        rows, n = stages.rescue_pass(run.rows, panel, r.bin_um, _rule(r), r.rank, r.z_bound_um, r.witness_cap, r.witness_divisor, r.witness_min, r.witness_tie, r.guard_peers if guard and r.guard_peers > 0 else None, r.guard_shield)
        if n == 0:
            break
        free = run.progression[-1]["n_unassigned"]
        run.step(f"{name} {k + 1}", lambda _, rows=rows: rows)
        if not guard and n < r.early_exit_ratio * free:
            break


def stitch_candidates(rows: DataFrame, s: StitchConfig, z_bin: float) -> DataFrame:
    """(a, b) of the entities that may be stitched: those whose bins meet with enough points, or Delaunay neighbours within reach.

    Delaunay candidates are those of the entities before any merger.  The gates on z hold for both.
    """
    index = grid.build_index(rows, s.bin_um, s.z_bin_um or z_bin)
    if s.source == "delaunay":
        centres = tiling.centroids(rows.where(~L.is_unassigned("entity")), "entity").withColumnRenamed("entity", "component")
        near = graph.component_delaunay(centres, ("x", "y", "z"))
        pairs = (near.where(F.col("length") <= s.reach_um) if s.reach_um is not None else near).select("a", "b")
    else:
        met = grid.witness_pairs(index, s.neighborhood, s.z_depth, s.witness_min, cap_at_size=True)
        if s.least_records:
            met = grid.supported(met, s.least_records, index)
        pairs = met.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return settle(grid.close_in_z(pairs, rows, s.most_median_dz, s.close_dz, s.close_n), "pairs")


def _stitch(rows: DataFrame, panel: stages.Panel, table: DataFrame, cfg: PipelineConfig, absent: str, z_bin: float) -> DataFrame:
    s = cfg.stitch
    rule = kernels.StitchRule(
        s.least_gain, s.bypass, s.bypass_size, s.depth, s.tau, absent == "zero", s.rescue_floor, s.rescue_distance, s.penalized,
        most_members=s.most_members, centre_gate=s.centre_gate, centre_k=s.centre_k, flipped=s.centre_flipped,
    )
    keep = assoc.housekeeping(table, s.housekeeping_tau) if s.housekeeping_tau is not None else None
    return stages.apply_stitch(rows, settle(stages.stitch(rows, panel, stitch_candidates(rows, s, z_bin), rule, keep), "names"))


def _finish(run: Run, panel: stages.Panel, table: DataFrame, cfg: PipelineConfig, absent: str, z_bin: float) -> None:
    q = cfg.qc
    run.step("Split components", lambda r: stages.z_gap_split(r, cfg.split.gap, 1, ("component",)))
    run.step("Mid-QC", lambda rows: stages.coherence_qc(rows, table, q.coherence_floor, q.real_signal, absent, tau=q.coherence_tau))
    _rescue(run, "Post-Group Rescue", cfg.rescue.post_group_passes, cfg.rescue, table, guard=True)
    run.step("Stitch", lambda rows: _stitch(rows, panel, table, cfg, absent, z_bin))
    run.step("Demote", lambda rows: stages.demote_small(rows, cfg.demote.min_size))
    _rescue(run, "Final Rescue", cfg.final_rescue.passes, cfg.final_rescue, table, guard=False)
    run.step("Finalize", lambda rows: in_place(rows, L.finalize(rows, "entity", "cell")))


def _grouped(rows: DataFrame, panel: stages.Panel, cfg: PipelineConfig) -> DataFrame:
    g = cfg.group
    return stages.apply_cascade(rows, panel, g.bin_um, g.ceiling, g.floor, g.radius, g.threshold, g.min_size, g.coverage, g.hard_min)


def _z_bin(rows: DataFrame) -> float:
    """The bin in z that fits the entities there are; 1 where they don't tell."""
    size = stages.z_scales(rows)[1]
    return 1.0 if math.isnan(size) else size


def _together(rows: DataFrame, z_bin: float) -> DataFrame:
    """Entities cut into the parts that hang together over neighbouring bins."""
    return stages.spatial_split(rows, settle(graph.bin_edges(rows.where(~L.is_unassigned("entity")), 2.0, z_bin), "near"))


def segmented(points: DataFrame, panel: DataFrame, cfg: PipelineConfig | None = None, absent: str = "zero", nuclear: bool | None = None) -> Run:
    """Refine the prior cells of points (id, cell, feature, x, y, z[, nuclear]).

    The nuclear path runs where there is a flag, unless told otherwise.  ``absent`` says
    what an unobserved pair means to coherence; pruning by the fallback counts it as a
    conflict under "zero".
    """
    cfg = cfg or PipelineConfig()
    nuclear = "nuclear" in points.columns if nuclear is None else nuclear
    rows = points if "nuclear" in points.columns else points.withColumn("nuclear", F.lit(False))
    table = settle(panel, "panel")
    skip = stages.Panel(table)
    main = skip if nuclear else stages.Panel(table, absent)
    run = Run(_placed(rows.withColumns({"entity": F.col("cell"), "etype": L.etype_of_label("cell")})))
    z_bin = _z_bin(run.rows)
    p = cfg.prune
    if nuclear:
        # By the plain mean a feature must reach the threshold of the conflicts.
        mean = p.threshold if p.mode == "mean" else p.mean_threshold
        rule = kernels.Admission(p.mode, mean, p.min_threshold, p.negative, p.percentile, p.real_signal, inclusive=p.mode == "mean")
        run.step("Prune", lambda r: stages.prune(r, main, True, p.threshold, p.floor, rule, p.nuclear_only, grouped=True))
        if cfg.reassign.enabled:
            run.step("Reassign", lambda r: stages.reassign(r, main, cfg.reassign.margin, grouped=True))
    else:
        run.step("Prune", lambda r: stages.prune(r, main, False, p.threshold, grouped=True))
    run.step("Split", lambda r: stages.z_gap_split(r, cfg.split.gap, cfg.split.min_size, least_entity=cfg.split.min_entity_size))
    if nuclear and cfg.rerank.enabled:
        run.step("Rerank", lambda r: stages.rerank(r, cfg.rerank.margin))
    run.step("QC", lambda r: stages.size_qc(r, cfg.qc.min_size))
    if p.remerge:
        run.step("Remerge", lambda r: stages.maha_remerge(r, table, cfg.stitch.bin_um, cfg.stitch.z_bin_um or z_bin, p.remerge_floor, p.remerge_distance, absent))
    if not nuclear:
        run.step("Coherence in space", lambda r: _together(r, z_bin))
    _rescue(run, "Rescue", cfg.rescue.passes, cfg.rescue, table, guard=True)
    run.step("Group", lambda r: _grouped(r, skip, cfg))
    _finish(run, skip, table, cfg, absent, z_bin)
    return run


def unsegmented(points: DataFrame, panel: DataFrame, cfg: PipelineConfig | None = None) -> Run:
    """Group points without prior cells."""
    cfg = cfg or PipelineConfig()
    rows = points if "z" in points.columns else points.withColumn("z", F.lit(0.0))
    rows = rows if "nuclear" in rows.columns else rows.withColumn("nuclear", F.lit(False))
    table = settle(panel, "panel")
    dense = stages.Panel(table)
    run = Run(_placed(rows.withColumns({"cell": F.lit("-1"), "entity": F.lit("-1"), "etype": F.lit("unknown")})))
    run.step("Group", lambda r: _grouped(r, dense, cfg))
    _finish(run, dense, table, cfg, "skip", 1.0)
    return run


def tiled(points: DataFrame, panel: DataFrame, nx: int, ny: int, cfg: PipelineConfig | None = None, nuclear: bool | None = None) -> Run:
    """The segmented pipeline as a whole, with the tile of every point's prior cell as a column.

    Joins here are global, so tiles lose nothing at their edges and need no repair; the
    tile only spreads work and output.
    """
    from entitygraph.operators.tiling import centroids, tile_assign

    tiles = tile_assign(centroids(points.where(~L.is_unassigned("cell"))), nx, ny).select(F.col("entity").alias("_c"), "tile")
    tagged = points.join(tiles, F.col("cell") == F.col("_c"), "left").drop("_c")
    run = segmented(points, panel, cfg, nuclear=nuclear)
    run.rows = run.rows.join(tagged.select("id", "tile"), "id", "left")
    return run
