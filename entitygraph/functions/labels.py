"""Entity labels: sentinels, kinds, parts of a label, and the final label of unassigned rows.

All functions return Column expressions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the label format.
UNASSIGNED = "UNASSIGNED"
SENTINELS = ("-1", "DROP", "UNASSIGNED", "nan")
REJECTED = ("prune_rejected", "group_rejected", "demote_rejected")
COMPONENT_PREFIX = "UNASSIGNED_"
KINDS = ("cell", "partial", "component", "drop", "unknown")
TRACE_DELIMITER = "-tr-"


def is_unassigned(label: Column | str) -> Column:
    """Null, a sentinel, or a rejection mark."""
    c = F.col(label) if isinstance(label, str) else label
    return c.isNull() | c.isin(*SENTINELS, *REJECTED)


def etype_of_label(label: Column | str) -> Column:
    """The kind that a label's form implies; a kind that is carried along takes precedence over this."""
    c = F.col(label) if isinstance(label, str) else label
    return (
        F.when(c.isNull() | c.isin(*SENTINELS) | c.endswith("_rejected"), "unknown")
        .when(c.startswith(COMPONENT_PREFIX), "component")
        .when(c.contains("-"), "partial")
        .otherwise("cell")
    )


def stage_class(label: Column | str) -> Column:
    """The five classes of the stage report."""
    c = F.col(label) if isinstance(label, str) else label
    return (
        F.when(c.isNull(), "unknown")
        .when(c.isin("DROP", "UNASSIGNED", "-1"), "drop")
        .when(c.startswith(COMPONENT_PREFIX), "pseudocell")
        .when(c.contains("-"), "partial_cell")
        .otherwise("whole_cell")
    )


def etype_of_code(code: Column | str) -> Column:
    """Codes of the pruning kernels: 0 cell, 1 partial, all else unknown."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 0, "cell").when(c == 1, "partial").otherwise("unknown")


def partial_label(parent: Column | str, index: Column | int = 1) -> Column:
    """{parent}-tr-{index}; of a partial, its sub-partial."""
    tail = index.cast("string") if isinstance(index, Column) else F.lit(str(index))
    return F.concat(F.col(parent) if isinstance(parent, str) else parent, F.lit(TRACE_DELIMITER), tail)


subpartial_label = partial_label


def split_label(label: Column | str) -> Column:
    """struct(cell, indices) of a label with the delimiter; without it, the label itself and no indices.

    An index that is no whole number is an error.
    """
    parts = F.split(F.col(label) if isinstance(label, str) else label, TRACE_DELIMITER)
    return F.struct(parts[0].alias("cell"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.cast("int")).alias("indices"))


def label_parts(label: Column | str) -> Column:
    """struct(cell, depth1, depth2): whole-number suffixes read from the right, null where there are none."""
    c = F.col(label) if isinstance(label, str) else label
    two, one = r"^(.*)-(\d+)-(\d+)$", r"^(.*)-(\d+)$"
    number = lambda pattern, k: F.regexp_extract(c, pattern, k).cast("int")
    return (
        F.when(c.rlike(two), F.struct(F.regexp_extract(c, two, 1).alias("cell"), number(two, 2).alias("depth1"), number(two, 3).alias("depth2")))
        .when(c.rlike(one), F.struct(F.regexp_extract(c, one, 1).alias("cell"), number(one, 2).alias("depth1"), F.lit(None).cast("int").alias("depth2")))
        .otherwise(F.struct(c.alias("cell"), F.lit(None).cast("int").alias("depth1"), F.lit(None).cast("int").alias("depth2")))
    )


def whole_cell(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return ~is_unassigned(c) & ~c.startswith(COMPONENT_PREFIX) & ~c.contains("-")


def partial(label: Column | str) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return ~is_unassigned(c) & ~c.startswith(COMPONENT_PREFIX) & c.contains("-")


def finalize(df: DataFrame, label: str = "entity", cell: str = "cell_id") -> DataFrame:
    """Unassigned rows get the label UNASSIGNED and the prior cell -1; others stay."""
    gone = is_unassigned(label)
    return df.withColumns({label: F.when(gone, UNASSIGNED).otherwise(F.col(label)), cell: F.when(gone, "-1").otherwise(F.col(cell))})


def stage_counts(df: DataFrame, label: str = "entity", kind: str | None = None) -> DataFrame:
    """One row: entities of each kind and unassigned rows."""
    k = F.col(kind) if kind else etype_of_label(label)
    labels = df.groupBy(F.col(label).alias("_label"), k.alias("_kind")).agg(F.count("*").alias("_n"))
    live = ~is_unassigned("_label")
    count = lambda name: F.count(F.when(live & (F.col("_kind") == name), 1))
    return labels.agg(
        count("cell").alias("n_cells"),
        count("partial").alias("n_partials"),
        count("component").alias("n_components"),
        F.coalesce(F.sum(F.when(live, 0).otherwise(F.col("_n"))), F.lit(0)).alias("n_unassigned"),
    )


def stage_class_counts(df: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, kind, n_entities) of the label columns ``stages``: one scan, unpivoted and deduplicated before counting."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("label")) for s in stages))).alias("r")).select("r.*").distinct()
    return rows.groupBy("stage", stage_class("label").alias("kind")).agg(F.count("*").alias("n_entities"))
