"""Span trees: roots, depth, ancestors, descendants and the critical path.

Trees are resolved by pointer jumping. In round k every span knows its ancestor
2^k levels up, so a tree of depth d needs about log2(d) joins, each on the unique
key (execution, span id). No execution is ever gathered into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import truthy, with_times
from spanloom.session import checkpoint


@dataclass
class SpanTree:
    """`nodes`: one row per span, all resolved facts. `jumps[k]`: (by, node, anc),
    where anc is the ancestor 2^k levels above node."""

    nodes: DataFrame
    jumps: list[DataFrame]
    by: str


def _base(spans: DataFrame, by: str) -> DataFrame:
    spans = with_times(spans)
    last = spans.groupBy(by, F.col("span_id").alias("node")).agg(
        F.max_by(
            F.struct(
                F.when(truthy("parent_span_id"), F.col("parent_span_id")).alias("parent"),
                "start_at",
                "end_at",
            ),
            "seq",
        ).alias("s"),
        F.max("seq").alias("seq"),
    )
    rows = last.select(
        by,
        "node",
        "seq",
        "s.parent",
        F.coalesce(F.unix_micros("s.start_at"), F.lit(1 << 62)).alias("start_us"),
        F.coalesce(F.unix_micros("s.end_at") - F.unix_micros("s.start_at"), F.lit(0)).alias("dur_us"),
    )
    # An execution without any root starts at its first span.
    first = rows.groupBy(by).agg(
        F.bool_or(F.col("parent").isNull()).alias("_rooted"),
        F.min_by("node", F.struct("start_us", "seq")).alias("_first"),
    )
    return (
        rows.join(first, by)
        .withColumn(
            "is_root",
            F.when(F.col("_rooted"), F.col("parent").isNull()).otherwise(F.col("node") == F.col("_first")),
        )
        .withColumn("parent", F.when(~F.col("is_root"), F.col("parent")))
        .drop("_rooted", "_first")
    )


def resolve(spans: DataFrame, by: str = "exec_id") -> SpanTree:
    """Root, depth and summed duration for every span.

    `attached` is false for spans below a missing parent. Spans on (or below) a
    cycle never reach a top; rounds stop once no further span does, and their
    `top` stays null.
    """
    base = _base(spans, by)
    known = base.select(by, F.col("node").alias("parent"), F.lit(True).alias("_known"))
    state = (
        base.join(known, [by, "parent"], "left")
        .withColumn("anc", F.when(F.col("_known"), F.col("parent")))
        .select(
            by, "node", "seq", "parent", "start_us", "dur_us", "is_root",
            "anc",
            F.when(F.col("anc").isNull(), F.col("node")).alias("top"),
            F.when(F.col("anc").isNull(), F.col("is_root")).alias("attached"),
            F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("depth"),
            # Duration from here up to just below `anc`, and the least such sum
            # over the ancestors passed on the way.
            F.col("dur_us").alias("sum_us"),
            F.when(F.col("anc").isNotNull(), F.col("dur_us")).alias("least_us"),
        )
    )
    state = checkpoint(state)
    jumps = []
    open_nodes = state.filter(F.col("anc").isNotNull()).count()
    while open_nodes:
        jumps.append(state.filter(F.col("anc").isNotNull()).select(by, "node", "anc"))
        above = state.select(
            by,
            F.col("node").alias("anc"),
            F.struct("anc", "top", "attached", "depth", "sum_us", "least_us").alias("a"),
        )
        # A left join keeps one plan for open and finished spans alike; finished
        # ones have no `anc` and match nothing.
        joined = state.join(above, [by, "anc"], "left")
        moved = F.col("a").isNotNull()
        state = checkpoint(
            joined.select(
                by, "node", "seq", "parent", "start_us", "dur_us", "is_root",
                F.col("a.anc").alias("anc"),
                F.when(moved, F.col("a.top")).otherwise(F.col("top")).alias("top"),
                F.when(moved, F.col("a.attached")).otherwise(F.col("attached")).alias("attached"),
                (F.col("depth") + F.coalesce("a.depth", F.lit(0))).alias("depth"),
                (F.col("sum_us") + F.coalesce("a.sum_us", F.lit(0))).alias("sum_us"),
                F.least("least_us", F.col("sum_us") + F.col("a.least_us")).alias("least_us"),
            )
        )
        still_open = state.filter(F.col("anc").isNotNull()).count()
        if still_open == open_nodes:
            break
        open_nodes = still_open
    return SpanTree(state, jumps, by)


def tree_nodes(tree: SpanTree) -> DataFrame:
    """(execution, span_id, parent_span_id, root, depth, attached, children)."""
    by = tree.by
    children = (
        tree.nodes.filter(F.col("parent").isNotNull())
        .groupBy(by, F.col("parent").alias("node"))
        .agg(F.count(F.lit(1)).alias("children"))
    )
    cyclic = F.col("top").isNull()
    return (
        tree.nodes.join(children, [by, "node"], "left")
        .select(
            by,
            F.col("node").alias("span_id"),
            F.col("parent").alias("parent_span_id"),
            F.col("top").alias("root"),
            F.when(~cyclic, F.col("depth")).alias("depth"),
            F.coalesce("attached", F.lit(False)).alias("attached"),
            F.coalesce("children", F.lit(0)).alias("children"),
        )
    )


def ancestors(tree: SpanTree, seeds: DataFrame) -> DataFrame:
    """(execution, seed, span_id, distance): spans above each seed, parents that
    are only named included. `seeds` has (execution, seed)."""
    by = tree.by
    found = seeds.select(by, "seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(tree.jumps))):
        step = found.join(tree.jumps[k], [by, "node"]).select(
            by, "seed", F.col("anc").alias("node"), (F.col("distance") + (1 << k)).alias("distance")
        )
        # Written, since the next step uses it twice and the plan would double.
        found = checkpoint(found.unionByName(step))
    dangling = (
        tree.nodes.filter((F.col("top") == F.col("node")) & F.col("parent").isNotNull())
        .select(by, "node", F.col("parent").alias("named"))
    )
    reached = found.join(dangling, [by, "node"]).select(
        by, "seed", F.col("named").alias("node"), (F.col("distance") + 1).alias("distance")
    )
    return (
        found.filter("distance > 0")
        .unionByName(reached)
        .select(by, "seed", F.col("node").alias("span_id"), "distance")
    )


def descendants(tree: SpanTree, seeds: DataFrame) -> DataFrame:
    """(execution, seed, span_id, distance): spans below each seed."""
    by = tree.by
    found = seeds.select(by, "seed", F.col("seed").alias("anc"), F.lit(0).cast("long").alias("distance"))
    for k in reversed(range(len(tree.jumps))):
        step = found.join(tree.jumps[k], [by, "anc"]).select(
            by, "seed", F.col("node").alias("anc"), (F.col("distance") + (1 << k)).alias("distance")
        )
        found = checkpoint(found.unionByName(step))
    return found.filter("distance > 0").select(by, "seed", F.col("anc").alias("span_id"), "distance")


def critical_path(tree: SpanTree, strict: bool = True) -> DataFrame:
    """(execution, span_id, depth): the root-to-leaf path with the greatest summed
    duration; ties go to the branch that comes first.

    The best sum below a root is the greatest prefix sum in its tree, so the end of
    the path is the span that reaches it, and no span above it does. With `strict`
    an execution whose path would end above a leaf (a tail that adds no time) has
    no path; otherwise that shorter path is kept.
    """
    by = tree.by
    attached = tree.nodes.filter(F.coalesce("attached", F.lit(False)))
    best = (
        attached.groupBy(by)
        .agg(F.max("sum_us").alias("best"))
        .filter("best > 0")
    )
    ends = (
        attached.join(best, by)
        .filter((F.col("sum_us") == F.col("best")) & (F.col("least_us").isNull() | (F.col("least_us") > 0)))
        .select(by, "node")
    )
    ends = checkpoint(ends)
    marked = ends
    for k in reversed(range(len(tree.jumps))):
        step = marked.join(tree.jumps[k], [by, "node"]).select(by, F.col("anc").alias("node"))
        marked = checkpoint(marked.unionByName(step).distinct())
    on_way = checkpoint(
        attached.join(marked, [by, "node"], "left_semi").select(by, "node", "parent", "start_us", "seq", "depth")
    )
    # Of several marked children (or roots) the first in trace order leads on.
    leading = on_way.groupBy(by, F.coalesce("parent", F.lit("")).alias("parent")).agg(
        F.min_by("node", F.struct("start_us", "seq")).alias("node")
    )
    good = leading.select(by, "node", F.lit(True).alias("_leads"))
    way = on_way.join(good, [by, "node"], "left").withColumn("_leads", F.coalesce("_leads", F.lit(False)))
    # A span is on the path if it and everything above it leads: count per span how
    # many of its ancestors lead, again by jumping.
    state = way.select(by, "node", "depth", F.col("_leads").alias("ok"))
    for k in range(len(tree.jumps)):
        above = state.select(by, F.col("node").alias("anc"), F.col("ok").alias("_ok"))
        linked = tree.jumps[k].join(above, [by, "anc"]).select(by, "node", "_ok")
        state = checkpoint(
            state.join(linked, [by, "node"], "left")
            .select(by, "node", "depth", (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"))
        )
    path = state.filter("ok").select(by, "node", "depth")
    if strict:
        parents = tree.nodes.filter(F.col("parent").isNotNull()).select(by, F.col("parent").alias("node")).distinct()
        tails = path.join(ends, [by, "node"], "left_semi").join(parents, [by, "node"], "left_semi").select(by).distinct()
        path = path.join(tails, by, "left_anti")
    return path.select(by, F.col("node").alias("span_id"), "depth")
