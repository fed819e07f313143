"""Bounded traversals, level by level: each step is one join of the frontier with the edges.

Frontiers are checkpointed where the number of steps isn't fixed, so plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.sources.landing import checkpointed, stored


def by_source(edges: DataFrame, key: str) -> DataFrame:
    """Edges made once and dealt by the column that each level is joined on, so that only frontiers are shuffled."""
    return checkpointed(edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


def bfs_levels(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, id, depth, parent, via): first arrival of each node from each start (starts: start).

    The parent is that of the least edge id among those that arrive in the first level, so trees are deterministic.
    """
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via"))
    seen = frontier = checkpointed(seen.distinct())
    steps = by_source(edges.select(F.col("id").alias("via"), F.col("src").alias("parent"), F.col("dst").alias("next")), "parent")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        arrived = (
            frontier.select("start", F.col("id").alias("parent"))
            .join(steps, "parent")
            .groupBy("start", F.col("next").alias("id"))
            .agg(F.min(F.struct("via", "parent")).alias("first"))
            .select("start", "id", "first.parent", "first.via")
        )
        fresh = arrived.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = checkpointed(fresh.select("start", "id", F.lit(depth).alias("depth"), "parent", "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 8, types: Sequence[str] | None = None) -> DataFrame:
    """(start, goal, depth, step, id, via): the shortest path of each (start, goal), one row per node, if there is one.

    A path from a node to itself is that node.
    """
    used = edges.where(F.col("type").isin(list(types))) if types else edges
    tree = bfs_levels(used, pairs.select("start").distinct(), max_depth)
    goals = checkpointed(pairs.join(tree.select("start", F.col("id").alias("goal"), "depth"), ["start", "goal"]))
    here = goals.select("start", "goal", "depth", F.col("depth").alias("step"), F.col("goal").alias("id"))
    out = None
    for back in range((goals.agg(F.max("depth")).first()[0] or 0) + 1):
        # what stands ``back`` steps before a goal lies at most so deep
        row = here.join(tree.select("start", "id", "parent", "via", F.col("depth").alias("step")), ["start", "id", "step"])
        rows = row.select("start", "goal", "depth", "step", "id", "via")
        out = rows if out is None else out.unionByName(rows)
        here = checkpointed(row.where("parent IS NOT NULL").select("start", "goal", "depth", (F.col("step") - 1).alias("step"), F.col("parent").alias("id")))
    return out


def closure(edges: DataFrame, starts: DataFrame, depth: int, within: str | None = None) -> DataFrame:
    """(start, id, depth): nodes within ``depth`` steps, the least depth each; the start at 0.

    A node seen from a start isn't expanded again. within: only nodes of this type are entered.
    """
    seen = level = checkpointed(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct())
    own = edges.where(F.col("dst").startswith(f"{within}:")) if within else edges
    steps = by_source(own.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct(), "id")
    for d in range(1, depth + 1):
        arrived = level.join(steps, "id").select("start", F.col("next").alias("id")).distinct()
        level = checkpointed(arrived.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def reaching(edges: DataFrame, targets: DataFrame, hops: int, terminal: str, expanded: str) -> DataFrame:
    """(target, id, hops): nodes of the terminal type that reach a target backwards through nodes of the expanded type.

    Types are what precedes the colon of an id. A node seen from a target isn't expanded again.
    """
    back = by_source(edges.select(F.col("dst").alias("at"), F.col("src").alias("id")).distinct(), "at")
    level = targets.select(F.col("target"), F.col("target").alias("at")).distinct()
    seen = checkpointed(level.select("target", F.col("at").alias("id"), F.lit(0).alias("hops")))
    kept = F.col("id").startswith(f"{terminal}:") | F.col("id").startswith(f"{expanded}:")
    for h in range(1, hops + 1):
        step = level.join(back, "at").select("target", "id").where(kept).distinct()
        step = checkpointed(step.join(seen, ["target", "id"], "left_anti").withColumn("hops", F.lit(h)))
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
        level = step.where(F.col("id").startswith(f"{expanded}:")).select("target", F.col("id").alias("at"))
    return seen.where(F.col("id").startswith(f"{terminal}:") & (F.col("hops") > 0))


def subtree(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of everything below the roots by (id, parent), however deep."""
    steps = parents.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.concat_ws("|", "parent", "id").alias("id"))
    tree = bfs_levels(steps, roots.select(F.col("root").alias("start")))
    return tree.select(F.col("start").alias("root"), "id", "depth")


def call_tree(edges: DataFrame, starts: DataFrame, depth: int = 3, cap: int | None = 200, leaves: DataFrame | None = None) -> DataFrame:
    """(start, path, id, kind, depth, cycle, truncated): call paths; a node already on its path is a leaf marked as a cycle.

    edges: (src, dst); leaves: (id, leaf, kind), what stands below a function beside its calls. At most ``cap`` rows a start, in
    pre-order; ``truncated`` tells whether there were more.

    A start that nothing calls stands in no other tree, so its tree is itself and the trees of what it calls, one level less
    deep: these are made once, whoever calls them, and put below it in the end.
    """
    starts = starts.select("start").distinct()
    steps = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    called = F.col("start") == F.col("dst")
    inner = stored(starts.join(steps.select("dst").distinct(), called, "left_semi"), "starts")
    tops = starts.join(steps.select("dst").distinct(), called, "left_anti")
    children = steps.select(F.col("src").alias("id"), F.col("dst").alias("next"), F.lit("function").alias("kind"))
    if leaves is not None:
        children = children.unionByName(leaves.select("id", F.col("leaf").alias("next"), "kind").where("id IS NOT NULL").distinct())
    children = stored(children, "children")
    whole = _grown(children, inner, depth, cap)
    if depth < 1:
        return whole.unionByName(_grown(children, tops, depth, cap))
    below = stored(children.join(tops.withColumnRenamed("start", "id"), "id", "left_semi"), "below")
    roots = below.where("kind = 'function'").select(F.col("next").alias("start")).distinct()
    lower = stored(_grown(children, roots, depth - 1, cap), "lower")
    sizes = lower.groupBy("start").agg(F.count("*").alias("size"), F.bool_or("truncated").alias("more")).withColumnRenamed("start", "next")
    trees = lower.select(F.col("start").alias("next"), F.col("path").alias("sub"), F.col("id").alias("end"), F.col("kind").alias("of"), F.col("depth").alias("deep"), F.col("cycle").alias("again"))
    function = F.col("kind") == "function"
    met = tops.select(F.col("start").alias("id"), F.lit(None).cast("string").alias("next"), F.lit("function").alias("kind")).unionByName(below)
    met = met.join(sizes.withColumn("kind", F.lit("function")), ["next", "kind"], "left").withColumns({"size": F.coalesce("size", F.lit(1)), "more": F.coalesce("more", F.lit(False))})
    if cap is not None:
        of, total = Window.partitionBy("id"), F.sum("size")
        before = total.over(of.orderBy("next")) - total.over(Window.partitionBy("id", "next"))  # rows of names that come before
        met = met.withColumns({"truncated": (total.over(of) > cap) | F.bool_or("more").over(of), "before": before}).where(F.col("before") < cap)
        met = stored(met, "met")
    else:
        met = met.withColumn("truncated", F.lit(False))
    first = met.where("next IS NULL").select(F.col("id").alias("start"), F.array("id").alias("path"), "id", "kind", F.lit(0).alias("depth"), F.lit(False).alias("cycle"), "truncated")
    ends = met.where(F.col("next").isNotNull() & ~function).select(F.col("id").alias("start"), F.array("id", "next").alias("path"), F.col("next").alias("id"), "kind", F.lit(1).alias("depth"), F.lit(False).alias("cycle"), "truncated")
    inside = met.where(F.col("next").isNotNull() & function).join(trees, "next")
    inside = inside.select(F.col("id").alias("start"), F.concat(F.array("id"), "sub").alias("path"), F.col("end").alias("id"), F.col("of").alias("kind"), (F.col("deep") + 1).alias("depth"), F.col("again").alias("cycle"), "truncated")
    over = first.unionByName(ends).unionByName(inside)
    if cap is not None:
        over = over.where("NOT truncated").unionByName(_first(over.where("truncated"), cap))
    return whole.unionByName(over)


def _first(rows: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` rows of each start in pre-order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("path", "kind"))).where(F.col("n") <= cap).drop("n")


def _grown(children: DataFrame, starts: DataFrame, depth: int, cap: int | None) -> DataFrame:
    """``call_tree`` of the starts, level by level; children: (id, next, kind).

    Each level is kept once. Its rows know a place in pre-order at or before their own: that of their parent, and the children of
    earlier parents before them. Later levels only push it back, so what lies beyond the cap is dropped as it is made.
    """
    nth = F.row_number().over(Window.partitionBy("id").orderBy("next", "kind"))
    degrees = children.groupBy("id").agg(F.count("*").alias("degree"))
    if cap is not None:
        children = children.withColumn("nth", nth).where(F.col("nth") <= cap)
    children = children.withColumnRenamed("kind", "below")
    columns = ["start", "path", "id", "kind", "depth", "cycle"]
    level = stored(starts.select("start", F.array("start").alias("path"), F.col("start").alias("id"), F.lit("function").alias("kind"), F.lit(0).alias("depth"), F.lit(False).alias("cycle"), F.lit(1).cast("long").alias("n")), "level")
    levels, cuts = [level], []
    for d in range(1, depth + 1):
        front = level.where("kind = 'function' AND NOT cycle")
        if cap is None:
            met = front.join(children, "id").withColumn("place", F.col("n"))
        else:
            before = F.coalesce(F.sum("degree").over(Window.partitionBy("start").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            front = front.join(degrees, "id").withColumn("from", F.col("n") + before)
            cuts.append(front.where(F.col("from") + F.col("degree") > cap).select("start"))
            met = front.where(F.col("from") < cap).join(children, "id").withColumn("place", F.col("from") + F.col("nth")).where(F.col("place") <= cap)
        cycle = (F.col("below") == "function") & F.array_contains("path", F.col("next"))
        level = stored(met.select("start", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("id"), F.col("below").alias("kind"), F.lit(d).alias("depth"), cycle.alias("cycle"), F.col("place").alias("n")), "level")
        if level.isEmpty():
            break
        levels.append(level)
    rows = reduce(DataFrame.unionByName, levels).select(columns)
    if cap is None:
        return rows.withColumn("truncated", F.lit(False))
    long = rows.groupBy("start").agg(F.count("*").alias("size")).where(F.col("size") > cap).select("start")
    over = stored(reduce(DataFrame.unionByName, cuts, long).distinct().withColumn("truncated", F.lit(True)), "over")
    marked = rows.join(over, "start", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    return marked.where("NOT truncated").unionByName(_first(marked.where("truncated"), cap))
