"""Incremental maintenance: what changed between two versions of a keyed table, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.functions.scalars import node_type, row_hash


def hashed(rows: DataFrame, columns: Sequence[str], out: str = "hash") -> DataFrame:
    return rows.withColumn(out, row_hash(*columns))


def classified(old: DataFrame, new: DataFrame, key: str = "id", hash_: str = "hash") -> DataFrame:
    """(key, change): added, changed, removed or unchanged; one full outer join on the key."""
    a, b = old.select(key, F.col(hash_).alias("_old")), new.select(key, F.col(hash_).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), F.lit("added")).when(F.col("_new").isNull(), F.lit("removed")).when(F.col("_old") == F.col("_new"), F.lit("unchanged")).otherwise(F.lit("changed"))
    )
    return a.join(b, key, "full").select(key, change.alias("change"))


def counts(delta: DataFrame) -> DataFrame:
    return delta.groupBy("change").agg(F.count("*").alias("n"))


def applied(old: DataFrame, new: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """The new version made from the old one and the delta: unchanged rows are the old ones."""
    same = old.join(delta.where("change = 'unchanged'").select(key), key, "left_semi")
    fresh = new.join(delta.where("change IN ('added', 'changed')").select(key), key, "left_semi")
    return same.unionByName(fresh)


def touched_nodes(node_delta: DataFrame, edge_delta: DataFrame, old_edges: DataFrame, new_edges: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """(id): changed nodes and the ends of changed edges, as far as they are in the new graph or were removed."""
    moved = edge_delta.where("change <> 'unchanged'").select("id")
    rows = old_edges.select("id", "src", "dst").unionByName(new_edges.select("id", "src", "dst")).join(moved, "id", "left_semi")
    ends = rows.select(F.explode(F.array("src", "dst")).alias("id"))
    own = node_delta.where("change <> 'unchanged'").select("id")
    known = new_nodes.select("id").unionByName(node_delta.where("change = 'removed'").select("id"))
    return own.unionByName(ends).distinct().join(known, "id", "left_semi")


def exclusive(changes: DataFrame) -> DataFrame:
    """(path, kind): of several kinds for a path, deleted wins over added, and added over changed."""
    rank = F.when(F.col("kind") == "deleted", 0).when(F.col("kind") == "added", 1).otherwise(2)
    return changes.groupBy("path").agg(F.min_by("kind", rank).alias("kind"))


def impact(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """(id, how): direct ids, and what typed single steps reach from them.

    Functions reach callers, callees and inputs that flow into them; middleware reaches the routes that it protects;
    models reach their accessors and these accessors' callers; inputs reach what they flow into.
    """
    start = direct.select("id").distinct()
    kind = lambda t: start.where(node_type("id") == t)

    def step(from_: DataFrame, type_: str, near: str, far: str) -> DataFrame:
        own = edges.where(F.col("type") == type_).select(F.col(near).alias("id"), F.col(far).alias("next"))
        return own.join(from_, "id", "left_semi").select(F.col("next").alias("id"))

    fns, models = kind("Function"), kind("Model")
    accessors = step(models, "ACCESSES", "dst", "src").distinct()
    found = [
        step(fns, "CALLS", "dst", "src"),
        step(fns, "CALLS", "src", "dst"),
        step(fns, "FLOWS_TO", "dst", "src"),
        step(kind("Middleware"), "PROTECTED_BY", "dst", "src"),
        accessors,
        step(accessors, "CALLS", "dst", "src"),
        step(kind("Input"), "FLOWS_TO", "src", "dst"),
    ]
    expanded = found[0]
    for f in found[1:]:
        expanded = expanded.unionByName(f)
    expanded = expanded.distinct().join(start, "id", "left_anti")
    return start.withColumn("how", F.lit("direct")).unionByName(expanded.withColumn("how", F.lit("expanded")))


def affected(findings: DataFrame, changed: DataFrame, nodes: str = "affected_nodes") -> DataFrame:
    """Findings of which a node is among the changed ids, or whose ``File:`` node's bare path is."""
    each = findings.select("finding_id", F.explode(nodes).alias("id")).select("finding_id", F.explode(F.array(F.col("id"), F.regexp_replace("id", "^File:", ""))).alias("id"))
    hit = each.join(changed.select("id").distinct(), "id", "left_semi").select("finding_id").distinct()
    return findings.join(hit, "finding_id", "left_semi")


def next_status(status: str, verdict: str):
    """open, resolved, regressed: CONFIRMED reopens (a resolved finding regresses), REJECTED resolves, others leave."""
    s, v = F.col(status), F.col(verdict)
    return (
        F.when(s == "rejected", s).when(v == "CONFIRMED", F.when(s == "resolved", F.lit("regressed")).otherwise(F.lit("open"))).when(v == "REJECTED", F.lit("resolved")).otherwise(s)
    )


def folded_status(events: DataFrame, key: str, order: Sequence[str], verdict: str, initial: str = "open") -> DataFrame:
    """(key, status, steps): each key's verdicts in order, folded through the state machine.

    The end state depends on the last decisive verdict and, where that is CONFIRMED, on the decisive one before it; both
    are partial aggregates, so a key's history is never collected.
    """
    at = F.struct(*order)
    decisive = events.where(F.col(verdict).isin("CONFIRMED", "REJECTED"))
    last = decisive.groupBy(key).agg(F.max(F.struct(*order, verdict)).alias("last"))
    before = decisive.join(last, key).where(at < F.struct(*[F.col(f"last.{o}") for o in order])).groupBy(key).agg(F.max_by(verdict, at).alias("before"))
    ended = last.join(before, key, "left")
    status = F.when(F.col(f"last.{verdict}") == "REJECTED", F.lit("resolved")).when(F.col("before") == "REJECTED", F.lit("regressed")).otherwise(F.lit("open"))
    steps = events.groupBy(key).agg(F.count("*").alias("steps"))
    return steps.join(ended.select(key, status.alias("status")), key, "left").withColumn("status", F.coalesce("status", F.lit(initial)))
