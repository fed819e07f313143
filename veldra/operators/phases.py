"""Edges with several writers: the phases of a graph build, in order.

Operations on models are written first, then what taint analysis found: calls that hand on inputs, and sinks that inputs reach. Each
phase knows what the ones before it wrote: a sink on an operation's line changes that operation, others are
appended, and a list takes no more than its cap, whoever comes. What a sequence of writers would leave is said as ranks, first
places and grouped flags, so an edge with any number of writers needs partial aggregates and a bounded window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators import merge

CAP_OPS = 60
PAIR = ["src", "dst"]
OP = "struct<op: string, line: int, sources: array<string>, tainted: boolean, possible: boolean, sanitized: boolean, sanitizer: string>"


def _ranked(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each pair, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*PAIR).orderBy(*order))).where(F.col("rank") <= cap)


def _listed(rows: DataFrame) -> DataFrame:
    """(src, dst, ops) by rank."""
    op = F.struct("op", "line", "sources", "tainted", "possible", "sanitized", "sanitizer").cast(OP)
    return rows.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("rank", op.alias("op")))).alias("l")).select(*PAIR, F.transform("l", lambda x: x["op"]).alias("ops"))


def accesses(ops: DataFrame, cap: int = CAP_OPS) -> DataFrame:
    """(src, dst, ops): one edge of each function and model; ops: (src, dst, ord, op, line, sources)."""
    none = {c: F.lit(None).cast(t) for c, t in (("tainted", "boolean"), ("possible", "boolean"), ("sanitized", "boolean"), ("sanitizer", "string"))}
    return _listed(_ranked(ops, ["ord"], cap).withColumns(none))


def _last(value: str, order: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def flows_to_sinks(ops: DataFrame, sinks: DataFrame, cap: int = CAP_OPS) -> DataFrame:
    """(src, dst, ops, tainted, possible, sanitized, sanitizer): edges of functions to what their inputs flow into.

    ops: (src, dst, ord, op, line, sources); those without sources write nothing. sinks: (src, dst, ord, op, line, sources,
    tainted, possible, sanitized, sanitizer). A sink changes the first operation of its name and line: sources are added,
    it is tainted if one of both is, sanitized if both are, and the last sanitizer stays; ``possible`` is the first writer's.
    An edge is tainted or possible if one sink is, and sanitized if all writers are, which operations never are; its
    sanitizer is the first writer's.
    """
    first = _ranked(ops.where(F.size("sources") > 0), ["ord"], cap).select(*PAIR, "rank", "op", "line", "sources")
    same = [*PAIR, "op", "line"]
    groups = sinks.groupBy(*same).agg(
        F.min("ord").alias("ord"),
        F.bool_or("tainted").alias("tainted"),
        F.min_by("possible", "ord").alias("possible"),
        F.bool_and("sanitized").alias("sanitized"),
        _last("sanitizer", "ord").alias("sanitizer"),
    )
    each = sinks.select(*same, "ord", F.posexplode("sources").alias("nth", "source"))
    added = merge.union_rows(each, same, "source", ["ord", "nth"], "added")
    # what has no sources is written, too
    groups = groups.join(added, same, "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    target = first.groupBy(*same).agg(F.min("rank").alias("rank"))
    hit = groups.join(target, same).select(*PAIR, "rank", "added", F.col("tainted").alias("by_sink"), F.col("sanitizer").alias("its"))
    changed = first.join(hit, [*PAIR, "rank"], "left").select(
        *PAIR,
        "rank",
        "op",
        "line",
        F.when(F.col("added").isNotNull(), F.array_distinct(F.concat("sources", "added"))).otherwise(F.col("sources")).alias("sources"),
        F.col("by_sink").alias("tainted"),
        F.lit(None).cast("boolean").alias("possible"),
        F.when(F.col("added").isNotNull(), False).alias("sanitized"),
        F.col("its").alias("sanitizer"),
    )
    held = first.groupBy(*PAIR).agg(F.max("rank").alias("held"))
    more = _ranked(groups.join(target, same, "left_anti"), ["ord"], cap).join(held, PAIR, "left").withColumn("rank", F.col("rank") + F.coalesce("held", F.lit(0)))
    more = more.where(F.col("rank") <= cap).select(*PAIR, "rank", "op", "line", F.col("added").alias("sources"), "tainted", "possible", "sanitized", "sanitizer")
    lists = _listed(changed.unionByName(more))
    flags = sinks.groupBy(*PAIR).agg(F.bool_or("tainted").alias("tainted"), F.bool_or("possible").alias("possible"), F.bool_and("sanitized").alias("every"), F.min_by("sanitizer", "ord").alias("first_one"))
    begun = F.col("held").isNotNull()
    made = lists.join(held, PAIR, "left").join(flags, PAIR, "left")
    return made.select(*PAIR, "ops", "tainted", "possible", F.when(F.col("every").isNotNull(), F.col("every") & ~begun).alias("sanitized"), F.when(~begun, F.col("first_one")).alias("sanitizer"))


def flows_to_functions(calls: DataFrame) -> DataFrame:
    """(src, dst, sources, via, line, tainted, possible, sanitized, sanitizer): one edge of each pair of functions; via, line and
    sanitizer are the first writer's. calls: (src, dst, ord, sources, via, line, tainted, possible, sanitized, sanitizer)."""
    once = calls.groupBy(*PAIR).agg(
        *[F.min_by(c, "ord").alias(c) for c in ("via", "line", "sanitizer")], F.bool_or("tainted").alias("tainted"), F.bool_or("possible").alias("possible"), F.bool_and("sanitized").alias("sanitized")
    )
    sources = merge.union_rows(calls.select(*PAIR, "ord", F.posexplode("sources").alias("nth", "source")), PAIR, "source", ["ord", "nth"], "sources")
    return once.join(sources, PAIR, "left").select(*PAIR, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "via", "line", "tainted", "possible", "sanitized", "sanitizer")
