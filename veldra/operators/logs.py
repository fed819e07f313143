"""Operators over logs, versions of sets and rule tables.

Windows are per key and ordered, so their sorts spill; nothing is collected into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators.store import GraphStore


def pruned(messages: DataFrame, thread: str, order: list[str], role: str, text: str, dropped: str, trimmed: str, budget: int, keep: int, longest: int, head: int = 2) -> DataFrame:
    """messages with ``content``: the text, shortened where its thread is longer than ``budget`` characters.

    Then all but the last ``keep`` rows of role ``dropped`` become a marker, and rows of role ``trimmed`` are cut to
    ``longest`` characters. The first ``head`` rows of a thread never change; null texts are empty.
    """
    body = F.coalesce(text, F.lit(""))
    total = F.sum(F.length(body)).over(Window.partitionBy(thread))
    pos = F.row_number().over(Window.partitionBy(thread).orderBy(*order))
    from_end = F.row_number().over(Window.partitionBy(thread, role).orderBy(*[F.desc(c) for c in order]))
    content = (
        F.when((total <= budget) | (pos <= head), body)
        .when((F.col(role) == dropped) & (from_end > keep), F.lit("[omitted]"))
        .when((F.col(role) == trimmed) & (F.length(body) > longest), F.concat(F.substring(body, 1, longest), F.lit("…")))
        .otherwise(body)
    )
    return messages.withColumn("content", content)


def budgeted(steps: DataFrame, key: str, order: list[str], cost: str, max_steps: int, max_cost: int) -> DataFrame:
    """steps with ``seq``, ``spent`` (the running cost) and ``status``: within, or the budget that is used up first."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("seq", F.count("*").over(so_far)).withColumn("spent", F.sum(cost).over(so_far))
    return out.withColumn("status", F.when(F.col("seq") > max_steps, F.lit("steps")).when(F.col("spent") > max_cost, F.lit("cost")).otherwise(F.lit("within")))


def sets_differ(old: DataFrame, new: DataFrame, key: str, member: str) -> DataFrame:
    """(key, differs): whether a key has different members in two versions; one grouped pass over both, no join."""
    side = lambda df, in_new: df.select(key, member, F.lit(in_new).alias("in_new"))
    each = side(old, False).unionByName(side(new, True)).groupBy(key, member).agg((F.min("in_new") == F.max("in_new")).alias("alone"))
    return each.groupBy(key).agg(F.bool_or("alone").alias("differs"))


def rule_problems(rules: DataFrame) -> DataFrame:
    """(type, problem, detail) of a rule table (type, applies_to): types that occur twice, and references to unknown types."""
    twice = rules.groupBy("type").agg(F.count("*").alias("n")).where("n > 1").select("type", F.lit("duplicate").alias("problem"), F.col("n").cast("string").alias("detail"))
    named = rules.select("type", F.explode("applies_to").alias("detail")).distinct()
    unknown = named.join(rules.select(F.col("type").alias("detail")), "detail", "left_anti")
    return twice.unionByName(unknown.select("type", F.lit("unknown reference").alias("problem"), "detail"))


def subview(graph: GraphStore, ids: DataFrame, both_ends: bool) -> GraphStore:
    """The nodes with these ids, and the edges with both ends, or at least one end, among them."""
    own = ids.select("id").distinct()
    edges = graph.edges_of(own) if not both_ends else graph.edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return GraphStore(graph.nodes.join(own, "id", "left_semi"), edges)


# fixed values: what file names and node types each kind of review looks at
AUTH_FILES = ("route", "auth", "middleware", "jwt", "token", "session", "permission", "role", "guard", "access")
DATA_FILES = ("model", "schema", "db", "database", "query", "mongo", "input", "dto", "secret", "param")
AUTH_TYPES = ("route", "middleware")
DATA_TYPES = ("model", "input", "database", "secret", "asset")


def relevant_reviews(files: Column, node_ids: Column) -> Column:
    """The reviews that a change set calls for, sorted; both where nothing tells."""
    named = lambda words: F.exists(files, lambda f: F.lower(f).rlike("|".join(words)))
    typed = lambda types: F.exists(node_ids, lambda i: F.lower(F.substring_index(i, ":", 1)).isin(*types))
    auth, data = named(AUTH_FILES) | typed(AUTH_TYPES), named(DATA_FILES) | typed(DATA_TYPES)
    neither = ~auth & ~data
    return F.filter(F.array(F.when(auth | neither, F.lit("auth")), F.when(data | neither, F.lit("dataflow"))), lambda x: x.isNotNull())
