"""Changes of code bases as a stream: each micro-batch updates graph, findings, change sets and timeline in one commit.

A change is a file with all the nodes and edges that it holds from now on; none, if it was deleted. A micro-batch is worked
on as a whole: what differs from the committed graph, what that touches, which findings change their status. A batch that is
delivered again changes nothing. Micro-batches don't overlap; changes of projects that another run holds are skipped and
logged, as the next change of the file brings all its rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions.scalars import node_type
from veldra.operators import change
from veldra.operators.store import newest
from veldra.sources.landing import checkpointed
from veldra.sources.tableset import Table, TableSet

NODE, EDGE = "id string, type string, key string, hash string", "id string, type string, src string, dst string, hash string"
CHANGES = f"project string, file string, kind string, seq long, nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>"
TABLES = {
    "nodes": Table(f"project string, file string, {NODE}", ["project", "id"]),
    "edges": Table(f"project string, file string, {EDGE}", ["project", "id"]),
    "findings": Table("project string, finding_id long, status string, affected_nodes array<string>", ["project", "finding_id"]),
    "change_sets": Table("change_set string, project string, files long, added_files long, deleted_files long, nodes_changed long, edges_changed long, direct long, affected long, routes long, transitions long, status string", ["change_set"]),
    "transitions": Table("change_set string, project string, finding_id long, old string, new string", ["change_set", "finding_id"], log=True),
    "timeline": Table("change_set string, seq int, project string, type string, summary string", ["change_set", "seq"], log=True),
}
AT = "\x1f"  # parts an id from its project: ids are a project's own


def _of(id_: Column | str, project: Column | str = "project") -> Column:
    return F.concat_ws(AT, id_, project)


def _scoped(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with ids that hold the project, so that several projects are worked on at once."""
    return rows.withColumns({c: _of(c) for c in columns})


def process(tables: TableSet, changes: DataFrame, batch: int, verdicts: DataFrame, busy: DataFrame | None = None) -> bool:
    """One batch of changes (CHANGES); verdicts: (project, finding_id, verdict) of checks made again, busy: (project) held by others."""
    if batch <= tables.batch:
        return False
    last = newest(changes, ["project", "file"], [F.desc("seq")])
    mine = checkpointed(last.join(busy, "project", "left_anti") if busy is not None else last)
    projects = mine.select("project").distinct()
    here = {name: tables.read(name).join(projects, "project", "left_semi") for name in ("nodes", "edges", "findings")}
    place = mine.select("project", "file")

    def after(name: str) -> DataFrame:
        brought = mine.select("project", "file", F.explode(name).alias("r")).select("project", "file", "r.*")
        return here[name].join(place, ["project", "file"], "left_anti").unionByName(brought).dropDuplicates(["project", "id"])

    nodes, edges = checkpointed(after("nodes")), checkpointed(after("edges"))
    old_nodes, new_nodes = _scoped(here["nodes"], "id", "file"), _scoped(nodes, "id", "file")
    old_edges, new_edges = _scoped(here["edges"], "id", "src", "dst"), _scoped(edges, "id", "src", "dst")
    findings = here["findings"].withColumns({"finding_id": F.struct("project", "finding_id"), "affected_nodes": F.transform("affected_nodes", lambda n: _of(n))})
    files = mine.select(_of(F.regexp_replace("file", "^/+", "")).alias("path"))
    checks = verdicts.select(F.struct("project", "finding_id").alias("finding_id"), "verdict")
    made = change.processed(old_nodes, new_nodes, old_edges, new_edges, files, findings, checks)

    part = lambda i: F.substring_index(F.col("id"), AT, -1 if i else 1)
    split = lambda df: df.withColumns({"project": part(1), "id": part(0)})
    node_delta, edge_delta = split(made.node_delta.where("change <> 'unchanged'")), split(made.edge_delta.where("change <> 'unchanged'"))
    impact = split(made.impact)
    moved = made.transitions.select(F.col("finding_id.project").alias("project"), F.col("finding_id.finding_id").alias("finding_id"), "old", "new")

    count = lambda df, *named: df.groupBy("project").agg(*[F.count_if(c).alias(n) for n, c in named])
    yes = F.lit(True)
    sets = count(mine, ("files", yes), ("added_files", F.col("kind") == "added"), ("deleted_files", F.col("kind") == "deleted"))
    for more in (
        count(node_delta, ("nodes_changed", yes)),
        count(edge_delta, ("edges_changed", yes)),
        count(impact, ("direct", F.col("how") == "direct"), ("affected", yes), ("routes", node_type("id") == "Route")),
        count(moved, ("transitions", yes)),
    ):
        sets = sets.join(more, "project", "left")
    sets = checkpointed(sets.na.fill(0).withColumns({"change_set": F.concat_ws("-", "project", F.lit(batch).cast("string")), "status": F.lit("completed")}))

    named = lambda df: df.withColumn("change_set", F.concat_ws("-", "project", F.lit(batch).cast("string")))
    event = lambda df, seq, kind, text: named(df).select("change_set", F.lit(seq).alias("seq"), "project", F.lit(kind).alias("type"), text.alias("summary"))
    begun = F.format_string("%d files changed, %d nodes affected", "files", "affected")
    timeline = event(sets, 0, "change.detected", begun).unionByName(event(sets, 1, "change.completed", F.format_string("%d finding transitions", "transitions")))
    if busy is not None:
        held = last.join(busy, "project", "left_semi").groupBy("project").agg(F.count("*").alias("files"))
        timeline = timeline.unionByName(event(held, 0, "change.skipped", F.format_string("%d files changed, another run is active", "files")))
    fresh = lambda rows, delta: rows.join(delta.where("change <> 'removed'").select("project", "id"), ["project", "id"], "left_semi")
    removed = lambda delta: delta.where("change = 'removed'").select("project", "id")
    patched = here["findings"].join(moved.select("project", "finding_id", "new"), ["project", "finding_id"]).withColumn("status", F.col("new"))
    rows = {
        "nodes": fresh(nodes, node_delta),
        "edges": fresh(edges, edge_delta),
        "findings": patched,
        "change_sets": sets,
        "transitions": named(moved),
        "timeline": timeline,
    }
    return tables.commit(batch, rows, {"nodes": removed(node_delta), "edges": removed(edge_delta)})


def run(tables: TableSet, changes: DataFrame, state: str, verdicts: DataFrame, busy: DataFrame | None = None) -> None:
    """Works off a stream of changes until there are no more; ``state`` is the stream's own folder. Batch 0 of tables is what they begin with."""

    def start(rows: DataFrame, batch: int) -> None:
        process(tables, rows, batch + 1, verdicts, busy)

    changes.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(start).start().awaitTermination()
