"""A change of a code base from end to end: what differs, what it touches, and what follows for findings and logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.functions import scalars as S
from veldra.operators import delta
from veldra.sources.landing import checkpointed


@dataclass(frozen=True)
class Change:
    node_delta: DataFrame  # (id, change)
    edge_delta: DataFrame
    impact: DataFrame  # (id, how)
    transitions: DataFrame  # (finding_id, old, new)
    change_set: DataFrame  # one row of counts
    timeline: DataFrame  # (seq, type, summary)


def of_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id): the File nodes of changed files (path), what they contain, what names the file, and functions whose key begins with it."""
    path = F.regexp_replace(S.to_posix("path"), "^/+", "")
    changed = files.select(path.alias("path")).distinct()
    own = changed.select(S.node_id(F.lit("File"), "path").alias("id"))
    held = edges.where("type = 'CONTAINS'").join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    named = nodes.where("file IS NOT NULL").join(changed.withColumnRenamed("path", "file"), "file", "left_semi").select("id")
    begun = nodes.where("type = 'Function'").select("id", F.regexp_extract("key", "^([^#@]*)[#@]", 1).alias("path")).where("path <> ''").join(changed, "path", "left_semi").select("id")
    return own.unionByName(held).unionByName(named).unionByName(begun).distinct()


def processed(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame, files: DataFrame, findings: DataFrame, verdicts: DataFrame) -> Change:
    """nodes: (id, type, key, file, hash), edges: (id, type, src, dst, hash), files: (path), findings: (finding_id, status,
    affected_nodes), verdicts: (finding_id, verdict) of the checks made again; a finding without one keeps its status."""
    node_delta, edge_delta = checkpointed(delta.classified(old_nodes, new_nodes)), checkpointed(delta.classified(old_edges, new_edges))
    touched = delta.touched_nodes(node_delta, edge_delta, old_edges, new_edges, new_nodes)
    direct = touched.unionByName(of_files(new_nodes, new_edges, files)).distinct()
    impact = checkpointed(delta.impact(new_edges, direct))
    hit = delta.affected(findings, impact).join(verdicts, "finding_id", "left")
    moved = hit.select("finding_id", F.col("status").alias("old"), delta.next_status("status", "verdict").alias("new")).where("old <> new")
    moved = checkpointed(moved)
    count = lambda df, name, where="true": df.where(where).agg(F.count("*").alias(name))
    parts = [
        count(files.distinct(), "files"),
        count(node_delta, "nodes_changed", "change <> 'unchanged'"),
        count(edge_delta, "edges_changed", "change <> 'unchanged'"),
        count(impact, "direct", "how = 'direct'"),
        count(impact, "affected"),
        count(impact, "routes", "id LIKE 'Route:%'"),
        count(moved, "transitions"),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(F.broadcast(p))  # one row each
    event = lambda seq, kind, text: row.select(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), text.alias("summary"))
    begun = event(0, "change.detected", F.concat(F.col("files").cast("string"), F.lit(" files changed, "), F.col("affected").cast("string"), F.lit(" nodes affected")))
    ended = event(1, "change.completed", F.concat(F.col("transitions").cast("string"), F.lit(" finding transitions")))
    return Change(node_delta, edge_delta, impact, moved, row, begun.unionByName(ended))
