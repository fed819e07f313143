"""Property-graph store over two frames.

nodes: (id, type, key, props VARIANT, ...); edges: (id, type, src, dst, ...). Each method is one declarative plan; ids are
unique, and results are ordered by id where an order is promised.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def prop(path: str, kind: str = "string", props: str = "props") -> Column:
    """A property by dotted path."""
    return F.try_variant_get(F.col(props), "$." + path, kind)


def _one_of(column: str, wanted: str | Sequence[str] | None) -> Column:
    if wanted is None:
        return F.lit(True)
    return F.col(column) == wanted if isinstance(wanted, str) else F.col(column).isin(list(wanted)) if wanted else F.lit(False)


@dataclass(frozen=True)
class GraphStore:
    nodes: DataFrame
    edges: DataFrame

    def node(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def nodes_by_id(self, ids: DataFrame) -> DataFrame:
        """Nodes in the order of ids (id, ord)."""
        return self.nodes.join(ids, "id").orderBy("ord")

    def find(self, type: str | Sequence[str] | None = None, key: str | None = None, key_prefix: str | None = None, props: dict[str, Any] | None = None, limit: int | None = None) -> DataFrame:
        out = self.nodes.where(_one_of("type", type))
        if key is not None:
            out = out.where(F.col("key") == key)
        if key_prefix is not None:
            out = out.where(F.col("key").startswith(key_prefix))
        for path, value in (props or {}).items():
            out = out.where(prop(path, _TYPES[value.__class__]) == F.lit(value))
        out = out.orderBy("id")
        return out.limit(limit) if limit is not None else out

    def find_edges(self, type: str | Sequence[str] | None = None, src: str | None = None, dst: str | None = None, limit: int | None = None) -> DataFrame:
        out = self.edges.where(_one_of("type", type))
        if src is not None:
            out = out.where(F.col("src") == src)
        if dst is not None:
            out = out.where(F.col("dst") == dst)
        out = out.orderBy("id")
        return out.limit(limit) if limit is not None else out

    def edges_of(self, ids: DataFrame, type: str | Sequence[str] | None = None, direction: str = "both") -> DataFrame:
        """Edges at the given ids (id), once each."""
        own, ends = self.edges.where(_one_of("type", type)), ids.select("id").distinct()
        sides = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
        found = [own.join(ends.withColumnRenamed("id", s), s, "left_semi") for s in sides]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1]).dropDuplicates(["id"])

    def neighbors(self, ids: DataFrame, type: str | Sequence[str] | None = None, direction: str = "out") -> DataFrame:
        """(start, and the node's columns): distinct neighbours of each id; missing nodes are left out."""
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        steps = self.edges.where(_one_of("type", type)).select(F.col(near).alias("start"), F.col(far).alias("id"))
        return steps.join(ids.select(F.col("id").alias("start")).distinct(), "start", "left_semi").distinct().join(self.nodes, "id")

    def stats(self) -> DataFrame:
        """(what, type, n): nodes and edges by type."""
        count = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
        return count(self.nodes, "node").unionByName(count(self.edges, "edge"))

    def dangling(self) -> DataFrame:
        """Edges of which an end is no node; empty in a consistent graph."""
        ids = self.nodes.select("id")
        gone = lambda end: self.edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select("id", "type", "src", "dst")
        return gone("src").unionByName(gone("dst")).distinct()

    def without(self, ids: DataFrame) -> GraphStore:
        """The graph without these nodes and their edges."""
        gone = ids.select("id").distinct()
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
        return GraphStore(self.nodes.join(gone, "id", "left_anti"), edges)

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> GraphStore:
        """New rows replace old ones of the same id as a whole."""
        newest = lambda old, new: old if new is None else old.join(new.select("id"), "id", "left_anti").unionByName(new)
        return GraphStore(newest(self.nodes, nodes), newest(self.edges, edges))


def page(rows: DataFrame, order: Sequence[str | Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit in this order, with ``total`` and ``truncated``.

    The page is a top-k (no full sort leaves the executors); the total is one more counting pass joined as a scalar.
    """
    total = rows.agg(F.count("*").alias("total"))
    some = rows.orderBy(*order).offset(offset).limit(limit)
    return some.join(F.broadcast(total)).withColumn("truncated", F.lit(offset + limit) < F.col("total"))  # one row


def newest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order, ties broken by it: append-only logs seen as tables."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def findings_page(findings: DataFrame, limit: int = 200, **filters: str | None) -> DataFrame:
    """The newest findings (id, type, affected_nodes, created, ...) for which all given columns have the given values, with a title."""
    for name, value in filters.items():
        if value is not None:
            findings = findings.where(F.col(name) == value)
    title = F.concat_ws(" on ", "type", F.coalesce(F.get("affected_nodes", F.lit(0)), F.lit("(unknown)")))
    return findings.orderBy(F.desc("created"), "id").limit(limit).withColumn("title", title)
