"""The committing change stream over code bases made from the star schema, next to DuckDB SQL.

A project is every fourth customer, a file a customer, a node an order, and each order calls its project's next one. Two of
three files change, one project a micro-batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.plans.queries import query
from veldra.plans.star import table
from veldra.sources.landing import fresh
from veldra.sources.tableset import Table, TableSet
from veldra.streaming import processing

PROJECTS = 4


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(project, file, version 0 or 1, node) and the edges likewise, of version 1 for changed files only."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_custkey") % PROJECTS).alias("p"))
    own = Window.partitionBy("p").orderBy("k")
    o = o.withColumns({"k2": F.lead("k").over(own), "project": F.concat(F.lit("p"), F.col("p").cast("string")), "file": F.concat(F.lit("f"), F.col("c").cast("string")), "id": F.concat(F.lit("Function:f"), F.col("k").cast("string"))})
    o = o.withColumns({"dst": F.concat(F.lit("Function:f"), F.col("k2").cast("string")), "version": F.explode(F.array(F.lit(0), F.lit(1)))}).where("version = 0 OR c % 3 <> 0")
    there = "CASE version WHEN 0 THEN k % 83 <> 0 ELSE k % 89 <> 0 END"
    nodes = o.where(there).selectExpr("project", "file", "version", "c", "id", "'Function' AS type", "concat('f', k) AS key", "CASE WHEN version = 1 AND k % 97 = 0 THEN 'b' ELSE 'a' END AS hash")
    edges = o.where(f"{there} AND k2 IS NOT NULL").selectExpr("project", "file", "version", "c", "concat('CALLS|', id, '|', dst) AS id", "'CALLS' AS type", "id AS src", "dst", "'a' AS hash")
    return nodes, edges


def committed(spark, sf_dir) -> TableSet:
    """The tables after all micro-batches."""
    nodes, edges = _versions(spark, sf_dir)
    o = table(spark, sf_dir, "orders").selectExpr(f"concat('p', o_custkey % {PROJECTS}) AS project", "o_orderkey AS k")
    path = fresh(spark, "changes")
    tables = TableSet(spark, path, processing.TABLES, new=True, every=4)
    findings = o.selectExpr("project", "k AS finding_id", "CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'rejected' END AS status", "array(concat('Function:f', k)) AS affected_nodes")
    tables.commit(0, {"nodes": nodes.where("version = 0"), "edges": edges.where("version = 0"), "findings": findings})
    of = lambda df, name, *fields: df.where("version = 1").groupBy("project", "file").agg(F.collect_list(F.struct(*fields)).alias(name))
    files = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").selectExpr(f"concat('p', o_custkey % {PROJECTS}) AS project", "concat('f', o_custkey) AS file").distinct()
    changed = files.join(of(nodes, "nodes", "id", "type", "key", "hash"), ["project", "file"], "left").join(of(edges, "edges", "id", "type", "src", "dst", "hash"), ["project", "file"], "left")
    changed = changed.select("project", "file", F.lit("changed").alias("kind"), F.lit(1).cast("long").alias("seq"), "nodes", "edges").to(spark.createDataFrame([], processing.CHANGES).schema)
    for p in range(PROJECTS):  # one file each, so one micro-batch each
        changed.where(F.col("project") == f"p{p}").coalesce(1).write.mode("append").parquet(f"{path}/arriving")
    stream = spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arriving")
    verdicts = o.where("k % 2 = 0").selectExpr("project", "k AS finding_id", "CASE WHEN k % 4 = 0 THEN 'CONFIRMED' ELSE 'REJECTED' END AS verdict")
    processing.run(tables, stream, f"{path}/state", verdicts)
    return tables


SQL = f"""WITH n AS (SELECT o_orderkey AS k, o_custkey AS c, 'p' || o_custkey % {PROJECTS} AS project, 'Function:f' || o_orderkey AS id, o_custkey % 3 <> 0 AS v, lead(o_orderkey) OVER (PARTITION BY o_custkey % {PROJECTS} ORDER BY o_orderkey) AS k2 FROM orders),
s AS (SELECT *, k % 83 <> 0 AS old, CASE WHEN v THEN k % 89 <> 0 ELSE k % 83 <> 0 END AS new, v AND k % 97 = 0 AS other FROM n),
e AS (SELECT project, id AS src, 'Function:f' || k2 AS dst, old, new FROM s WHERE k2 IS NOT NULL),
moved AS (SELECT * FROM e WHERE old <> new),
touched AS (SELECT project, id FROM s WHERE old <> new OR (old AND new AND other) UNION SELECT project, src FROM moved UNION SELECT project, dst FROM moved),
direct AS (SELECT t.project, t.id FROM touched t JOIN s USING (project, id) WHERE new OR old UNION SELECT project, 'File:f' || c FROM s WHERE v UNION SELECT project, id FROM s WHERE v AND new),
impact AS (SELECT project, id, 'direct' AS how FROM direct UNION ALL SELECT project, id, 'expanded' FROM (SELECT project, src AS id FROM e WHERE new AND (project, dst) IN (SELECT (project, id) FROM direct)
 UNION SELECT project, dst FROM e WHERE new AND (project, src) IN (SELECT (project, id) FROM direct)) WHERE (project, id) NOT IN (SELECT (project, id) FROM direct)),
f AS (SELECT project, k AS finding_id, CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'rejected' END AS status,
 CASE WHEN (project, id) NOT IN (SELECT (project, id) FROM impact) OR k % 3 = 2 OR k % 2 = 1 THEN NULL WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 1 THEN 'regressed' ELSE 'open' END ELSE 'resolved' END AS next FROM s),
t AS (SELECT *, coalesce(next, status) AS now FROM f),
c AS (SELECT project, (SELECT count(DISTINCT c) FROM s WHERE v AND s.project = p.project) AS files, (SELECT count(*) FROM s WHERE s.project = p.project AND (old <> new OR (old AND new AND other))) AS nodes_changed,
 (SELECT count(*) FROM moved m WHERE m.project = p.project) AS edges_changed, (SELECT count(*) FROM direct d WHERE d.project = p.project) AS direct, (SELECT count(*) FROM impact i WHERE i.project = p.project) AS affected,
 (SELECT count(*) FROM t WHERE t.project = p.project AND now <> status) AS transitions FROM (SELECT DISTINCT project FROM s WHERE v) p)"""


@query(SQL + " SELECT project, id, CASE WHEN other THEN 'b' ELSE 'a' END AS hash FROM s WHERE new UNION ALL SELECT project, 'CALLS|' || src || '|' || dst, 'a' FROM e WHERE new")
def stream_committed_graph(spark, sf_dir):
    """Nodes and edges as the stream leaves them."""
    tables = committed(spark, sf_dir)
    return reduce(DataFrame.unionByName, [tables.read(name).select("project", "id", "hash") for name in ("nodes", "edges")])


@query(SQL + " SELECT project, finding_id, now AS status FROM t")
def stream_committed_findings(spark, sf_dir):
    """All findings with their status after the last batch."""
    return committed(spark, sf_dir).read("findings").select("project", "finding_id", "status")


@query(
    SQL
    + """ SELECT project, 'set' AS type, concat_ws(' ', files, nodes_changed, edges_changed, direct, affected, transitions) AS summary FROM c
 UNION ALL SELECT project, 'change.detected', files || ' files changed, ' || affected || ' nodes affected' FROM c UNION ALL SELECT project, 'change.completed', transitions || ' finding transitions' FROM c
 UNION ALL SELECT project, status || ' to ' || now, finding_id::VARCHAR FROM t WHERE now <> status"""
)
def stream_committed_logs(spark, sf_dir):
    """Change sets, the timeline, and the transitions of findings."""
    tables = committed(spark, sf_dir)
    counts = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("files", "nodes_changed", "edges_changed", "direct", "affected", "transitions")])
    sets = tables.read("change_sets").select("project", F.lit("set").alias("type"), counts.alias("summary"))
    moved = tables.read("transitions").select("project", F.concat_ws(" to ", "old", "new").alias("type"), F.col("finding_id").cast("string").alias("summary"))
    return sets.unionByName(tables.read("timeline").select("project", "type", "summary")).unionByName(moved)


@query(
    """WITH r AS (SELECT event_id AS id, event_id % 1000 AS finding, event_type AS outcome, epoch_ms(ts) AS at, row_number() OVER (PARTITION BY event_id % 1000 ORDER BY ts DESC, event_id DESC) AS nth FROM events)
SELECT finding, id, outcome, (SELECT count(*) FROM events) AS records FROM r WHERE nth = 1"""
)
def log_latest(spark, sf_dir):
    """Records appended in batches that repeat each other in part: the last of each key, and how many there are."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id % 1000 AS finding", "event_type AS outcome", "unix_millis(CAST(ts AS timestamp)) AS at")
    tables = TableSet(spark, fresh(spark, "records"), {"runs": Table("id bigint, finding bigint, outcome string, at bigint", ["id"], log=True)}, new=True)
    for i in range(3):  # each batch delivers a third again
        tables.commit(i, {"runs": rows.where(f"id % 3 IN ({i}, {(i + 1) % 3})")})
    tables.commit(2, {"runs": rows})
    count = tables.read("runs").agg(F.count("*").alias("records"))
    return tables.latest("runs", ["finding"], ["at", "id"]).select("finding", "id", "outcome").join(F.broadcast(count))  # one row
