"""Linking and change processing over records made from the star schema, next to DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.operators import change, linking
from veldra.plans.queries import query
from veldra.plans.star import table


@query("""SELECT 'src/a/p' || p_partkey || '.ts' AS file, CASE p_partkey % 4 WHEN 0 THEN '../s' || j WHEN 1 THEN '@/s' || j WHEN 2 THEN 's' || j || '.js' ELSE 'express' END AS spec,
 CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN j % 2 = 0 THEN 'src/s' || j || '.ts' ELSE 'src/s' || j || '/index.js' END AS found FROM (SELECT *, p_partkey % 10 AS j FROM part)""")
def link_modules(spark, sf_dir):
    """Module paths: relative, by an alias, by the base folder with another ending, and outside."""
    files = table(spark, sf_dir, "supplier").selectExpr("CASE WHEN s_suppkey % 2 = 0 THEN concat('src/s', s_suppkey, '.ts') ELSE concat('src/s', s_suppkey, '/index.js') END AS path")
    spec = "CASE p_partkey % 4 WHEN 0 THEN concat('../s', p_partkey % 10) WHEN 1 THEN concat('@/s', p_partkey % 10) WHEN 2 THEN concat('s', p_partkey % 10, '.js') ELSE 'express' END"
    refs = table(spark, sf_dir, "part").selectExpr("concat('src/a/p', p_partkey, '.ts') AS file", f"{spec} AS spec")
    rows = [("src", ".", 0, "@/*", 0, "none/*"), ("src", ".", 0, "@/*", 1, "./*"), ("", None, 0, "@/*", 0, "far/*")]
    return linking.modules(refs, files, spark.createDataFrame(rows, "dir string, base_url string, ord int, pattern string, target_ord int, target string"))


@query("""WITH RECURSIVE w AS (SELECT o_orderkey AS root, o_orderkey AS k FROM orders UNION ALL SELECT root, k // 2 FROM w WHERE k % 7 <> 0)
SELECT root, CASE WHEN k % 2 = 0 THEN 'fn' ELSE 'model' END AS kind, CASE WHEN k % 2 = 0 THEN 'fn' ELSE 'model' END || k AS a FROM w WHERE k % 7 = 0""")
def link_exports(spark, sf_dir):
    """Names that files pass on under other names, by name or all at once, down to where they are made."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name = lambda k: f"concat('x', ({k}) % 3)"
    passed = o.where("k % 7 <> 0").selectExpr("concat('f', k) AS file", "0 AS ord", f"{name('k')} AS name", "'spec' AS spec", "concat('f', k div 2) AS found", f"{name('k div 2')} AS local", "CAST(NULL AS string) AS fn", "CAST(NULL AS string) AS model")
    made = o.where("k % 7 = 0").selectExpr("concat('f', k) AS file", "1 AS ord", f"{name('k')} AS name", "CAST(NULL AS string) AS spec", "CAST(NULL AS string) AS found", "CASE WHEN k % 4 = 0 THEN 'own' END AS local", "CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN concat('fn', k) END AS fn", "CASE WHEN k % 2 = 1 THEN concat('model', k) END AS model")
    own = o.where("k % 28 = 0").selectExpr("concat('f', k) AS file", "'own' AS ident", "0 AS ord", "'fn' AS kind", "concat('fn', k) AS a", "CAST(NULL AS string) AS b")
    starts = o.selectExpr("k AS root", "'export' AS state", "concat('f', k) AS file", f"{name('k')} AS name")
    return linking.targets(starts, passed.unionByName(made), own).select("root", "kind", "a")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS r, c_custkey // 3 AS parent, '/p' || c_custkey % 10 || '/' AS path FROM customer WHERE c_custkey > 0 AND c_custkey % 50 <> 49),
w AS (SELECT c_custkey AS r, '' AS prefix, c_custkey = 0 AS mounted FROM customer WHERE c_custkey = 0 OR c_custkey % 50 = 49 UNION ALL SELECT m.r, w.prefix || rtrim(m.path, '/'), mounted FROM w JOIN m ON m.parent = w.r)
SELECT 'r' || r AS router, prefix, mounted FROM w""")
def link_routers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    routers = c.selectExpr("concat('r', c_custkey) AS router", "CASE WHEN c_custkey = 0 THEN 'app' ELSE 'router' END AS kind", "false AS implicit")
    mounts = c.where("c_custkey > 0 AND c_custkey % 50 <> 49").selectExpr("concat('r', c_custkey) AS router", "concat('r', c_custkey div 3) AS parent", "concat('/p', c_custkey % 10, '/') AS path")
    return linking.mounted(routers, mounts)


def _change(spark, sf_dir) -> change.Change:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    node = lambda rows, mark: rows.selectExpr("concat('Function:f', c, '#', k) AS id", "'Function' AS type", "concat('f', c, '#', k) AS key", "CAST(NULL AS string) AS file", f"{mark} AS hash", "k")
    old, new = node(o.where("k % 83 <> 0"), "'a'"), node(o.where("k % 89 <> 0"), "CASE WHEN k % 97 = 0 THEN 'b' ELSE 'a' END")
    ids = node(o, "'a'").select("id", "k")

    def edges(nodes: DataFrame) -> DataFrame:
        low = nodes.select(F.col("id").alias("src"), "k", F.expr("k div 2").alias("half")).where("k > 0")
        called = nodes.select(F.col("id").alias("dst"), F.col("k").alias("half"))
        return low.join(called, "half").select(F.concat_ws("|", F.lit("CALLS"), "src", "dst").alias("id"), F.lit("CALLS").alias("type"), "src", "dst", F.lit("a").alias("hash"))

    files = o.where("k % 97 = 0").select(F.concat(F.lit("/f"), F.col("c").cast("string")).alias("path"))
    findings = ids.selectExpr("k AS finding_id", "CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'rejected' END AS status", "array(id) AS affected_nodes")
    verdicts = o.where("k % 2 = 0").selectExpr("k AS finding_id", "CASE WHEN k % 4 = 0 THEN 'CONFIRMED' ELSE 'REJECTED' END AS verdict")
    return change.processed(old.drop("k"), new.drop("k"), edges(old), edges(new), files, findings, verdicts)


CHANGE = """WITH n AS (SELECT o_orderkey AS k, o_custkey AS c, 'Function:f' || o_custkey || '#' || o_orderkey AS id FROM orders),
e AS (SELECT a.k, b.k AS h, a.id AS src, b.id AS dst, a.k % 83 <> 0 AND b.k % 83 <> 0 AS old, a.k % 89 <> 0 AND b.k % 89 <> 0 AS new FROM n a JOIN n b ON b.k = a.k // 2 WHERE a.k > 0),
f AS (SELECT DISTINCT c FROM n WHERE k % 97 = 0), moved AS (SELECT * FROM e WHERE old <> new),
gone AS (SELECT id FROM n WHERE k % 83 <> 0 AND k % 89 = 0), here AS (SELECT id FROM n WHERE k % 89 <> 0),
touched AS (SELECT id FROM n WHERE (k % 83 = 0) <> (k % 89 = 0) OR (k % 97 = 0 AND k % 83 <> 0 AND k % 89 <> 0) UNION SELECT src FROM moved UNION SELECT dst FROM moved),
direct AS (SELECT id FROM touched WHERE id IN (SELECT id FROM gone) OR id IN (SELECT id FROM here) UNION SELECT 'File:f' || c FROM f UNION SELECT id FROM n WHERE k % 89 <> 0 AND c IN (SELECT c FROM f)),
impact AS (SELECT id, 'direct' AS how FROM direct UNION ALL SELECT id, 'expanded' FROM (SELECT src AS id FROM e WHERE new AND dst IN (SELECT id FROM direct) UNION SELECT dst FROM e WHERE new AND src IN (SELECT id FROM direct)) WHERE id NOT IN (SELECT id FROM direct)),
t AS (SELECT k AS finding_id, CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'rejected' END AS old, CASE WHEN k % 3 = 2 OR k % 2 = 1 THEN NULL WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 1 THEN 'regressed' ELSE 'open' END ELSE 'resolved' END AS new FROM n WHERE id IN (SELECT id FROM impact))"""


@query(CHANGE + " SELECT id, how FROM impact")
def change_impact(spark, sf_dir):
    return _change(spark, sf_dir).impact


@query(CHANGE + " SELECT finding_id, old, new FROM t WHERE new IS NOT NULL AND old <> new")
def change_transitions(spark, sf_dir):
    return _change(spark, sf_dir).transitions


@query(CHANGE + """, s AS (SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM impact) AS affected, (SELECT count(*) FROM t WHERE new IS NOT NULL AND old <> new) AS transitions)
SELECT 0 AS seq, 'change.detected' AS type, files || ' files changed, ' || affected || ' nodes affected' AS summary FROM s UNION ALL SELECT 1, 'change.completed', transitions || ' finding transitions' FROM s""")
def change_timeline(spark, sf_dir):
    return _change(spark, sf_dir).timeline
