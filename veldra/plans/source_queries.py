"""File trees made from parts: ignore rules, classification, readers, and differences of versions, next to DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.operators import trees
from veldra.plans.queries import query
from veldra.plans.star import table
from veldra.sources import files

PLACE = "concat('d', p_partkey % 7, '/', CASE p_partkey % 9 WHEN 0 THEN 'web/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'log/' ELSE '' END, 'f', p_partkey, CASE p_partkey % 8 WHEN 0 THEN '.d.ts' WHEN 1 THEN '.min.js' WHEN 2 THEN '.tsx' WHEN 3 THEN '.log' WHEN 4 THEN '.spec.ts' ELSE '.ts' END)"
MODULE = "CASE p_size % 5 WHEN 0 THEN 'express' WHEN 1 THEN 'react' ELSE concat('./m', p_size) END"
TEXT = "concat(repeat(chr(10), CAST(p_size % 3 AS int)), CASE WHEN p_size % 2 = 0 THEN concat('const a = require(\"', {m}, '\")') ELSE concat('import x from \"', {m}, '\"') END, chr(10), 'require(\"late\")')".replace("{m}", MODULE)
ROOT_RULES = "# rules\n\n*.log\n!keep\n/d1/\n!/d1/f8.ts\nf1?.ts\n!f15.ts\n"
INNER_RULES = "log\n!*5.log\ntests/\n!tests/\n**/f2*.tsx\n"
MANIFESTS = {"package.json": '{"dependencies": {"express": "^4"}}', "d2/package.json": '{"dependencies": {"react": "^18"}, "devDependencies": {"vite": "^6", "react": "^17"}}', "d3/package.json": '{"name": "x"}', "d4/package.json": "{"}


def tree(spark, sf_dir) -> DataFrame:
    """(path, size, text), with ignore files, manifests and env files."""
    parts = table(spark, sf_dir, "part").selectExpr(f"{PLACE} AS path", f"{TEXT} AS text")
    fixed = {".gitignore": ROOT_RULES, "d4/.gitignore": INNER_RULES, **MANIFESTS}
    env = table(spark, sf_dir, "supplier").selectExpr("concat('d', s_suppkey % 7, '/s', s_suppkey, '/.env', CASE WHEN s_suppkey % 2 = 0 THEN '.example' ELSE '' END) AS path", "concat('# c\\nexport TOKEN=\"', s_suppkey, ' x\"\\nPORT = ', s_suppkey, ' # p\\n') AS text")
    made = reduce(DataFrame.unionByName, [parts, env, spark.createDataFrame(list(fixed.items()), "path string, text string")])
    return made.select("path", F.length("text").cast("long").alias("size"), "text")


TREE = f"""WITH p AS (SELECT *, {PLACE} AS path, p_partkey % 7 AS d, p_partkey % 9 AS s, p_partkey % 8 AS x, 'f' || p_partkey AS f FROM part),
o AS (SELECT unnest(['.gitignore', 'd4/.gitignore', 'package.json', 'd2/package.json', 'd3/package.json', 'd4/package.json']) AS path UNION ALL SELECT 'd' || s_suppkey % 7 || '/s' || s_suppkey || '/.env' || CASE WHEN s_suppkey % 2 = 0 THEN '.example' ELSE '' END FROM supplier)"""


@query(
    TREE
    + """, k AS (SELECT path FROM p WHERE NOT (x = 3 OR d = 1 OR (regexp_matches(f, '^f1.$') AND x IN (5, 6, 7) AND f <> 'f15') OR (d = 4 AND (s = 2 OR (x = 2 AND f LIKE 'f2%')))))
SELECT path FROM k UNION ALL SELECT path FROM o WHERE path NOT LIKE 'd1/%'"""
)
def tree_kept(spark, sf_dir):
    """Files that no layer of ignore rules leaves out; later rules bring some back, but nothing below an ignored folder."""
    found = tree(spark, sf_dir)
    return files.not_ignored(found, files.ignore_patterns(found)).select("path")


@query(
    TREE
    + """, c AS (SELECT path, CASE WHEN x = 0 THEN 'declaration' WHEN x = 1 THEN 'minified' END AS skip_reason,
 CASE WHEN s = 1 OR x = 4 THEN 'test' WHEN s = 0 OR x = 2 THEN 'client' WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 2 = 1 OR p_size % 2 = 0 THEN 'server' END WHEN p_size % 5 = 1 THEN 'client' WHEN d = 2 THEN 'client' WHEN d IN (3, 4) THEN 'shared' ELSE 'server' END AS kind FROM p),
a AS (SELECT path, CASE WHEN skip_reason IS NULL THEN kind ELSE 'shared' END AS kind, skip_reason FROM c UNION ALL SELECT path, CASE WHEN path LIKE '%package.json' OR path LIKE '%/.env%' THEN 'config' WHEN path LIKE 'd4/%' THEN 'shared' ELSE 'server' END, NULL FROM o)
SELECT path, kind, CASE WHEN skip_reason IS NOT NULL THEN 'skip' WHEN kind IN ('test', 'client') THEN 'record' ELSE 'extract' END AS action, skip_reason FROM a"""
)
def tree_classified(spark, sf_dir):
    """Kinds by path, by what a file imports, or by the nearest manifest; what is skipped, and why."""
    return files.classified(tree(spark, sf_dir)).select("path", "kind", "action", "skip_reason")


@query(TREE + f" SELECT path, (1 + p_size % 3)::INTEGER AS line, {MODULE} AS module, CASE WHEN p_size % 2 = 0 THEN 'cjs' ELSE 'esm' END AS style FROM p WHERE x <> 3 UNION ALL SELECT path, (2 + p_size % 3)::INTEGER, 'late', 'cjs' FROM p WHERE x <> 3")
def tree_imports(spark, sf_dir):
    return files.imports(tree(spark, sf_dir))


@query("""SELECT 'd' || s_suppkey % 7 || '/s' || s_suppkey || '/.env' || CASE WHEN s_suppkey % 2 = 0 THEN '.example' ELSE '' END AS path, line, name, (length(s_suppkey::VARCHAR) + more)::INTEGER AS value_chars, s_suppkey % 2 = 0 AS example
 FROM supplier, (VALUES (2, 'TOKEN', 2), (3, 'PORT', 0)) v(line, name, more)""")
def tree_env_keys(spark, sf_dir):
    return files.env_keys(tree(spark, sf_dir)).select("path", "line", "name", "value_chars", "example")


OLD = "concat('d', p_partkey % 7, '/e', p_partkey % 11, '/f', p_partkey)"


@query(
    f"""WITH p AS (SELECT *, {OLD} AS path, p_partkey % 7 <> 3 AS live FROM part)
SELECT path, 'deleted' AS kind, NULL AS came_from FROM p WHERE live AND (p_partkey % 17 = 0 OR p_partkey % 23 = 0) UNION ALL SELECT path, 'changed', NULL FROM p WHERE live AND p_partkey % 17 <> 0 AND p_partkey % 23 <> 0 AND p_partkey % 13 = 0
UNION ALL SELECT 'moved/f' || p_partkey, 'added', path FROM p WHERE live AND p_partkey % 23 = 0 AND p_partkey % 17 <> 0 UNION ALL SELECT 'new/e/f' || p_partkey, 'added', NULL FROM p WHERE p_partkey % 19 = 0"""
)
def tree_differences(spark, sf_dir):
    """What differs between two versions of a tree, and from where moved files came."""
    p = table(spark, sf_dir, "part").withColumn("live", F.expr("p_partkey % 7 <> 3"))
    old = p.selectExpr(f"{OLD} AS path", "sha1(concat('c', p_partkey)) AS hash")
    kept = p.where("NOT live OR p_partkey % 17 <> 0").selectExpr(f"CASE WHEN live AND p_partkey % 23 = 0 THEN concat('moved/f', p_partkey) ELSE {OLD} END AS path", "sha1(concat(CASE WHEN live AND p_partkey % 13 = 0 AND p_partkey % 23 <> 0 THEN 'n' ELSE 'c' END, p_partkey)) AS hash")
    added = p.where("p_partkey % 19 = 0").selectExpr("concat('new/e/f', p_partkey) AS path", "sha1(concat('a', p_partkey)) AS hash")
    return trees.differing(old, kept.unionByName(added))
