"""Records of a code base of any size, generated from the star schema: what the code-graph queries and their SQL run on.

Parts are library functions, orders are routes with a handler each, line items are calls of handlers; the five functions of
each group of five parts call each other in a ring. ``SQL`` says the same tables in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldra.plans.codegraph import SCHEMAS, CodeGraph

#: own rules: (type, signals, requires, applies_to, kind, severity)
BOOKS = [
    ("background", [], [], ["open-data", "open-door"], "reference", "info"),
    ("leak", ["exposes-credential", "exposes-sensitive"], [], [], "rule", "medium"),
    ("open-door", ["authorization:unknown", "authorization:none"], ["user-controlled-id-flows-to-model-read"], [], "rule", "high"),
    ("open-data", ["unprotected-touches-data", "auth-weak"], [], [], "rule", "high"),
    ("whole-body", ["mass-assignment"], [], [], "rule", "high"),
    ("loose-filter", ["query-built-from-input-object"], ["writes-data"], [], "rule", "low"),
    ("back-office", ["privileged-path-without-role-check"], [], [], "rule", "high"),
]

# each table as an expression that Spark and DuckDB both read; {list} stands for the array constructor
TABLES = {
    "files": "SELECT concat('s', s_suppkey, '.js') AS file, 'server' AS kind FROM supplier",
    "functions": """SELECT concat('p', p_partkey) AS fn, concat('s', p_partkey % 10, '.js') AS file, p_name AS name, CASE WHEN p_partkey % 7 = 6 THEN concat('p', p_partkey - 1) END AS parent,
 CAST(p_partkey * 10 AS int) AS line, CAST(p_partkey * 10 + 8 AS int) AS end_line, p_size = 1 AS verifies, p_size IN (2, 3) AS reads_header, p_size = 2 AS sets_user, p_size < 20 AS rejects FROM part
 UNION ALL SELECT concat('h', o_orderkey), 's1.js', 'handler', NULL, 1, 2, o_orderkey % 50 = 0, false, false, false FROM orders""",
    "calls": """SELECT concat('h', l_orderkey) AS fn, CAST(l_linenumber AS int) AS pos, concat('p', l_partkey) AS callee, CASE WHEN l_linenumber % 2 = 1 THEN {list}('req.params.id') ELSE {list}('x') END AS args, CAST(l_linenumber AS int) AS line FROM lineitem
 UNION ALL SELECT concat('p', p_partkey), 0, concat('p', CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END), CASE WHEN p_size % 2 = 0 THEN {list}('req.params.id') ELSE {list}('y') END, CAST(p_partkey * 10 + 1 AS int) FROM part""",
    "routes": """SELECT concat(method, ' ', full_path) AS route, method, full_path, 's1.js' AS file, concat('h', o_orderkey) AS handler, o_orderkey % 17 <> 0 AS mounted, false AS dynamic FROM (
 SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method, concat(CASE WHEN o_orderkey % 11 = 0 THEN '/admin' ELSE '/c' END, o_custkey, '/o', o_orderkey) AS full_path FROM orders) o""",
    "chain": """SELECT route, 0 AS ord, 'cors' AS name, 'cors' AS factory, NULL AS fn, 'app' AS origin, true AS external, false AS conditional FROM routes
 UNION ALL SELECT route, 1, CASE WHEN o_custkey % 2 = 0 THEN 'authenticate' ELSE 'audit' END, NULL, concat('p', o_custkey % 20), 'router', false, o_orderkey % 19 = 0 FROM routes JOIN orders ON handler = concat('h', o_orderkey) WHERE o_orderkey % 3 <> 0""",
    "inputs": "SELECT concat('h', o_orderkey, ':req.params.id') AS input, concat('h', o_orderkey) AS fn, 'params' AS source, 'id' AS path FROM orders WHERE o_orderkey % 2 = 0",
    "ops": """SELECT concat('p', p_partkey) AS fn, 0 AS pos, CASE p_size % 5 WHEN 0 THEN 'find' WHEN 1 THEN 'findByIdAndUpdate' WHEN 2 THEN 'create' WHEN 3 THEN 'findOneAndRemove' ELSE 'findAndModify' END AS op, concat('m', p_partkey % 25) AS model,
 CASE WHEN p_size % 2 = 0 THEN {list}('req.params.id') ELSE {list}('req.body') END AS args, CASE WHEN p_partkey % 9 = 0 THEN {list}('-secret') END AS selects, 'r' AS result, p_size % 4 = 0 AS filters_input, p_partkey % 6 = 0 AS scoped, CAST(p_partkey * 10 + 2 AS int) AS line FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT concat('h', o_orderkey), 0, 'findById', concat('m', o_orderkey % 25), {list}('req.params.id'), NULL, 'x', false, o_orderkey % 20 = 0, 2 FROM orders WHERE o_orderkey % 10 = 0""",
    "models": "SELECT concat('m', n_nationkey) AS model, 's1.js' AS file FROM nation",
    "fields": """SELECT concat('m', n_nationkey) AS model, 0 AS pos, 'email' AS field, false AS hidden FROM nation UNION ALL SELECT concat('m', n_nationkey), 1, 'secret', false FROM nation
 UNION ALL SELECT concat('m', n_nationkey), 2, 'secret.part', false FROM nation UNION ALL SELECT concat('m', n_nationkey), 3, 'password', true FROM nation UNION ALL SELECT concat('m', n_nationkey), 4, 'total', false FROM nation""",
    "responses": "SELECT concat('p', p_partkey) AS fn, {list}('r') AS vars, CAST(p_partkey * 10 + 3 AS int) AS line FROM part WHERE p_partkey % 4 <> 0",
    "jwt_ops": "SELECT concat('p', p_partkey) AS fn, CASE WHEN p_partkey % 2 = 0 THEN 'sign' ELSE 'verify' END AS op, 'env' AS secret_kind, {list}('literal-fallback') AS flags, CAST(NULL AS {string}) AS expires, CAST(p_partkey * 10 + 4 AS int) AS line FROM part WHERE p_size IN (1, 30)",
    "authz": "SELECT concat('p', p_partkey) AS fn, CASE WHEN p_partkey % 16 = 0 THEN 'role-check' ELSE 'ownership-compare' END AS kind, 'e' AS expr, p_partkey % 3 = 0 AS guarded, CAST(p_partkey * 10 + 5 AS int) AS line FROM part WHERE p_partkey % 8 = 0",
    "secrets": """SELECT concat('SECRET_', s_suppkey) AS name, 'env' AS source, 'env-file-secret' AS kind, '.env' AS file, CAST(s_suppkey AS int) AS line, '***' AS preview FROM supplier
 UNION ALL SELECT concat('literal', p_partkey), 'code', 'hardcoded-secret', concat('s', p_partkey % 10, '.js'), CAST(p_partkey * 10 + p_size % 15 AS int), '***' FROM part WHERE p_partkey % 4 = 1""",
    "env_reads": """SELECT concat('SECRET_', p_partkey % 10) AS name, concat('p', p_partkey) AS fn, concat('s', p_partkey % 10, '.js') AS file, p_size > 10 AS has_default FROM part WHERE p_size % 10 = 3
 UNION ALL SELECT concat('SECRET_', s_suppkey), NULL, concat('s', s_suppkey, '.js'), false FROM supplier UNION ALL SELECT 'PORT', NULL, concat('s', s_suppkey, '.js'), true FROM supplier""",
    "deps": "SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS name, '^1.0.0' AS range, p_brand LIKE '%1' AS dev FROM part UNION ALL SELECT '@slack/web', '^2', false FROM region WHERE r_regionkey = 0",
    "imports": "SELECT concat('s', p_partkey % 10, '.js') AS file, concat(lower(replace(p_brand, '#', '-')), '/x') AS module FROM part WHERE p_size > 20",
    "sanitizers": "SELECT concat('p', p_partkey) AS fn, 'req.params.id' AS var FROM part WHERE p_size % 6 = 0",
}
#: the same tables for DuckDB, in an order in which each uses earlier ones
SQL = "WITH " + ",\n".join(f"{name} AS ({text.replace('{list}', 'list_value').replace('{string}', 'VARCHAR')})" for name, text in TABLES.items())


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    known: dict[str, DataFrame] = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "part", "orders", "lineitem")}
    made: dict[str, DataFrame] = {}
    for name, text in TABLES.items():
        used = {n: df for n, df in {**known, **made}.items() if f" {n}" in text}
        body = text.replace("{list}", "array").replace("{string}", "string")
        for n in used:  # names of frames are parameters in Spark's SQL
            body = body.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
        made[name] = spark.sql(body, **{n: df for n, df in used.items() if f"{{{n}}}" in body}).to(spark.createDataFrame([], SCHEMAS[name]).schema)
    made["playbooks"] = spark.createDataFrame(BOOKS, SCHEMAS["playbooks"])
    return made


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph(tables(spark, sf_dir))
