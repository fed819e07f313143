"""Queries over logs, set versions, rule tables and graph sub-views, each next to the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.functions import scalars as S
from veldra.operators import logs
from veldra.plans import star
from veldra.plans.queries import EDGES, NODES, query
from veldra.plans.star import table


@query("""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
 sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM conversations)
SELECT conv_id, turn, role, CASE WHEN total <= 300 OR pos <= 2 THEN text WHEN role = 'user' AND from_end > 1 THEN '[omitted]'
 WHEN role = 'assistant' AND length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS content FROM m""")
def pruned_threads(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = logs.pruned(turns, "conv_id", ["turn", "role", "text"], "role", "text", dropped="user", trimmed="assistant", budget=300, keep=1, longest=60)
    return made.select("conv_id", "turn", "role", "content")


@query("""WITH s AS (SELECT user_id, event_id, count(*) OVER w AS seq, sum(floor(value * 10)::BIGINT) OVER w AS spent FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, seq, spent::BIGINT AS spent, CASE WHEN seq > 12 THEN 'steps' WHEN spent > 3000 THEN 'cost' ELSE 'within' END AS status FROM s""")
def run_budgets(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") * 10).cast("long").alias("cost"))
    made = logs.budgeted(steps, "user_id", ["ts", "event_id"], "cost", max_steps=12, max_cost=3000)
    return made.select("user_id", "event_id", "seq", "spent", "status")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber >= 2)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, bool_or(a.l_suppkey IS NULL OR b.l_suppkey IS NULL) AS differs
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey GROUP BY 1""")
def set_versions_differ(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return logs.sets_differ(lines.where("l_linenumber <= 3"), lines.where("l_linenumber >= 2"), "l_orderkey", "l_suppkey")


@query("""WITH r AS (SELECT 't' || CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS type, ['t' || o_orderkey + 2, CASE WHEN o_orderkey % 30 = 0 THEN 'gone' || o_custkey ELSE 't' || o_orderkey // 2 END] AS applies_to FROM orders)
SELECT type, 'duplicate' AS problem, count(*)::VARCHAR AS detail FROM r GROUP BY type HAVING count(*) > 1 UNION ALL SELECT DISTINCT type, 'unknown reference', detail FROM (SELECT type, unnest(applies_to) AS detail FROM r) WHERE detail NOT IN (SELECT type FROM r)""")
def rule_integrity(spark, sf_dir):
    """Types that occur twice, and references to types that don't exist."""
    rules = table(spark, sf_dir, "orders").selectExpr("concat('t', IF(o_orderkey % 50 = 0, o_orderkey + 1, o_orderkey)) AS type", "array(concat('t', o_orderkey + 2), IF(o_orderkey % 30 = 0, concat('gone', o_custkey), concat('t', o_orderkey div 2))) AS applies_to")
    return logs.rule_problems(rules)


@query(NODES + EDGES + """, own AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3),
ids AS (SELECT 'Customer:' || c_custkey AS id FROM own UNION SELECT 'Order:' || o_orderkey FROM orders WHERE o_custkey IN (FROM own))
SELECT 'both' AS rule, id, type FROM edges WHERE src IN (FROM ids) AND dst IN (FROM ids) UNION ALL SELECT 'either', id, type FROM edges WHERE src IN (FROM ids) OR dst IN (FROM ids)""")
def graph_subview(spark, sf_dir):
    graph = star.store(spark, sf_dir)
    own = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").join(own, "o_custkey", "left_semi")
    ids = own.select(S.node_id(F.lit("Customer"), "o_custkey").alias("id")).union(orders.select(S.node_id(F.lit("Order"), "o_orderkey")))
    view = lambda rule, both: logs.subview(graph, ids, both).edges.select(F.lit(rule).alias("rule"), "id", "type")
    return view("both", True).unionByName(view("either", False))


@query("""WITH f AS (SELECT p_partkey, ['src/userRoutes.js', 'lib/helper.js', 'src/Schema.ts', 'x/GuardModel.js', 'README.md'][p_partkey % 5 + 1] AS file,
 ['Route:GET /a', 'Asset:User.email', 'File:x', 'Middleware:m'][p_partkey % 4 + 1] AS node FROM part),
m AS (SELECT p_partkey, p_partkey % 5 IN (0, 3) OR p_partkey % 4 IN (0, 3) AS auth, p_partkey % 5 IN (2, 3) OR p_partkey % 4 = 1 AS data FROM f)
SELECT p_partkey, CASE WHEN auth = data THEN 'auth,dataflow' WHEN auth THEN 'auth' ELSE 'dataflow' END AS reviews FROM m""")
def relevant_reviews(spark, sf_dir):
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names)).cast("int"))
    file = pick(["src/userRoutes.js", "lib/helper.js", "src/Schema.ts", "x/GuardModel.js", "README.md"])
    node = pick(["Route:GET /a", "Asset:User.email", "File:x", "Middleware:m"])
    reviews = logs.relevant_reviews(F.array(file), F.array(node))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(reviews, ",").alias("reviews"))
