"""Registered queries over the driver tables, each next to the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions import scalars as S
from veldra.operators import delta, joins, traverse
from veldra.operators.store import GraphStore, newest, page, prop
from veldra.plans import star
from veldra.plans.star import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


NODES = """
WITH nodes AS (
  SELECT 'Region:' || r_regionkey AS id, 'Region' AS type, r_regionkey::VARCHAR AS key FROM region
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_nationkey::VARCHAR FROM nation
  UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_custkey::VARCHAR FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_suppkey::VARCHAR FROM supplier
  UNION ALL SELECT 'Order:' || o_orderkey, 'Order', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_partkey::VARCHAR FROM part
)"""
EDGES = """, ends AS (
  SELECT 'CONTAINS' AS type, 'Region:' || n_regionkey AS src, 'Nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'CONTAINS', 'Nation:' || c_nationkey, 'Customer:' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'Nation:' || s_nationkey, 'Supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'CALLS', 'Customer:' || o_custkey, 'Order:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'ACCESSES', 'Order:' || l_orderkey, 'Part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'USES', 'Order:' || l_orderkey, 'Supplier:' || l_suppkey FROM lineitem
), edges AS (SELECT type || '|' || src || '|' || dst AS id, type, src, dst FROM ends)"""


# --- graph store -------------------------------------------------------------------------------------------------------


@query(NODES + EDGES + " SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL")
def graph_stats(spark, sf_dir):
    return star.store(spark, sf_dir).stats()


@query("SELECT 'Customer:' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey::VARCHAR LIKE '1%'")
def find_by_prop(spark, sf_dir):
    return star.store(spark, sf_dir).find("Customer", key_prefix="1", props={"segment": "BUILDING"}).select("id", prop("name").alias("name"))


@query(NODES + " SELECT id, type, key FROM nodes WHERE type IN ('Part', 'Supplier') AND key LIKE '10%'")
def find_by_prefix(spark, sf_dir):
    return star.store(spark, sf_dir).find(["Part", "Supplier"], key_prefix="10").select("id", "type", "key")


@query(NODES + EDGES + " SELECT id, type, src, dst FROM edges WHERE type = 'CONTAINS' AND src = 'Nation:3'")
def edges_by_filter(spark, sf_dir):
    return star.store(spark, sf_dir).find_edges("CONTAINS", src="Nation:3").select("id", "type", "src", "dst")


@query(NODES + EDGES + " SELECT DISTINCT e.src AS start, n.id, n.type FROM edges e JOIN nodes n ON n.id = e.dst JOIN customer c ON e.src = 'Customer:' || c.c_custkey WHERE e.type = 'CALLS' AND c.c_mktsegment = 'MACHINERY'")
def neighbors_out(spark, sf_dir):
    graph = star.store(spark, sf_dir)
    return graph.neighbors(graph.find("Customer", props={"segment": "MACHINERY"}).select("id"), "CALLS").select("start", "id", "type")


@query(NODES + EDGES + " SELECT DISTINCT e.dst AS start, n.id, n.type FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'USES'")
def neighbors_in(spark, sf_dir):
    graph = star.store(spark, sf_dir)
    return graph.neighbors(graph.find("Supplier").select("id"), "USES", "in").select("start", "id", "type")


@query(NODES + EDGES + " SELECT DISTINCT id, type, src, dst FROM edges WHERE src IN (SELECT id FROM nodes) OR dst IN (SELECT id FROM nodes)")
def edges_of_ids(spark, sf_dir):
    graph = star.store(spark, sf_dir)
    return graph.edges_of(graph.nodes).select("id", "type", "src", "dst")


@query(
    NODES
    + EDGES
    + """, gone AS (SELECT 'Supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'Nation:0')
SELECT 'node' AS what, type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY ALL
UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY ALL"""
)
def remove_subtree(spark, sf_dir):
    graph = star.store(spark, sf_dir)
    gone = graph.nodes.where(((F.col("type") == "Supplier") & (prop("balance", "double") < 0)) | (F.col("id") == "Nation:0")).select("id")
    return graph.without(gone).stats()


@query("SELECT id, total, truncated FROM (SELECT 'Order:' || o_orderkey AS id, count(*) OVER () AS total, count(*) OVER () > 150 AS truncated FROM orders WHERE o_orderstatus = 'F') ORDER BY id LIMIT 50 OFFSET 100")
def page_of_nodes(spark, sf_dir):
    found = star.nodes(spark, sf_dir).where((F.col("type") == "Order") & (prop("status") == "F")).select("id")
    return page(found, ["id"], limit=50, offset=100)


@query(NODES + EDGES + """, more AS (SELECT id, type, src, dst FROM edges UNION ALL SELECT 'USES|Order:' || o_orderkey || '|Ghost:' || (o_orderkey % 7), 'USES', 'Order:' || o_orderkey, 'Ghost:' || (o_orderkey % 7) FROM orders WHERE o_orderkey % 500 = 3)
SELECT DISTINCT id, type, src, dst FROM more WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)""")
def dangling_edges(spark, sf_dir):
    graph = star.store(spark, sf_dir)
    odd = table(spark, sf_dir, "orders").where("o_orderkey % 500 = 3").withColumn("ghost", F.col("o_orderkey") % 7)
    bad = star._edges(odd, "USES", ("Order", "o_orderkey"), ("Ghost", "ghost"))
    return GraphStore(graph.nodes, graph.edges.unionByName(bad)).dangling()


@query("""WITH n AS (SELECT 'Customer:' || c_custkey AS id, c_name AS name FROM customer)
SELECT id, CASE WHEN split_part(id, ':', 2)::BIGINT % 10 = 0 THEN 'renamed' ELSE name END AS name FROM n
UNION ALL SELECT 'Customer:new', 'renamed'""")
def upsert_nodes(spark, sf_dir):
    own = star.nodes(spark, sf_dir).where("type = 'Customer'").select("id", "type", "key", prop("name").alias("name"))
    fresh = own.where("CAST(key AS BIGINT) % 10 = 0").withColumn("name", F.lit("renamed"))
    extra = spark.range(1).select(F.lit("Customer:new").alias("id"), F.lit("Customer").alias("type"), F.lit("new").alias("key"), F.lit("renamed").alias("name"))
    return GraphStore(own, own).upsert(nodes=fresh.unionByName(extra)).nodes.select("id", "name")


# --- merges, windows, sets ---------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS rank FROM lineitem),
v AS (SELECT l_orderkey, l_partkey, l_suppkey, min(rank) AS first FROM r GROUP BY ALL),
u AS (SELECT l_orderkey, l_partkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY first) AS via FROM v GROUP BY ALL)
SELECT 'ACCESSES|Order:' || l_orderkey || '|Part:' || l_partkey AS id, arg_min(l_linenumber, rank) AS first_line, count(*) AS calls,
  string_agg(l_quantity::INTEGER::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3) AS ops, any_value(via) AS via,
  bool_or(l_returnflag = 'R') AS returned, bool_and(l_linestatus = 'F') AS finished
FROM r JOIN u USING (l_orderkey, l_partkey) GROUP BY l_orderkey, l_partkey""")
def merged_edge_ops(spark, sf_dir):
    made = star.accesses(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return made.select("id", "first_line", "calls", text("ops"), text("via"), "returned", "finished")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '#' || n END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def nth_occurrence_suffix(spark, sf_dir):
    return joins.numbered_repeats(table(spark, sf_dir, "part"), "p_name", ["p_partkey"], "name").select("p_partkey", "name")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topn_per_group(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(order)).where("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT set_key, size, count(*) AS groups, min(l_orderkey) AS first_group FROM (
  SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS set_key, count(DISTINCT l_returnflag || l_linestatus)::INTEGER AS size FROM lineitem GROUP BY l_orderkey)
GROUP BY ALL""")
def set_equality_join(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("mark"))
    return joins.same_set(rows, "l_orderkey", "mark")


RULES = [("idle", ["view", "error"], []), ("buyer", ["purchase"], ["view", "click"]), ("lead", ["signup", "click"], ["signup"]), ("none", ["missing"], []), ("any", ["view", "click", "error", "purchase", "signup"], ["purchase", "error"])]


@query("""WITH rules(rule, signals, requires) AS (VALUES ('idle', ['view', 'error'], []::VARCHAR[]), ('buyer', ['purchase'], ['view', 'click']), ('lead', ['signup', 'click'], ['signup']),
 ('none', ['missing'], []), ('any', ['view', 'click', 'error', 'purchase', 'signup'], ['purchase', 'error'])),
have AS (SELECT user_id * 1000 + event_id % 97 AS subject, list(DISTINCT event_type) AS have FROM events GROUP BY 1)
SELECT subject, rule, len(list_intersect(signals, have))::BIGINT AS score FROM have, rules
WHERE len(list_intersect(signals, have)) > 0 AND list_has_all(have, requires)""")
def set_containment_match(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule string, signals array<string>, requires array<string>")
    subjects = table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.col("event_id") % 97).alias("subject"), F.col("event_type").alias("signal"))
    return joins.containment_match(rules, subjects)


# --- joins -------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT user_id AS scope, event_id AS point_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'error'),
r AS (SELECT user_id AS scope, event_id AS range_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + (value * 3000)::BIGINT AS b FROM events WHERE event_type = 'view')
SELECT p.scope, point_id, t AS "at", arg_min(range_id, (b - a, range_id)) AS range_id FROM p LEFT JOIN r ON p.scope = r.scope AND t BETWEEN a AND b GROUP BY p.scope, point_id, t""")
def enclosing_interval(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))))
    points = events.where("event_type = 'error'").select(F.col("user_id").alias("scope"), F.col("event_id").alias("point_id"), "at")
    ranges = events.where("event_type = 'view'").select(
        F.col("user_id").alias("scope"), F.col("event_id").alias("range_id"), F.col("at").alias("start"), (F.col("at") + F.round(F.col("value") * 3000).cast("long")).alias("end"), F.col("event_id").alias("pos")
    )
    return joins.enclosing(points, ranges, "scope", width=1024).select("scope", "point_id", "at", "range_id")


@query("SELECT o_custkey, pos, a, b FROM (SELECT o_custkey, unnest(range(len(k)))::INTEGER AS pos, unnest(k) AS a, unnest(s) AS b FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey))")
def positional_zip(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    both = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("r")).select("o_custkey", F.col("r.o_orderkey").alias("a"), F.col("r.o_orderstatus").alias("b"))
    return joins.zipped(both, "a", "b", ["o_custkey"])


SERVICES = [(0, "blue widget", "exact"), (1, "red/", "red-prefix"), (2, "small/", "small-prefix"), (3, "small/ring", "late"), (4, "green/gear/", "deep")]


@query("""WITH t(ord, key, value) AS (VALUES (0, 'blue widget', 'exact'), (1, 'red/', 'red-prefix'), (2, 'small/', 'small-prefix'), (3, 'small/ring', 'late'), (4, 'green/gear/', 'deep')),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '/') || CASE WHEN p_partkey % 2 = 0 THEN '/x' ELSE '' END END AS name FROM part)
SELECT p_partkey, name, (SELECT arg_min(value, ord) FROM t WHERE name = key OR (ends_with(key, '/') AND starts_with(name, key))) AS value FROM p""")
def prefix_service_lookup(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_partkey") % 2 == 0, F.lit("/x")).otherwise(F.lit(""))))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return joins.prefix_lookup(rows, "name", spark.createDataFrame(SERVICES, "ord int, key string, value string"))


USES = "SELECT concat('r', s_suppkey % 20) AS router, concat('u', s_suppkey) AS use_id, CASE s_suppkey % 5 WHEN 0 THEN '/' WHEN 1 THEN concat('/c', s_suppkey % 7) WHEN 2 THEN concat('/c', s_suppkey % 7, '/:id') WHEN 3 THEN '/:any/x1' ELSE concat('/c', s_suppkey % 7, '/x', s_suppkey % 3, '/deep') END AS use_path, CAST(s_suppkey * 50 AS int) AS use_order, s_suppkey % 4 = 0 AS dynamic FROM supplier"
ROUTES = "SELECT concat('r', o_custkey % 20) AS router, concat('o', o_orderkey) AS route_id, CASE o_orderkey % 6 WHEN 0 THEN '/' WHEN 1 THEN concat('/:p/x', o_orderkey % 3) ELSE concat('/c', o_orderkey % 7, '/x', o_orderkey % 3, CASE WHEN o_orderkey % 2 = 0 THEN '/deep' ELSE '' END) END AS route_path, CAST(o_orderkey AS int) AS route_order FROM orders"


@query(f"""WITH u AS ({USES}), r AS ({ROUTES}),
s AS (SELECT *, list_filter(string_split(use_path, '/'), lambda x: x <> '') AS a, list_filter(string_split(route_path, '/'), lambda x: x <> '') AS b FROM u JOIN r USING (router) WHERE use_order < route_order)
SELECT use_id, route_id, dynamic AS conditional FROM s WHERE len(a) <= len(b)
 AND len(list_filter(range(1, len(a) + 1), lambda i: NOT (a[i] = b[i] OR starts_with(a[i], ':') OR starts_with(b[i], ':')))) = 0""")
def segment_match_join(spark, sf_dir):
    """Which earlier uses of a router apply to its routes, by the segments of their paths."""
    uses = spark.sql(USES.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    routes = spark.sql(ROUTES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return joins.prefix_segments(uses, routes, "router")


@query("""WITH k AS (SELECT DISTINCT replace(p_name, ' ', '-') AS key FROM part WHERE p_size > 25 UNION SELECT DISTINCT p_name || '/index' FROM part WHERE p_size < 5),
w AS (SELECT p_partkey, p_name || '.ts' AS tried, 0 AS rank FROM part UNION ALL SELECT p_partkey, p_name || '/index', 1 FROM part UNION ALL SELECT p_partkey, replace(p_name, ' ', '-'), 2 FROM part)
SELECT p_partkey, arg_min(key, rank) AS found FROM w LEFT JOIN k ON tried = key GROUP BY p_partkey""")
def first_candidate_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dashed = F.replace("p_name", F.lit(" "), F.lit("-"))
    known = part.where("p_size > 25").select(dashed.alias("key")).union(part.where("p_size < 5").select(F.concat("p_name", F.lit("/index"))))
    tried = F.array(F.concat("p_name", F.lit(".ts")), F.concat("p_name", F.lit("/index")), dashed)
    return joins.first_candidate(part.select("p_partkey", "p_name"), tried, known, "key").select("p_partkey", "found")


# --- traversal ---------------------------------------------------------------------------------------------------------


@query(NODES + EDGES + """, RECURSIVE_ AS (SELECT 1), l1 AS (SELECT dst AS id, min(id) AS via FROM edges WHERE src = 'Region:1' GROUP BY dst),
l2 AS (SELECT dst AS id, min(e.id) AS via FROM edges e JOIN l1 ON e.src = l1.id GROUP BY dst),
l3 AS (SELECT dst AS id, min(e.id) AS via FROM edges e JOIN l2 ON e.src = l2.id WHERE dst NOT IN (SELECT id FROM l2) GROUP BY dst),
l4 AS (SELECT dst AS id, min(e.id) AS via FROM edges e JOIN l3 ON e.src = l3.id WHERE dst NOT IN (SELECT id FROM l2) AND dst NOT IN (SELECT id FROM l3) GROUP BY dst)
SELECT 'Region:1' AS id, 0 AS depth, NULL AS via UNION ALL SELECT id, 1, via FROM l1 UNION ALL SELECT id, 2, via FROM l2 UNION ALL SELECT id, 3, via FROM l3 UNION ALL SELECT id, 4, via FROM l4""".replace(", RECURSIVE_ AS (SELECT 1)", ""))
def bfs_depths(spark, sf_dir):
    starts = spark.createDataFrame([("Region:1",)], "start string")
    return traverse.bfs_levels(star.edges(spark, sf_dir), starts, 8).select("id", "depth", "via")


@query(NODES + EDGES + """, g AS (SELECT 'Part:' || p_partkey AS goal FROM part),
l1 AS (SELECT dst AS id, min(id) AS via FROM edges WHERE src = 'Nation:2' AND type <> 'USES' GROUP BY dst),
l2 AS (SELECT dst AS id, min(e.id) AS via FROM edges e JOIN l1 ON e.src = l1.id WHERE type <> 'USES' GROUP BY dst),
l3 AS (SELECT dst AS id, min(e.id) AS via FROM edges e JOIN l2 ON e.src = l2.id WHERE type <> 'USES' GROUP BY dst),
p AS (SELECT goal, l3.via AS v3, l2.via AS v2, l1.via AS v1 FROM g JOIN l3 ON l3.id = goal JOIN l2 ON l2.id = split_part(l3.via, '|', 2) JOIN l1 ON l1.id = split_part(l2.via, '|', 2))
SELECT goal, 0 AS step, NULL AS via FROM p UNION ALL SELECT goal, 1, v1 FROM p UNION ALL SELECT goal, 2, v2 FROM p UNION ALL SELECT goal, 3, v3 FROM p""")
def bfs_path(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.lit("Nation:2").alias("start"), S.node_id(F.lit("Part"), "p_partkey").alias("goal"))
    found = traverse.paths(star.edges(spark, sf_dir), pairs, 8, ["CONTAINS", "CALLS", "ACCESSES"])
    return found.select("goal", "step", "via")


@query(NODES + EDGES + """, s AS (SELECT 'Customer:' || c_custkey AS start FROM customer),
l AS (SELECT start, start AS id, 0 AS depth FROM s UNION ALL SELECT start, dst, 1 FROM s JOIN edges ON src = start
 UNION ALL SELECT start, b.dst, 2 FROM s JOIN edges a ON a.src = start JOIN edges b ON b.src = a.dst)
SELECT start, id, min(depth) AS depth FROM l GROUP BY ALL""")
def closure_depth3(spark, sf_dir):
    starts = table(spark, sf_dir, "customer").select(S.node_id(F.lit("Customer"), "c_custkey").alias("start"))
    return traverse.closure(star.edges(spark, sf_dir), starts, 3)


@query("""SELECT DISTINCT 'Part:' || p_partkey AS target, 'Customer:' || o_custkey AS id, 2 AS hops FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey""")
def routes_reaching(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(S.node_id(F.lit("Part"), "p_partkey").alias("target"))
    return traverse.reaching(star.edges(spark, sf_dir), targets, 3, "Customer", "Order")


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
t AS (SELECT 'c' || c_custkey AS start, ['c' || c_custkey] AS path, 'c' || c_custkey AS id, 0 AS depth FROM customer
 UNION ALL SELECT 'c' || c_custkey, [a.src, a.dst], a.dst, 1 FROM customer JOIN e a ON a.src = 'c' || c_custkey
 UNION ALL SELECT 'c' || c_custkey, [a.src, a.dst, b.dst], b.dst, 2 FROM customer JOIN e a ON a.src = 'c' || c_custkey JOIN e b ON b.src = a.dst)
SELECT start, array_to_string(path, '>') AS path, id, 'function' AS kind, depth, false AS cycle, count(*) OVER (PARTITION BY start) > 20 AS truncated FROM t QUALIFY row_number() OVER (PARTITION BY start ORDER BY path) <= 20""")
def call_tree_nodes(spark, sf_dir):
    """The first 20 rows, in pre-order, of the tree below each customer, and whether there are more."""
    t = lambda name, src, dst: table(spark, sf_dir, name).selectExpr(f"{src} AS src", f"{dst} AS dst")
    edges = t("orders", "concat('c', o_custkey)", "concat('o', o_orderkey)").unionByName(t("lineitem", "concat('o', l_orderkey)", "concat('p', l_partkey)"))
    starts = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS start")
    return traverse.call_tree(edges, starts, depth=4, cap=20).withColumn("path", F.array_join("path", ">"))


@query("""SELECT 'Region:' || r_regionkey AS root, id, depth FROM region JOIN (
 SELECT 'Region:' || r_regionkey AS r, 'Region:' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'Region:' || n_regionkey, 'Nation:' || n_nationkey, 1 FROM nation
 UNION ALL SELECT 'Region:' || n_regionkey, 'Customer:' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey
 UNION ALL SELECT 'Region:' || n_regionkey, 'Supplier:' || s_suppkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey) ON r = 'Region:' || r_regionkey""")
def subtree_of_regions(spark, sf_dir):
    parents = star.edges(spark, sf_dir).where("type = 'CONTAINS'").select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    return traverse.subtree(parents, table(spark, sf_dir, "region").select(S.node_id(F.lit("Region"), "r_regionkey").alias("root")))


# --- incremental maintenance -------------------------------------------------------------------------------------------


def _versions(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey", "c_mktsegment")
    new = table(spark, sf_dir, "customer").where("c_custkey % 17 <> 0").select(
        F.col("c_custkey").alias("id"), "c_name", "c_nationkey", F.when(F.col("c_custkey") % 11 == 0, F.lit("MOVED")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    )
    columns = ["id", "c_name", "c_nationkey", "c_mktsegment"]
    return delta.hashed(old, columns), delta.hashed(new, columns)


CHANGE = """CASE WHEN c_custkey % 13 = 0 THEN 'added' WHEN c_custkey % 17 = 0 THEN 'removed' WHEN c_custkey % 11 = 0 AND c_mktsegment <> 'MOVED' THEN 'changed' ELSE 'unchanged' END"""


@query(f"SELECT c_custkey AS id, {CHANGE} AS change FROM customer WHERE NOT (c_custkey % 13 = 0 AND c_custkey % 17 = 0)")
def delta_classify(spark, sf_dir):
    return delta.classified(*_versions(spark, sf_dir))


@query(f"SELECT {CHANGE} AS change, count(*) AS n FROM customer WHERE NOT (c_custkey % 13 = 0 AND c_custkey % 17 = 0) GROUP BY ALL")
def delta_counts(spark, sf_dir):
    return delta.counts(delta.classified(*_versions(spark, sf_dir)))


@query("SELECT c_custkey AS id, c_name, CASE WHEN c_custkey % 11 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 17 <> 0")
def delta_apply(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return delta.applied(old, new, delta.classified(old, new)).select("id", "c_name", "c_mktsegment")


@query("""WITH o AS (SELECT 'CALLS|Customer:' || o_custkey || '|Order:' || o_orderkey AS id, 'Customer:' || o_custkey AS src, 'Order:' || o_orderkey AS dst, o_orderkey AS k FROM orders),
moved AS (SELECT * FROM o WHERE k % 40 = 0 OR k % 40 = 1),
known AS (SELECT 'Customer:' || c_custkey AS id FROM customer WHERE c_custkey % 9 <> 0 UNION SELECT 'Customer:' || c_custkey FROM customer WHERE c_custkey % 9 = 0 UNION SELECT 'Order:' || o_orderkey FROM orders WHERE o_orderkey % 40 <> 0)
SELECT id FROM (SELECT src AS id FROM moved UNION SELECT dst FROM moved UNION SELECT 'Customer:' || c_custkey FROM customer WHERE c_custkey % 9 = 0) WHERE id IN (SELECT id FROM known)""")
def changed_ids(spark, sf_dir):
    all_edges = star._edges(table(spark, sf_dir, "orders"), "CALLS", ("Customer", "o_custkey"), ("Order", "o_orderkey")).withColumn("k", F.split("dst", ":")[1].cast("long"))
    old_e, new_e = delta.hashed(all_edges.where("k % 40 <> 1"), ["id"]), delta.hashed(all_edges.where("k % 40 <> 0"), ["id"])
    people = table(spark, sf_dir, "customer").select(S.node_id(F.lit("Customer"), "c_custkey").alias("id"), "c_custkey")
    old_n = delta.hashed(people, ["id"]).select("id", "hash")
    new_n = delta.hashed(people.where("c_custkey % 9 <> 0"), ["id"]).select("id", "hash")
    orders = new_e.select(F.col("dst").alias("id")).withColumn("hash", F.lit("x"))
    return delta.touched_nodes(delta.classified(old_n, new_n), delta.classified(old_e, new_e), old_e, new_e, new_n.unionByName(orders))


@query("""SELECT path, arg_min(kind, CASE kind WHEN 'deleted' THEN 0 WHEN 'added' THEN 1 ELSE 2 END) AS kind FROM (
 SELECT 'u' || user_id || '/' || (event_id % 50) AS path, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'added' ELSE 'changed' END AS kind FROM events) GROUP BY path""")
def diff_exclusive(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "added").otherwise("changed")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 50).cast("string"))
    return delta.exclusive(table(spark, sf_dir, "events").select(path.alias("path"), kind.alias("kind")))


@query("""WITH d AS (SELECT 'Function:' || o_orderkey AS id FROM orders WHERE o_orderkey % 300 = 0 UNION ALL SELECT 'Model:' || p_partkey FROM part WHERE p_partkey % 200 = 0),
calls AS (SELECT 'Function:c' || o_custkey AS src, 'Function:' || o_orderkey AS dst FROM orders), acc AS (SELECT DISTINCT 'Function:' || l_orderkey AS src, 'Model:' || l_partkey AS dst FROM lineitem),
a AS (SELECT src FROM acc WHERE dst IN (SELECT id FROM d)),
x AS (SELECT src AS id FROM calls WHERE dst IN (SELECT id FROM d) UNION SELECT dst FROM calls WHERE src IN (SELECT id FROM d) UNION SELECT src FROM a UNION SELECT src FROM calls WHERE dst IN (SELECT src FROM a))
SELECT id, 'direct' AS how FROM d UNION ALL SELECT id, 'expanded' FROM x WHERE id NOT IN (SELECT id FROM d)""")
def impact_set(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fn = lambda c: S.node_id(F.lit("Function"), c)
    calls = orders.select(F.lit("CALLS").alias("type"), fn(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("src"), fn("o_orderkey").alias("dst"))
    reads = lines.select(F.lit("ACCESSES").alias("type"), fn("l_orderkey").alias("src"), S.node_id(F.lit("Model"), "l_partkey").alias("dst")).distinct()
    direct = orders.where("o_orderkey % 300 = 0").select(fn("o_orderkey").alias("id")).union(table(spark, sf_dir, "part").where("p_partkey % 200 = 0").select(S.node_id(F.lit("Model"), "p_partkey")))
    return delta.impact(calls.unionByName(reads), direct)


@query("""WITH e AS (SELECT user_id * 100 + event_id % 37 AS finding, ts, event_id, CASE event_type WHEN 'purchase' THEN 'CONFIRMED' WHEN 'error' THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS v FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE v <> 'INCONCLUSIVE'),
s AS (SELECT finding, max(CASE WHEN n = 1 THEN v END) AS last, max(CASE WHEN n = 2 THEN v END) AS before FROM d GROUP BY finding)
SELECT finding, count(*) AS steps, CASE WHEN any_value(last) IS NULL THEN 'open' WHEN any_value(last) = 'REJECTED' THEN 'resolved' WHEN any_value(before) = 'REJECTED' THEN 'regressed' ELSE 'open' END AS status
FROM e LEFT JOIN s USING (finding) GROUP BY finding""")
def finding_transitions(spark, sf_dir):
    verdict = F.when(F.col("event_type") == "purchase", "CONFIRMED").when(F.col("event_type") == "error", "REJECTED").otherwise("INCONCLUSIVE")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 37).alias("finding"), "ts", "event_id", verdict.alias("verdict"))
    return delta.folded_status(rows, "finding", ["ts", "event_id"], "verdict")


# --- roll-ups and scores -----------------------------------------------------------------------------------------------

SEVERITY_SQL = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END"


def _findings(spark, sf_dir):
    p = F.substring("o_orderpriority", 1, 1)
    severity = F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").otherwise("low")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("regressed")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("project"), F.col("o_orderkey").alias("finding"), severity.alias("severity"), status.alias("status"), "o_totalprice")


@query(f"""SELECT o_custkey % 50 AS project, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS regressed,
 count(*) FILTER (o_orderstatus = 'O' AND {SEVERITY_SQL} = 'critical') AS open_critical, count(*) FILTER (o_orderstatus = 'O' AND {SEVERITY_SQL} = 'high') AS open_high,
 count(*) FILTER (o_orderstatus = 'O' AND {SEVERITY_SQL} = 'medium') AS open_medium, count(*) FILTER (o_orderstatus = 'O' AND {SEVERITY_SQL} = 'low') AS open_low FROM orders GROUP BY 1""")
def open_summary(spark, sf_dir):
    is_ = lambda s: F.col("status") == s
    return _findings(spark, sf_dir).groupBy("project").agg(
        *[F.count_if(is_(s)).alias(s) for s in ("open", "resolved", "regressed")],
        *[F.count_if(is_("open") & (F.col("severity") == s)).alias(f"open_{s}") for s in ("critical", "high", "medium", "low")],
    )


@query("""WITH o AS (SELECT *, o_orderkey % 4 = 0 AS open, left(o_orderpriority, 1) AS p FROM orders),
c AS (SELECT o_custkey AS project, count(*) FILTER (open AND p = '1') AS crit, count(*) FILTER (open AND p = '2') AS high, count(*) FILTER (open AND p = '3') AS med,
 count(*) FILTER (o_orderstatus <> 'P') AS prot, count(*) AS total FROM o GROUP BY 1),
s AS (SELECT *, greatest(10, least(100, floor((85 - 20 * crit - 10 * high - 4 * med) * (prot / greatest(total, 1)) + 0.5)))::INTEGER AS score FROM c)
SELECT project, score, CASE WHEN score < 40 OR crit > 0 THEN 'D+' WHEN score < 65 OR high > 1 THEN 'C+' WHEN score < 80 THEN 'B' ELSE 'A' END AS grade FROM s""")
def posture_score(spark, sf_dir):
    """A customer is a project; every fourth order is an open finding, and orders that aren't pending are protected routes."""
    open_, p = F.col("o_orderkey") % 4 == 0, F.substring("o_orderpriority", 1, 1)
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project")).agg(
        *[F.count_if(open_ & (p == k)).alias(name) for k, name in (("1", "crit"), ("2", "high"), ("3", "med"))], F.count_if(F.col("o_orderstatus") != "P").alias("prot"), F.count("*").alias("total")
    )
    scored = counted.withColumn("score", S.posture_score("crit", "high", "med", "prot", "total"))
    return scored.select("project", "score", S.posture_grade("score", "crit", "high").alias("grade"))


@query(f"""WITH f AS (SELECT o_orderkey AS finding, {SEVERITY_SQL} AS base, CASE WHEN o_totalprice > 400000 THEN 1.0 WHEN o_totalprice > 300000 THEN 0.9 WHEN o_totalprice > 200000 THEN 0.6 ELSE 0.0 END AS weight, o_orderstatus <> 'P' AS protected FROM orders)
SELECT finding, ['low', 'medium', 'high', 'critical'][least(4, list_position(['low', 'medium', 'high', 'critical'], base) + (weight >= 0.9)::INTEGER + (NOT protected)::INTEGER)] AS severity FROM f""")
def severity_escalation(spark, sf_dir):
    price = F.col("o_totalprice")
    rows = _findings(spark, sf_dir).withColumn("weight", F.when(price > 400000, 1.0).when(price > 300000, 0.9).when(price > 200000, 0.6).otherwise(0.0))
    return rows.select("finding", S.escalated("severity", "weight", F.col("status") != "regressed").alias("severity"))


@query("""WITH l AS (SELECT project, finding, status, severity, created FROM (SELECT o_custkey % 50 AS project, o_orderkey AS finding, o_orderstatus AS status, o_orderpriority AS severity, o_orderdate AS created, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n <= 200)
SELECT finding, severity || ' in ' || project AS title FROM l""")
def newest_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)
    return rows.select(F.col("o_orderkey").alias("finding"), F.concat("o_orderpriority", F.lit(" in "), (F.col("o_custkey") % 50).cast("string")).alias("title"))


@query("""WITH o AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) AS runs, max(o_orderdate) AS latest FROM orders GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, coalesce(open, 0) AS open, coalesce(runs, 0) AS runs, latest FROM customer LEFT JOIN o ON id = c_custkey""")
def project_cards(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count("*").alias("runs"), F.max("o_orderdate").alias("latest"))
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return cards.join(runs, "id", "left").fillna(0, ["open", "runs"])


# --- text --------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), f AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n, sum(n * log2(n)) AS s FROM f GROUP BY doc_id)
SELECT doc_id, floor((log2(n) - s / n) * 100 + 0.5) / 100 AS entropy FROM t""")
def text_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.entropy("text").alias("entropy"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 2 THEN '***' ELSE left(text, 2) || '***' END AS preview, ceil(length(text) / 4)::BIGINT AS tokens FROM conversations")
def mask_preview(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.mask_preview("text").alias("preview"), S.estimated_tokens("text").alias("tokens"))


# the value isn't consumed, so a harmless pair's value can be the next pair's name
SECRET_PAIR = r"([A-Za-z_][A-Za-z0-9_-]*+)\s*[:=]\s*[\"']?(?=([A-Za-z0-9+/_-]{8,}))"


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(s))) + 1 AS line, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
p AS (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM l WHERE regexp_matches(t, '[:=]')),
m AS (SELECT doc_id, line, i, regexp_extract(left(t, i - 1), '([A-Za-z_][A-Za-z0-9_-]*)\s*$', 1) AS name, regexp_extract(substr(t, i + 1), '^\s*["'']?([A-Za-z0-9+/_-]{8,})', 1) AS value FROM p WHERE substr(t, i, 1) IN (':', '=')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n FROM m WHERE name <> '' AND value <> '')
SELECT doc_id, line::INTEGER AS line, n::INTEGER AS n, name, left(value, 2) || '***' AS preview FROM r
WHERE regexp_matches(lower(name), '(secret|passw(or)?d|pwd|token|api[_-]?key|apikey|private[_-]?key|credential|salt|auth[_-]?key)')""")
def secret_line_scan(spark, sf_dir):
    """All secrets of each line; n is the pair's place among the line's pairs."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    names, values = (F.regexp_extract_all("t", F.lit(SECRET_PAIR), F.lit(g)) for g in (1, 2))
    pairs = lines.select("doc_id", (F.col("pos") + 1).alias("line"), F.posexplode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("n", "pair"))
    found = pairs.select("doc_id", "line", (F.col("n") + 1).alias("n"), "pair.name", "pair.value")
    return found.where(S.is_secret_name("name")).select("doc_id", "line", "n", "name", S.mask_preview("value").alias("preview"))


@query("""WITH x AS (SELECT unnest(['region 3', 'nations', 'NATION_7', 'brand', 'red widgets', 'smal ring']) AS q), n AS (SELECT DISTINCT p_name AS c FROM part UNION SELECT n_name FROM nation),
t AS (SELECT q, c, list_distinct(list_transform(list_filter(string_split_regex(lower(q), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END)) AS a,
 list_transform(list_filter(string_split_regex(lower(c), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END) AS b FROM x, n),
s AS (SELECT q, c, greatest(len(list_filter(b, lambda w: list_contains(a, w))) / greatest(1, len(list_distinct(list_concat(a, b)))) + CASE WHEN contains(lower(c), lower(q)) OR contains(lower(q), lower(c)) THEN 0.5 ELSE 0 END,
 CASE WHEN 1 - levenshtein(lower(q), lower(c)) / greatest(length(q), length(c)) > 0.6 THEN 1 - levenshtein(lower(q), lower(c)) / greatest(length(q), length(c)) ELSE 0 END) AS score FROM t)
SELECT q, c, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, c) AS n FROM s WHERE score > 0) WHERE n <= 5""")
def name_suggest(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in ("region 3", "nations", "NATION_7", "brand", "red widgets", "smal ring")], "q string")
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("c")).union(table(spark, sf_dir, "nation").select("n_name")).distinct()
    scored = names.crossJoin(F.broadcast(asked)).withColumn("score", S.suggestion_score("q", "c")).where("score > 0")  # six inputs
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "c")
    return scored.withColumn("n", F.row_number().over(order)).where("n <= 5").select("q", "c", F.round("score", 6).alias("score"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="[^"]+"') AS h, string_split_regex(html, 'href="[^"]+"') AS g FROM pages), l AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM p),
t AS (SELECT page_id, regexp_extract(h[i], 'href="([^"]+)"', 1) AS link, coalesce(array_to_string(g[1:i], ''), '') || coalesce(array_to_string(h[1:i - 1], ''), '') AS ahead FROM l)
SELECT page_id, link, (1 + length(ahead) - length(replace(ahead, chr(10), '')))::INTEGER AS line FROM t""")
def link_scan(spark, sf_dir):
    """Links with the line on which each begins."""
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(S.matches("html", {"link": 'href="[^"]+"'}, S.breaks)).alias("i"))
    return each.select("page_id", F.regexp_extract("i.hit", 'href="([^"]+)"', 1).alias("link"), (F.col("i.start") + 1).alias("line"))
