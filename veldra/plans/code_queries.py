"""Fact queries over the generated code base's graph, next to the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.operators import traverse
from veldra.operators.store import findings_page
from veldra.plans import sample_app
from veldra.plans.queries import query

GRAPH = """, edge AS (SELECT DISTINCT fn, callee FROM calls),
reach AS (SELECT route, handler AS fn, 0 AS depth FROM routes UNION SELECT route, a.callee, 1 FROM routes JOIN edge a ON a.fn = handler
 UNION SELECT route, b.callee, 2 FROM routes JOIN edge a ON a.fn = handler JOIN edge b ON b.fn = a.callee
 UNION SELECT route, c.callee, 3 FROM routes JOIN edge a ON a.fn = handler JOIN edge b ON b.fn = a.callee JOIN edge c ON c.fn = b.callee),
closed AS (SELECT route, fn, min(depth) AS depth FROM reach GROUP BY ALL),
inner_fn AS (SELECT DISTINCT fn AS root, fn FROM chain WHERE fn IS NOT NULL UNION SELECT c.fn, f.fn FROM (SELECT DISTINCT fn FROM chain WHERE fn IS NOT NULL) c JOIN functions f ON f.parent = c.fn),
folded AS (SELECT root, bool_or(verifies) OR (bool_or(reads_header) AND bool_or(sets_user)) AS by_trait, bool_or(rejects) AS rejects, bool_or(i.fn IN (SELECT fn FROM authz WHERE kind = 'role-check')) AS role_check
 FROM inner_fn i JOIN functions f ON f.fn = i.fn GROUP BY root),
mw AS (SELECT route, ord, name, chain.fn, conditional, NOT external AND (by_trait OR name = 'authenticate') AS auth, coalesce(role_check, false) AS role, rejects FROM chain LEFT JOIN folded ON root = chain.fn),
asset AS (SELECT model, field, model || '.' || field AS asset, CASE field WHEN 'email' THEN 'pii' ELSE 'credential' END AS tier, hidden FROM fields WHERE field IN ('email', 'secret', 'password')),
shown AS (SELECT o.fn, asset, o.model, tier, min(r.line) AS line FROM ops o JOIN responses r ON r.fn = o.fn AND list_contains(vars, result) JOIN asset USING (model)
 WHERE op IN ('find', 'findById', 'findByIdAndUpdate', 'create', 'findOneAndRemove', 'findAndModify') AND NOT hidden AND NOT coalesce(list_contains(selects, '-' || field), false) GROUP BY ALL),
auth AS (SELECT route, bool_or(auth) AS protected, bool_or(auth AND rejects) AS enforced FROM mw WHERE NOT conditional GROUP BY route),
data AS (SELECT route, list_sort(list(DISTINCT model)) AS models, bool_or(op IN ('findByIdAndUpdate', 'create', 'findOneAndRemove', 'findAndModify')) AS writes,
 bool_or(op IN ('findByIdAndUpdate', 'create', 'findAndModify') AND list_contains(args, 'req.body')) AS mass, bool_or(op <> 'create' AND filters_input) AS loose FROM closed JOIN ops USING (fn) GROUP BY route),
sens AS (SELECT route, list_sort(list(DISTINCT asset)) AS exposed, bool_or(tier = 'credential') AS credential FROM closed JOIN shown USING (fn) GROUP BY route),
ids AS (SELECT DISTINCT route FROM routes JOIN inputs ON fn = handler JOIN ops ON ops.fn = handler WHERE list_contains(args, 'req.params.id')),
evidence AS (SELECT route, fn FROM closed WHERE depth <= 2 UNION SELECT route, i.fn FROM mw JOIN inner_fn i ON root = mw.fn WHERE NOT conditional),
checks AS (SELECT route, bool_or(kind = 'user-scoped-query' OR guarded) AS blocking, bool_or(kind = 'role-check') AS role_check FROM evidence JOIN
 (SELECT fn, kind, guarded FROM authz UNION ALL SELECT fn, 'user-scoped-query', NULL FROM ops WHERE scoped) USING (fn) GROUP BY route),
own AS (SELECT route, bool_or(verifies OR (reads_header AND sets_user)) AS self_auth FROM closed JOIN functions USING (fn) WHERE depth <= 2 GROUP BY route),
facts AS (SELECT r.route, method, full_path, mounted, coalesce(protected, false) AS protected, CASE WHEN NOT coalesce(protected, false) THEN 'none' WHEN enforced THEN 'enforcing' ELSE 'weak' END AS enforcement,
 CASE WHEN NOT coalesce(protected, false) THEN CASE WHEN self_auth THEN 'unknown' ELSE 'none' END WHEN NOT coalesce(enforced, false) THEN 'unknown' WHEN blocking THEN 'present' ELSE 'unknown' END AS "authorization",
 coalesce(models, []) AS models, coalesce(exposed, []) AS exposed, coalesce(credential, false) AS credential, coalesce(writes, false) AS writes, coalesce(mass, false) AS mass, coalesce(loose, false) AS loose, r.route IN (SELECT route FROM ids) AS by_id, coalesce(role_check, false) AS role_check,
 coalesce(writes, false) OR method <> 'GET' AS mutates
 FROM routes r LEFT JOIN auth USING (route) LEFT JOIN data USING (route) LEFT JOIN sens USING (route) LEFT JOIN checks USING (route) LEFT JOIN own USING (route)),
reasons AS (SELECT route, array_to_string(list_filter([CASE WHEN by_id THEN 'idParamReachesDb' END, CASE WHEN writes THEN 'mutatesData' END, CASE WHEN len(exposed) > 0 THEN 'exposesSensitive' END, CASE WHEN mass THEN 'massAssignment' END], lambda x: x IS NOT NULL), ',') AS reasons FROM facts)"""
FACTS = sample_app.SQL + GRAPH
# a library function is reached from all routes whose handler calls one of its ring of five
RING = """, ring AS (SELECT DISTINCT route, substr(callee, 2)::BIGINT // 5 AS g FROM routes JOIN edge ON fn = handler WHERE mounted)"""


def joined(column: str):
    return F.array_join(column, ",").alias(column)


@query(FACTS + " SELECT route FROM facts WHERE mounted AND NOT protected")
def code_unprotected_routes(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).unprotected().select("route")


@query(FACTS + """ SELECT route, "authorization", reasons FROM facts JOIN reasons USING (route) WHERE mounted AND protected AND "authorization" <> 'present' AND reasons <> ''""")
def code_authorization_gaps(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).gaps().select("route", "authorization", joined("reasons"))


@query(FACTS + """ SELECT route, "authorization" FROM facts WHERE mounted""")
def code_route_authorization(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).routes().select("route", "authorization")


@query(FACTS + """ SELECT route, method, full_path, mounted, protected, enforcement, "authorization", array_to_string(models, ',') AS models, array_to_string(exposed, ',') AS exposes_sensitive, writes, mutates, mass AS mass_assignment, loose AS filter_from_input, by_id AS exposes_id, reasons FROM facts JOIN reasons USING (route)""")
def code_route(spark, sf_dir):
    """The whole fact of each route, unmounted ones included."""
    found = sample_app.graph(spark, sf_dir).route_facts
    plain = ["route", "method", "full_path", "mounted", "protected", "enforcement", "authorization", "writes", "mutates", "mass_assignment", "filter_from_input", "exposes_id"]
    return found.select(*plain, joined("models"), joined("exposes_sensitive"), joined("reasons"))


@query(FACTS + """ SELECT route, total, truncated FROM (SELECT route, count(*) OVER () AS total, count(*) OVER () > 100 AS truncated FROM facts WHERE mounted AND NOT protected AND method = 'POST' AND starts_with(full_path, '/c1') AND "authorization" = 'none' AND list_contains(models, 'm3') AND len(exposed) > 0 AND mutates) ORDER BY route LIMIT 100""")
def code_routes_filtered(spark, sf_dir):
    """A page of the routes for which all filters hold."""
    return sample_app.graph(spark, sf_dir).routes_page(protected=False, method="post", path_prefix="/c1", authorization="none", model="m3", exposes_sensitive=True, mutates=True).select("route", "total", "truncated")


@query(FACTS + " SELECT route, ord, name, CASE WHEN auth THEN 'auth' WHEN role THEN 'role' ELSE 'other' END AS kind, coalesce(auth AND rejects, false) AS enforcing FROM mw")
def code_middleware_chain(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).middleware.select("route", "ord", "name", "kind", "enforcing")


@query(FACTS + """, t AS (SELECT unnest(models) AS model, count(*) AS n FROM facts WHERE mounted GROUP BY 1), e AS (SELECT unnest(exposed) AS asset, count(*) AS n FROM facts WHERE mounted GROUP BY 1)
SELECT asset, tier, CASE tier WHEN 'pii' THEN 0.6 ELSE 1.0 END::DOUBLE AS weight, coalesce(t.n, 0)::INTEGER AS touched_by, coalesce(e.n, 0)::INTEGER AS exposed_by FROM asset LEFT JOIN t USING (model) LEFT JOIN e USING (asset)""")
def code_sensitive_assets(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).sensitive_assets(counted=True)


@query(FACTS + " SELECT fn, asset, model, tier, line FROM shown")
def code_exposure(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).exposures()


@query(FACTS + " SELECT DISTINCT route, fn, asset FROM closed JOIN shown USING (fn)")
def code_exposure_of_routes(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).exposures(by_route=True).select("route", "fn", "asset")


@query(FACTS + RING + """, used AS (SELECT DISTINCT j.fn, ring.route FROM jwt_ops j JOIN ring ON g = substr(j.fn, 2)::BIGINT // 5
 UNION SELECT i.fn, mw.route FROM mw JOIN inner_fn i ON root = mw.fn JOIN routes USING (route) WHERE NOT conditional AND mounted)
SELECT j.fn, op, secret_kind, array_to_string(flags, ',') AS flags, count(route)::INTEGER AS routes FROM jwt_ops j LEFT JOIN used ON used.fn = j.fn GROUP BY ALL""")
def code_jwt_usage(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).jwt_usage().select("fn", "op", "secret_kind", joined("flags"), F.size("routes").alias("routes"))


@query(FACTS + """, by_name AS (SELECT name, coalesce('Function:' || fn, 'File:' || file) AS node, has_default FROM env_reads WHERE name LIKE 'SECRET%'
 UNION ALL SELECT s.name, coalesce('Function:' || f.fn, 'File:' || s.file), false FROM secrets s LEFT JOIN (SELECT * FROM functions WHERE fn LIKE 'p%') f ON f.file = s.file AND s.line BETWEEN f.line AND f.end_line WHERE source = 'code')
SELECT name, coalesce(any_value(s.source), 'env') AS source, string_agg(DISTINCT node, ',' ORDER BY node) AS used_by, bool_or(has_default) AS has_default FROM secrets s FULL JOIN by_name USING (name) GROUP BY name""")
def code_secrets(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).secret_facts().select("name", "source", joined("used_by"), "has_default")


@query(sample_app.SQL + """, u AS (SELECT split_part(module, '/', 1) AS name, string_agg(DISTINCT file, ',' ORDER BY file) AS used_by FROM imports GROUP BY 1)
SELECT name, any_value(range) AS range, bool_and(dev) AS dev, coalesce(any_value(used_by), '') AS used_by, CASE WHEN name LIKE '@slack/%' THEN 'Slack' END AS service FROM deps LEFT JOIN u USING (name) GROUP BY name""")
def code_dependencies(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).dependency().select("name", "range", "dev", F.coalesce(F.array_join("used_by", ","), F.lit("")).alias("used_by"), "service")


@query(sample_app.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, passed AS (SELECT DISTINCT fn, callee FROM calls WHERE list_contains(args, 'req.params.id')),
way AS (SELECT input, fn, [fn] AS path, fn IN (SELECT fn FROM sanitizers) AS clean FROM inputs
 UNION ALL SELECT input, callee, list_append(path, callee), clean OR callee IN (SELECT fn FROM sanitizers) FROM way JOIN passed USING (fn) WHERE NOT list_contains(path, callee) AND len(path) <= 10)
SELECT input, (len(path) - 1)::INTEGER AS step, model || '.' || op AS sink, clean AS sanitized, count(*) AS ways FROM way JOIN ops USING (fn) WHERE list_contains(args, 'req.params.id') GROUP BY ALL""")
def code_dataflow(spark, sf_dir):
    flows = sample_app.graph(spark, sf_dir).dataflow()
    return flows.groupBy("input", "step", "sink", "sanitized").agg(F.count("*").alias("ways"))


@query(FACTS + RING + """, n AS (SELECT g, count(*) AS routes FROM ring GROUP BY g), o AS (SELECT * FROM ops)
SELECT model, fn, op, line, coalesce(routes, 0)::INTEGER AS routes FROM o LEFT JOIN n ON g = substr(fn, 2)::BIGINT // 5 WHERE fn LIKE 'p%'
UNION ALL SELECT model, fn, op, line, mounted::INTEGER FROM o JOIN routes ON handler = fn""")
def code_model_access(spark, sf_dir):
    found = sample_app.graph(spark, sf_dir).model_access()
    return found.select("model", "fn", "op", "line", F.coalesce(F.size("routes"), F.lit(0)).alias("routes"))


@query(FACTS + """, f AS (SELECT * FROM facts WHERE mounted), hit AS (SELECT route AS subject, 'leak' AS type FROM f WHERE credential OR len(exposed) > 0
 UNION ALL SELECT route, 'open-door' FROM f WHERE by_id AND "authorization" <> 'present' UNION ALL SELECT route, 'open-data' FROM f WHERE (NOT protected AND len(models) > 0) OR enforcement = 'weak'
 UNION ALL SELECT route, 'whole-body' FROM f WHERE mass UNION ALL SELECT route, 'loose-filter' FROM f WHERE loose AND writes
 UNION ALL SELECT f.route, 'back-office' FROM f WHERE regexp_matches(full_path, '(^|/)(admin|administrator|staff|manager|internal|superuser|root|backoffice)(/|$)') AND NOT role_check AND f.route NOT IN (SELECT route FROM mw WHERE role AND NOT conditional))
SELECT subject, type FROM hit UNION ALL SELECT DISTINCT subject, 'background' FROM hit WHERE type IN ('open-data', 'open-door')""")
def code_playbooks(spark, sf_dir):
    return sample_app.graph(spark, sf_dir).matched_playbooks().select("subject", "type")


@query(FACTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, step AS (SELECT DISTINCT 'Function:' || fn AS src, 'Function:' || callee AS dst FROM calls UNION SELECT 'File:' || file, 'Function:' || fn FROM functions UNION SELECT 'Function:' || fn, 'Asset:' || asset FROM shown
 UNION SELECT 'Function:' || fn, 'Model:' || model FROM ops UNION SELECT 'Model:' || model, 'Asset:' || asset FROM asset),
walk AS (SELECT 'File:s2.js' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN step ON src = id WHERE depth < 8)
SELECT id AS goal, min(depth)::INTEGER AS depth FROM walk WHERE id LIKE 'Asset:%' GROUP BY id""")
def code_attack_path(spark, sf_dir):
    """How many steps the shortest path from one file to each asset has."""
    store = sample_app.graph(spark, sf_dir).store()
    pairs = store.nodes.where("type = 'Asset'").select(F.lit("File:s2.js").alias("start"), F.col("id").alias("goal"))
    return traverse.paths(store.edges, pairs, 8).where("step = 0").select("goal", "depth")


@query(sample_app.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT DISTINCT fn, callee FROM calls), t AS (SELECT fn AS start, [fn] AS path, fn AS id, 0 AS depth, false AS cycle FROM functions
 UNION ALL SELECT start, list_append(path, callee), callee, depth + 1, list_contains(path, callee) FROM t JOIN e ON fn = id WHERE NOT cycle AND depth < 6)
SELECT start, array_to_string(path, '>') AS path, 'function' AS kind, depth, cycle, false AS truncated FROM t
UNION ALL SELECT start, array_to_string(path, '>') || '>' || model, 'model', depth + 1, false, false FROM t JOIN (SELECT DISTINCT fn, model FROM ops) o ON o.fn = id WHERE NOT cycle AND depth < 6""")
def code_call_graph(spark, sf_dir):
    """The call tree below each function, handlers included, with the models that it comes to."""
    graph = sample_app.graph(spark, sf_dir)
    found = graph.call_graph(graph.t["functions"].select(F.col("fn").alias("start")), depth=6)
    return found.select("start", F.array_join("path", ">").alias("path"), "kind", "depth", "cycle", "truncated")


@query(sample_app.SQL + """, up AS (SELECT DISTINCT callee, fn FROM calls)
SELECT handler AS start, handler || '>' || route AS path, 'route' AS kind FROM routes UNION ALL SELECT DISTINCT fn, fn || '>' || name, 'middleware' FROM chain WHERE fn IS NOT NULL
UNION ALL SELECT callee, callee || '>' || fn || '>' || route, 'route' FROM up JOIN routes ON handler = fn UNION ALL SELECT DISTINCT callee, callee || '>' || up.fn || '>' || name, 'middleware' FROM up JOIN chain USING (fn) WHERE callee <> up.fn""")
def code_entry_points(spark, sf_dir):
    """The routes and middleware from which each function is run, at most one call away."""
    graph = sample_app.graph(spark, sf_dir)
    found = graph.call_graph(graph.t["functions"].select(F.col("fn").alias("start")), depth=2, direction="in", cap=None).where("kind <> 'function'")
    return found.select("start", F.array_join("path", ">").alias("path"), "kind")


@query(sample_app.SQL + """, e AS (SELECT DISTINCT callee AS id, fn AS next FROM calls), m AS (SELECT 'm' || n_nationkey AS id FROM nation), a AS (SELECT DISTINCT fn FROM ops WHERE fn LIKE 'h%')
SELECT fn AS start, next AS caller, CASE WHEN next LIKE 'h%' THEN 1 ELSE 0 END AS handler FROM functions JOIN e ON id = fn WHERE fn LIKE 'p%'""")
def code_callers(spark, sf_dir):
    """The functions one call above each library function."""
    graph = sample_app.graph(spark, sf_dir)
    starts = graph.t["functions"].where("fn LIKE 'p%'").select(F.col("fn").alias("start"))
    up = graph.call_graph(starts, depth=1, direction="in", cap=None).where("depth = 1 AND kind = 'function'")
    return up.select("start", F.element_at("path", -1).alias("caller"), F.element_at("path", -1).startswith("h").cast("int").alias("handler"))


@query(FACTS + """, n AS (SELECT 'File' AS type, count(*) AS n FROM files UNION ALL SELECT 'Function', count(*) FROM functions UNION ALL SELECT 'Model', count(*) FROM models UNION ALL SELECT 'Asset', count(*) FROM asset UNION ALL SELECT 'Route', count(*) FROM routes
 UNION ALL SELECT 'Input', count(*) FROM inputs UNION ALL SELECT 'Middleware', count(DISTINCT coalesce(fn, 'ext:' || name)) FROM chain UNION ALL SELECT 'Secret', count(DISTINCT name) FROM secrets UNION ALL SELECT 'Dependency', count(DISTINCT name) FROM deps)
SELECT type, n, 0::BIGINT AS dangling FROM n""")
def code_graph_is_whole(spark, sf_dir):
    """Nodes by type, and edges that lack an end: none."""
    store = sample_app.graph(spark, sf_dir).store()
    return store.nodes.groupBy("type").agg(F.count("*").alias("n")).join(F.broadcast(store.dangling().agg(F.count("*").alias("dangling"))))  # one row


@query("""WITH f AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'idor' WHEN 1 THEN 'leak' ELSE 'open-data' END AS type, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'regressed' END AS status,
 CASE WHEN o_orderkey % 5 = 0 THEN 'CONFIRMED' WHEN o_orderkey % 5 = 1 THEN 'REJECTED' END AS result, 'Route:/o' || o_orderkey AS node, o_orderdate AS created FROM orders)
SELECT id, type, status, result, type || ' on ' || node AS title FROM (SELECT *, row_number() OVER (ORDER BY created DESC, id) AS n FROM f WHERE status = 'open' AND type = 'idor' AND result = 'CONFIRMED') WHERE n <= 200""")
def code_findings(spark, sf_dir):
    """The 200 newest findings for which all filters hold."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    found = o.select(
        key.alias("id"),
        F.when(key % 3 == 0, "idor").when(key % 3 == 1, "leak").otherwise("open-data").alias("type"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("regressed").alias("status"),
        F.when(key % 5 == 0, "CONFIRMED").when(key % 5 == 1, "REJECTED").alias("result"),
        F.array(F.concat(F.lit("Route:/o"), key.cast("string"))).alias("affected_nodes"),
        F.col("o_orderdate").alias("created"),
    )
    return findings_page(found, status="open", type="idor", result="CONFIRMED").select("id", "type", "status", "result", "title")
