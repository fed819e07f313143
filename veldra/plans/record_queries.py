"""Queries over index records, rule documents, runs and names, each next to the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.functions import scalars as S
from veldra.operators import records, runs
from veldra.plans.queries import query
from veldra.plans.star import table

STALE = 72_000  # seconds; events of a user lie hours apart


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# --- runs --------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_id % 3 AS run, event_type IN ('purchase', 'error') AS rel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, NULL::BIGINT AS holder, 0::BIGINT AS since FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN rel THEN CASE WHEN holder = run THEN 'released' ELSE 'ignored' END WHEN holder IS NULL OR since <= t - {STALE}000000 THEN 'acquired' ELSE 'refused' END,
 CASE WHEN rel THEN CASE WHEN holder = run THEN NULL ELSE holder END WHEN holder IS NULL OR since <= t - {STALE}000000 THEN run ELSE holder END,
 CASE WHEN NOT rel AND (holder IS NULL OR since <= t - {STALE}000000) THEN t ELSE since END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, outcome, holder FROM s WHERE n > 0""")
def run_locks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 3).alias("run"), F.col("event_type").isin("purchase", "error").alias("release"))
    return runs.locked(events, "user_id", ["ts", "event_id"], "ts", "run", "release", STALE).select("user_id", "event_id", "outcome", "holder")


REQUESTS = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'proposed' ELSE 'verification-requested' END AS status, CASE o_custkey % 2 WHEN 0 THEN 'idor' ELSE 'open' END AS template,
 ['route', 'jwt', 'secret', 'chain'][o_custkey % 4 + 1] AS kind, CASE o_custkey % 4 WHEN 0 THEN 'route:GET /c' || o_custkey WHEN 1 THEN 'jwt:f' || o_custkey || ':' WHEN 2 THEN 'secret:S' || o_custkey ELSE 'chain:f1,f' || o_custkey END AS subject, o_custkey FROM orders),
d AS (SELECT template || '::' || kind || '::' || subject AS key, min(id) AS id, any_value(o_custkey) AS c, any_value(template) AS type FROM r WHERE status = 'verification-requested' GROUP BY 1)"""


def _requests(spark, sf_dir):
    c = F.col("o_custkey")
    kind = _pick(["route", "jwt", "secret", "chain"], c % 4)
    name = lambda p: F.concat(F.lit(p), c.cast("string"))
    subject = runs.subject_key(kind, name("GET /c"), name("f"), F.lit(None).cast("int"), name("S"), F.array(name("f"), F.lit("f1")))
    template = F.when(c % 2 == 0, F.lit("idor")).otherwise(F.lit("open"))
    status = F.when(F.col("o_orderkey") % 5 == 0, F.lit("proposed")).otherwise(F.lit("verification-requested"))
    nodes = F.array(name("Route:"), F.lit("Model:m"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), template.alias("template"), kind.alias("kind"), subject.alias("subject"), template.alias("type"), nodes.alias("nodes"))


@query("WITH " + REQUESTS + """, k AS (SELECT c_custkey AS c, 'f' || c_custkey AS finding, CASE c_custkey % 2 WHEN 0 THEN 'idor' ELSE 'open' END AS type FROM customer WHERE c_custkey % 3 <> 0)
SELECT key, id, CASE id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REFUTED' ELSE 'INCONCLUSIVE' END AS result, CASE WHEN id % 3 = 0 THEN coalesce(finding, 'new') END AS finding FROM d LEFT JOIN k USING (c, type)""")
def check_requests_drained(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    results = requests.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.lit("CONFIRMED")).otherwise(F.lit("REFUTED")).alias("result"))
    key = F.col("c_custkey").cast("string")
    kind = F.when(F.col("c_custkey") % 2 == 0, F.lit("idor")).otherwise(F.lit("open"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("f"), key).alias("finding"), kind.alias("type"), F.array(F.lit("Model:m"), F.concat(F.lit("Route:"), key)).alias("nodes"))
    return runs.drained(requests, ["id"], results, known, enabled=True, configured=True).select("key", "id", "result", "finding")


@query("WITH " + REQUESTS + " SELECT key, id, 'INCONCLUSIVE' AS result, 'no target configured' AS reason FROM d")
def check_requests_without_target(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    none = requests.select("id", F.lit("CONFIRMED").alias("result")), requests.select(F.lit("f").alias("finding"), "type", "nodes")
    return runs.drained(requests, ["id"], *none, enabled=True, configured=False).select("key", "id", "result", "reason")


@query("""SELECT o_orderkey AS finding, CASE WHEN o_custkey % 2 = 0 AND c_custkey IS NOT NULL AND c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'type' || o_orderkey % 4 END AS template,
 CASE WHEN o_custkey % 2 = 0 AND c_custkey IS NOT NULL THEN c_name ELSE 'agent' || o_orderkey % 7 END AS hypothesis, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'GET /o' || o_orderkey END AS route FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def checks_made_again(spark, sf_dir):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key = F.col("o_orderkey")
    nodes = F.when(key % 3 == 0, F.array(F.lit("Model:m"))).otherwise(F.array(F.lit("Model:m"), text("Route:GET /o", key), F.lit("Route:later")))
    findings = table(spark, sf_dir, "orders").select(key.alias("finding"), text("type", key % 4).alias("type"), text("agent", key % 7).alias("agent_run"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("run"), nodes.alias("nodes"))
    earlier = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("template"), F.col("c_name").alias("hypothesis"))
    return runs.reverified(findings, earlier)


@query("""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS low FROM part), a AS (SELECT DISTINCT upper(p_name) AS asked FROM part UNION SELECT c_name FROM customer UNION SELECT ' ' || p_name || 'x' FROM part),
m AS (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY id) AS nr, count(*) OVER (PARTITION BY asked) AS n FROM a JOIN n ON low = lower(trim(asked)))
SELECT asked, CASE WHEN max(n) = 1 THEN 'found' WHEN max(n) > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, CASE WHEN max(n) = 1 THEN min(id) END AS id, CASE WHEN max(n) > 1 THEN string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (nr <= 10) END AS candidates
FROM a LEFT JOIN m USING (asked) GROUP BY asked""")
def names_resolved(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    asked = parts.select(F.upper("p_name").alias("asked")).union(table(spark, sf_dir, "customer").select("c_name")).union(parts.select(F.concat(F.lit(" "), "p_name", F.lit("x"))))
    made = runs.resolved(asked, parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return made.select("asked", "status", "id", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


@query("""WITH p AS (SELECT c_custkey::VARCHAR AS project, c_mktsegment || c_custkey % 7 AS name, c_custkey % 4 = 0 AS indexed, c_acctbal::BIGINT AS seen FROM customer),
a AS (SELECT DISTINCT o_custkey::VARCHAR AS asked FROM orders UNION SELECT name FROM p UNION SELECT '' UNION SELECT NULL UNION SELECT n_name FROM nation)
SELECT asked, coalesce((SELECT project FROM p WHERE project = asked), (SELECT min(project) FROM p WHERE name = asked), (SELECT project FROM p WHERE indexed ORDER BY seen DESC, project LIMIT 1), asked) AS project FROM a""")
def projects_named(spark, sf_dir):
    name = F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string"))
    status = F.when(F.col("c_custkey") % 4 == 0, F.lit("indexed")).otherwise(F.lit("pending"))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("project"), name.alias("name"), status.alias("status"), F.timestamp_seconds(F.round("c_acctbal").cast("long")).alias("indexed_at"))
    odd = spark.createDataFrame([("",), (None,)], "asked string")
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("asked")).union(projects.select("name")).union(odd).union(table(spark, sf_dir, "nation").select("n_name"))
    return runs.projects_named(asked, projects)


# --- records -----------------------------------------------------------------------------------------------------------

WALKED = """w AS (SELECT p_partkey % 20 AS project, 'src/f' || p_partkey || '.js' AS path, p_brand AS hash, CASE WHEN p_size > 25 THEN 'server' ELSE 'client' END AS kind, CASE WHEN p_size = 1 THEN 'skip' ELSE 'extract' END AS action, * FROM part),
p AS (SELECT project, path, CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE hash END AS hash0, CASE WHEN p_partkey % 11 = 0 THEN 'shared' ELSE kind END AS kind0, CASE WHEN p_partkey % 13 = 0 THEN 2 ELSE 3 END AS version FROM w WHERE p_partkey % 5 <> 0),
f AS (SELECT w.*, coalesce(hash = hash0 AND kind = kind0 AND version = 3 AND action <> 'skip', false) AS reused FROM w LEFT JOIN p USING (project, path))"""


def _walked(spark, sf_dir):
    key = F.col("p_partkey")
    walked = table(spark, sf_dir, "part").select(
        (key % 20).alias("project"), F.concat(F.lit("src/f"), key.cast("string"), F.lit(".js")).alias("path"), F.col("p_brand").alias("hash"), F.when(F.col("p_size") > 25, F.lit("server")).otherwise(F.lit("client")).alias("kind"),
        F.when(F.col("p_size") == 1, F.lit("skip")).otherwise(F.lit("extract")).alias("action"), key, "p_size",
    )
    previous = walked.where(key % 5 != 0).select(
        "project", "path", F.when(key % 7 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"), F.when(key % 11 == 0, F.lit("shared")).otherwise(F.col("kind")).alias("kind"), F.when(key % 13 == 0, 2).otherwise(3).alias("version")
    )
    return records.reused(walked, previous, version=3)


@query("WITH " + WALKED + " SELECT path, reused FROM f")
def files_reused(spark, sf_dir):
    return _walked(spark, sf_dir).select("path", "reused")


@query("WITH " + WALKED + """ SELECT DISTINCT path FROM (SELECT path FROM f WHERE NOT reused UNION ALL SELECT 'src/f' || l_partkey || '.js' FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT 'gone/' || s_suppkey FROM supplier)""")
def files_to_index_again(spark, sf_dir):
    linked = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".js")).alias("path"))
    gone = table(spark, sf_dir, "supplier").select(F.concat(F.lit("gone/"), F.col("s_suppkey").cast("string")).alias("path"))
    return records.to_reindex(_walked(spark, sf_dir).where("NOT reused"), linked, gone)


@query("WITH " + WALKED + """, s AS (SELECT project, CASE WHEN action = 'skip' THEN 'skipped' WHEN kind = 'client' THEN 'recorded' WHEN p_size % 9 = 0 THEN 'unparsed' ELSE 'indexed' END AS status, p_size FROM f)
SELECT project, count(*) AS files, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'recorded') AS recorded, count(*) FILTER (status = 'unparsed') AS unparsed, count(*) FILTER (status = 'skipped') AS skipped,
 coalesce(sum(p_size) FILTER (status = 'indexed'), 0)::BIGINT AS routes, coalesce(sum(p_size * 2) FILTER (status = 'indexed'), 0)::BIGINT AS functions FROM s GROUP BY project""")
def index_stats(spark, sf_dir):
    status = F.when(F.col("action") == "skip", F.lit("skipped")).when(F.col("kind") == "client", F.lit("recorded")).when(F.col("p_size") % 9 == 0, F.lit("unparsed")).otherwise(F.lit("indexed"))
    files = _walked(spark, sf_dir).select("project", status.alias("status"), F.col("p_size").alias("routes"), (F.col("p_size") * 2).alias("functions"))
    return records.file_stats(files, ["routes", "functions"])


@query("""WITH d AS (SELECT DISTINCT 'd' || l_suppkey AS dir, 'p' || l_partkey AS name FROM lineitem), k AS (SELECT DISTINCT 'd' || l_suppkey AS dir, 'p' || l_partkey AS name, l_partkey AS n FROM lineitem)
SELECT dir, name, CASE WHEN n % 2 = 0 THEN '1.' || n WHEN n % 3 = 0 THEN '2.' || n WHEN n % 5 = 0 THEN '3.' || n END AS installed FROM d JOIN k USING (dir, name)""")
def versions_installed(spark, sf_dir):
    pair = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("n")).distinct()
    pair = pair.select(F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("dir"), F.concat(F.lit("p"), F.col("n").cast("string")).alias("name"), "n")
    version = lambda p: F.concat(F.lit(p), F.col("n").cast("string")).alias("version")
    lock = pair.where("n % 2 = 0").select("dir", "name", F.lit("packages").alias("place"), version("1.")).union(pair.where("n % 3 = 0").select("dir", "name", F.lit("dependencies"), version("2.")))
    return records.installed(pair.select("dir", "name"), lock, pair.where("n % 5 = 0").select("dir", "name", version("3.")))


@query("""WITH m AS (SELECT s_nationkey AS project, ['mongoose', 'express', 'mongodb'][s_suppkey % 3 + 1] AS name FROM supplier), e AS (SELECT c_nationkey AS project, ['MONGO_URI', 'PORT', 'dbUrl', 'DATABASE_URL', 'URI'][c_custkey % 5 + 1] AS name FROM customer),
s AS (SELECT c_nationkey AS project, bool_or(c_custkey % 40 = 7 OR c_custkey % 40 = 11) AS cred FROM customer GROUP BY 1), k AS (SELECT DISTINCT project FROM m WHERE name <> 'express' UNION SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 0)
SELECT project, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM m WHERE m.project = k.project AND name <> 'express'), '') AS drivers,
 coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM e WHERE e.project = k.project AND name NOT IN ('PORT', 'URI')), '') AS connection_env, coalesce(cred, false) AS credentials_in_url FROM k LEFT JOIN s USING (project)""")
def databases_of_projects(spark, sf_dir):
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    project, c = F.col("c_nationkey").alias("project"), F.col("c_custkey")
    deps = supplier.select(F.col("s_nationkey").alias("project"), _pick(["mongoose", "express", "mongodb"], F.col("s_suppkey") % 3).alias("name"))
    reads = customer.select(project, _pick(["MONGO_URI", "PORT", "dbUrl", "DATABASE_URL", "URI"], c % 5).alias("name"))
    kind = F.when(c % 40 == 7, F.lit("connection-string")).when(c % 40 == 11, F.lit("env-file-secret")).when(c % 40 == 12, F.lit("env-file-secret")).otherwise(F.lit("hardcoded-secret"))
    secrets = customer.select(project, kind.alias("kind"), F.when(c % 40 == 12, F.lit("API_KEY")).otherwise(F.lit("DB_URI")).alias("name"))
    models = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("project"), F.lit("m").alias("model"))
    made = records.databases(deps, reads, secrets, models)
    return made.select("project", F.array_join("drivers", ",").alias("drivers"), F.array_join("connection_env", ",").alias("connection_env"), "credentials_in_url")


@query("""WITH f AS (SELECT 's' || p_partkey % 10 AS file, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS name, p_partkey AS line, p_size AS col, row_number() OVER (PARTITION BY p_partkey % 10, p_type, p_size % 10 = 0 ORDER BY p_partkey) AS n FROM part)
SELECT file, line, CASE WHEN name IS NULL THEN 'anon@' || line || ':' || col WHEN n > 1 THEN name || '@' || line || ':' || col ELSE name END AS "unique" FROM f""")
def function_names(spark, sf_dir):
    functions = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string")).alias("file"), F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("name"), F.col("p_partkey").alias("line"), F.col("p_size").alias("col"))
    return records.named_apart(functions).select("file", "line", "unique")


@query("""SELECT l_orderkey AS finding, greatest(0.0, coalesce(max(CASE WHEN p_partkey % 3 = 0 THEN p_size / 50.0 - 0.5 END), 0.0))::DOUBLE AS weight FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def finding_weights(spark, sf_dir):
    assets = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("double") / 50 - 0.5).alias("weight"))
    return records.max_weight(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("node")), assets)


BODY = """concat('lead\n## Signals\n', p_name, '\n```js\n## not a section\n', CASE WHEN p_size % 3 = 0 THEN '' ELSE '```\n' END, '## ', p_brand, '  \n\n', p_type, '\n### deeper\n', CASE WHEN p_size % 2 = 0 THEN '## Last\n\n' ELSE '##none' END)"""
PARTS = f"""WITH l AS (SELECT p_partkey, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS nr FROM (SELECT p_partkey, {BODY} AS body FROM part)),
g AS (SELECT *, sum(regexp_matches(line, '^\\s*```')::INT) OVER (PARTITION BY p_partkey ORDER BY nr) % 2 = 1 AS fenced FROM l), h AS (SELECT *, NOT fenced AND regexp_matches(line, '^## .') AS head FROM g),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY p_partkey ORDER BY nr) AS pos FROM h), s AS (SELECT p_partkey, pos::BIGINT AS pos, rtrim(substr(max(line) FILTER (head), 4)) AS name,
 regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT head), ''), '^\\s+|\\s+$', '', 'g') AS text FROM n WHERE pos > 0 GROUP BY ALL)"""


def _parts(spark, sf_dir):
    return records.sections(table(spark, sf_dir, "part").withColumn("body", F.expr(BODY.replace("\n", "\\n"))), "p_partkey", "body")


@query(PARTS + " SELECT * FROM s")
def rule_sections(spark, sf_dir):
    return _parts(spark, sf_dir)


@query(PARTS + """, q AS (SELECT p_partkey, string_agg(name, ' | ' ORDER BY pos) AS got, min(length(text)) AS least FROM s GROUP BY 1)
SELECT p_partkey, CASE WHEN got <> 'Signals | Brand#11' THEN 'sections: ' || got ELSE 'a section is too short' END AS problem FROM q WHERE got <> 'Signals | Brand#11' OR least < 14""")
def rule_section_problems(spark, sf_dir):
    return records.section_problems(_parts(spark, sf_dir), "p_partkey", ["Signals", "Brand#11"], shortest=14)


@query("""WITH d AS (SELECT l_orderkey, list_distinct(list(['express', 'react', 'react-dom', 'mongodb', 'mongoose', 'next', 'typescript', 'lodash'][l_partkey % 8 + 1])) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'Express,Node.js,MongoDB' ELSE array_to_string(list_filter([CASE WHEN list_contains(n, 'express') THEN 'Express' END, CASE WHEN list_has_any(n, ['react', 'react-dom']) THEN 'React' END, CASE WHEN list_has_any(n, ['mongodb', 'mongoose']) THEN 'MongoDB' END,
 CASE WHEN list_contains(n, 'next') THEN 'Next.js' END, CASE WHEN list_contains(n, 'typescript') THEN 'TypeScript' ELSE 'Node.js' END], lambda t: t IS NOT NULL), ',') END AS tags FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def project_tags(spark, sf_dir):
    name = _pick(["express", "react", "react-dom", "mongodb", "mongoose", "next", "typescript", "lodash"], F.col("l_partkey") % 8)
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(name).alias("names"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(used, "o_orderkey", "left").select("o_orderkey", F.array_join(records.tags(F.col("names")), ",").alias("tags"))


# --- text --------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, regexp_replace(trim(regexp_replace(coalesce(text, '') || ' key = "my Token 1"; x', '\\s+', ' ', 'g')), '[''"`][^''"`]*(secret|password|passwd|hunter|token|credential)[^''"`]*[''"`]', '''***''', 'gi') AS t FROM documents)
SELECT doc_id, t AS whole, CASE WHEN length(t) > 120 THEN left(t, 119) || '…' ELSE t END AS short FROM t""".replace("\\\\", "\\"))
def masked_texts(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(' key = "my Token 1"; x'))
    return table(spark, sf_dir, "documents").select("doc_id", S.masked_text(text, 1 << 30).alias("whole"), S.masked_text(text).alias("short"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '***' ELSE 'v' END AS body, 'Bearer ***' AS header, CASE WHEN o_orderkey % 3 = 0 THEN '-a|b' ELSE 'c' END AS rules FROM orders""")
def redacted_requests(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.when(key % 2 == 0, F.lit("userPassword")).otherwise(F.lit("title"))
    body, header = S.redacted(F.create_map(name, F.lit("v"))), S.redacted_headers(F.create_map(F.lit("Authorization"), F.lit("Bearer abc"), F.lit("x-token"), F.lit("t")))
    rules = S.projection_rules(F.when(key % 3 == 0, F.lit(" -a,\n b")).otherwise(F.lit("c")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(body, name).alias("body"), F.element_at(header, "Authorization").alias("header"), F.array_join(rules, "|").alias("rules"))


# a document a part; what is wrong with it goes by the remainder
DOCUMENT = """concat('---\\ntype: ', CASE WHEN p_partkey % 40 = 8 THEN 'other' WHEN p_partkey % 40 = 16 THEN 'same' ELSE concat('r', p_partkey) END, '\\n', CASE p_partkey % 8 WHEN 4 THEN '# none\\n' ELSE concat('title: "', p_name, ': x"\\n') END,
 CASE p_partkey % 8 WHEN 2 THEN 'odd line\\n' WHEN 3 THEN 'title: again\\n' ELSE '' END, 'kind: ', CASE p_partkey % 8 WHEN 5 THEN 'none' ELSE 'rule' END, '  # kind\\nsignals: [a', p_size, ', "b c"]\\nrequires:\\n  - x\\n  - ', p_size, '\\n', CASE p_partkey % 8 WHEN 1 THEN '' ELSE '---\\n' END, CASE p_partkey % 8 WHEN 6 THEN '## Proof\\nlong enough\\n' ELSE '' END,
 '## Signals\\n', CASE p_partkey % 8 WHEN 7 THEN 'short' ELSE 'long enough' END, '\\n## Proof\\nlong enough, too')"""
FILE = "concat('rules/', CASE WHEN p_partkey % 40 = 16 THEN concat('d', p_partkey, '/same') ELSE concat('r', p_partkey) END, '.md')"


def _rules(spark, sf_dir):
    documents = table(spark, sf_dir, "part").selectExpr(f"{FILE} AS file", f"{DOCUMENT} AS text")
    return records.rule_documents(documents, "file", "text", {"rule": ["Signals", "Proof"], "reference": ["Background"]}, shortest=8)


@query(f"""SELECT 'r' || p_partkey AS type, 'rule' AS kind, p_name || ': x' AS title, '["a' || p_size || '","b c"]' AS signals, '["x","' || p_size || '"]' AS requires, substr(sha1(replace({DOCUMENT}, chr(92) || 'n', chr(10))), 1, 8) AS version FROM part WHERE p_partkey % 8 = 0 AND p_partkey % 40 NOT IN (8, 16)""")
def rule_list(spark, sf_dir):
    """Rule documents that are whole, with what their front matter says and their versions."""
    good, _ = _rules(spark, sf_dir)
    return good.select("type", "kind", F.col("meta")["title"].alias("title"), F.col("meta")["signals"].alias("signals"), F.col("meta")["requires"].alias("requires"), "version")


@query(f"""SELECT {FILE} AS file, CASE WHEN p_partkey % 40 = 8 THEN 'type isn''t the file''s name: other' WHEN p_partkey % 40 = 16 THEN 'given twice: same' ELSE ['front matter never ends', 'no name and value: odd line', 'given twice: title', 'absent: title', 'no such kind: none', 'sections: Proof | Signals | Proof', 'too short: Signals'][p_partkey % 8] END AS problem
 FROM part WHERE p_partkey % 8 <> 0 OR p_partkey % 40 = 8 OR (p_partkey % 40 = 16 AND (SELECT count(*) FROM part WHERE p_partkey % 40 = 16) > 1)""")
def rule_list_problems(spark, sf_dir):
    """The first problem of each other document."""
    return _rules(spark, sf_dir)[1]
