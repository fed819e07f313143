"""Proposals made from orders, judged against facts made from parts, next to DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.operators import proposals
from veldra.plans.queries import query
from veldra.plans.star import table

# (type, kind, signals, requires) and (signal, source): own rules
BOOKS = [("open", "rule", ["unprotected", "weak"], []), ("idor", "rule", ["unprotected"], ["by-id"]), ("token", "rule", ["no-expiry"], []), ("leak", "rule", ["hardcoded"], []), ("guide", "reference", ["weak"], [])]
SOURCES = [("unprotected", "route"), ("weak", "route"), ("by-id", "route"), ("no-expiry", "jwt"), ("hardcoded", "secret")]

SQL = """WITH p AS (SELECT o_orderkey AS id, o_custkey AS run, o_orderkey AS seq, (o_orderkey // 7) % 6 AS t, CASE WHEN o_orderkey % 23 = 0 THEN 'chain' WHEN o_orderkey % 19 = 0 THEN 'jwt' WHEN (o_orderkey // 7) % 6 = 2 THEN 'jwt' WHEN (o_orderkey // 7) % 6 = 3 THEN 'secret' ELSE 'route' END AS kind,
 (o_custkey % 3) * 5 + o_orderkey % 2 AS s, o_orderkey % 4 AS e FROM orders),
n AS (SELECT (SELECT max(p_partkey) FROM part) AS top),
l AS (SELECT l_orderkey AS id, l_linenumber AS i, l_partkey % 11 AS tool, l_linenumber % 3 AS how FROM lineitem),
c AS (SELECT *, CASE t WHEN 0 THEN 'open' WHEN 1 THEN 'idor' WHEN 2 THEN 'token' WHEN 3 THEN 'leak' WHEN 4 THEN 'guide' ELSE 'nothing' END AS type, s BETWEEN 1 AND (SELECT top FROM n) AS known FROM p),
f AS (SELECT *, CASE WHEN t = 0 THEN s % 2 = 1 OR s % 3 = 0 WHEN t = 1 THEN s % 2 = 1 AND s % 5 = 0 ELSE s % 4 <> 3 END AS fits FROM c),
w AS (SELECT id, run, seq, type, kind, s, CASE WHEN t = 5 THEN 'not_found:no such book' WHEN t = 4 THEN 'invalid_argument:a reference, no weakness' WHEN (run + t) % 10 = 0 THEN 'not_allowed:not for this agent'
 WHEN kind <> (CASE t WHEN 2 THEN 'jwt' WHEN 3 THEN 'secret' ELSE 'route' END) THEN 'invalid_argument:about a ' || (CASE t WHEN 2 THEN 'jwt' WHEN 3 THEN 'secret' ELSE 'route' END) WHEN NOT known THEN 'not_found:no such subject' WHEN NOT fits THEN 'not_supported_by_facts:its signals don''t fire'
 WHEN e = 0 THEN 'invalid_argument:no evidence' WHEN e = 1 AND run % 3 = 0 THEN 'invalid_evidence:#900 is not a call of this run' WHEN e = 1 AND run % 3 = 1 THEN 'invalid_evidence:#2 failed' WHEN e = 1 THEN 'invalid_evidence:#3 is no fact query'
 WHEN e = 2 AND run % 2 = 0 THEN 'invalid_evidence:none is about the subject' END AS why FROM f)
SELECT id, CASE WHEN why IS NOT NULL THEN split_part(why, ':', 1) WHEN nth > 1 THEN 'duplicate' END AS code, CASE WHEN why IS NOT NULL THEN split_part(why, ':', 2) WHEN nth > 1 THEN 'proposed before' END AS detail
 FROM (SELECT *, row_number() OVER (PARTITION BY run, type, kind, s, why IS NULL ORDER BY seq, id) AS nth FROM w)"""


@query(SQL)
def proposals_judged(spark, sf_dir):
    """The first reason why each proposal is refused, or none."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey AS run", "o_orderkey AS seq", "(o_orderkey div 7) % 6 AS t", "(o_custkey % 3) * 5 + o_orderkey % 2 AS s", "o_orderkey % 4 AS e")
    kind = "CASE WHEN id % 23 = 0 THEN 'chain' WHEN id % 19 = 0 THEN 'jwt' WHEN t = 2 THEN 'jwt' WHEN t = 3 THEN 'secret' ELSE 'route' END"
    # calls: 1 lists all, 2 failed, 3 is none for facts, 10 + s asks for one subject
    given = "CASE e WHEN 0 THEN CAST(array() AS array<int>) WHEN 1 THEN CASE run % 3 WHEN 0 THEN array(1, 900, 2) WHEN 1 THEN array(2, 3) ELSE array(1, 3) END WHEN 2 THEN IF(run % 2 = 0, array(4), array(4, 1)) ELSE IF(t < 2, array(4, CAST(10 + s AS int)), array(4, 1, 1)) END"
    rows = o.selectExpr("id", "run", "seq", "element_at(array('open', 'idor', 'token', 'leak', 'guide', 'nothing'), CAST(t + 1 AS int)) AS type", f"{kind} AS kind", "concat('s', s) AS subject", f"{given} AS evidence")
    parts = table(spark, sf_dir, "part").where("p_partkey > 0").selectExpr("p_partkey AS s")
    signal = "array_compact(array(IF(s % 2 = 1, 'unprotected', NULL), IF(s % 3 = 0, 'weak', NULL), IF(s % 5 = 0, 'by-id', NULL), IF(s % 4 <> 3, 'no-expiry', NULL), IF(s % 4 <> 3, 'hardcoded', NULL)))"
    subjects = parts.selectExpr("explode(array('route', 'jwt', 'secret')) AS kind", "concat('s', s) AS subject", f"{signal} AS signals")
    runs = o.select("run").distinct()
    small = F.array(*[F.lit(f"s{i}") for i in range(12)])
    calls = runs.selectExpr("run", "explode(sequence(1, 25)) AS seq").withColumns(
        {
            "ok": F.col("seq") != 2,
            "route": F.when(F.col("seq") > 9, F.concat(F.lit("s"), (F.col("seq") - 10).cast("string"))),
            "tools": F.expr("CASE WHEN seq = 3 THEN array('search') WHEN seq = 4 THEN array('getFindings') WHEN seq > 4 THEN array('getRoute') ELSE array('getRoutes') END"),
            "named": F.when(F.col("seq") <= 3, small).otherwise(F.array().cast("array<string>")),
        }
    )
    # the first call's listing is that of the kind that a run asks about
    calls = calls.select("run", "seq", F.explode("tools").alias("tool"), "ok", "route", "named")
    typed = rows.select("run", "kind").distinct()
    more = typed.where("kind IN ('jwt', 'secret')").select("run", F.lit(1).alias("seq"), F.when(F.col("kind") == "jwt", "getJwtUsage").otherwise("getSecrets").alias("tool"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("route"), small.alias("named"))
    allowed = runs.crossJoin(F.broadcast(spark.createDataFrame([(i, b[0]) for i, b in enumerate(BOOKS)], "t int, type string"))).where("(run + t) % 10 <> 0").select("run", "type")  # five books
    books = spark.createDataFrame(BOOKS, "type string, kind string, signals array<string>, requires array<string>")
    return proposals.judged(rows, books, spark.createDataFrame(SOURCES, "signal string, source string"), allowed, subjects, calls.unionByName(more))
