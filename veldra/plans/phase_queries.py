"""Edges with several writers over line items, next to DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.operators import phases
from veldra.plans.queries import query
from veldra.plans.star import table

# functions are parts, models suppliers, each by a remainder, so that edges have more writers than their lists take
OPS = """SELECT concat('Function:f', l_partkey % 40) AS src, concat('Model:m', l_suppkey % 5) AS dst, ((CAST(l_orderkey AS bigint) * 8 + l_linenumber) * 100000000 + l_partkey * 2000 + l_suppkey) * 64 + CAST(l_quantity AS int) AS ord, concat('op', l_returnflag) AS op,
 CAST(l_quantity AS int) * 2 + l_partkey % 2 AS line, CASE WHEN l_linenumber = 7 THEN {none} WHEN l_linenumber % 2 = 0 THEN {list}('req.body') ELSE {list}(concat('req.params.p', l_orderkey % 3), 'req.body') END AS sources FROM lineitem"""
SINKS = """SELECT concat('Function:f', l_partkey % 40) AS src, CASE WHEN l_linenumber % 3 = 0 THEN 'Sink:exec' ELSE concat('Model:m', l_suppkey % 5 + l_linenumber % 2) END AS dst, ((CAST(l_orderkey AS bigint) * 8 + l_linenumber) * 100000000 + l_partkey * 2000 + l_suppkey) * 64 + CAST(l_quantity AS int) AS ord, concat('op', l_returnflag) AS op,
 CAST(l_quantity AS int) AS line, CASE WHEN l_linenumber = 1 THEN {none} ELSE {list}('req.query.q', concat('req.params.p', l_orderkey % 4)) END AS sources, l_linestatus = 'F' AS tainted, l_linenumber % 2 = 0 AS possible, l_quantity > 2 AS sanitized,
 CASE WHEN l_orderkey % 5 = 0 THEN concat('clean', l_linenumber) END AS sanitizer FROM lineitem WHERE l_orderkey % 4 = 0"""


def _made(spark, sf_dir, text: str) -> DataFrame:
    body = text.replace("{list}", "array").replace("{none}", "CAST(array() AS array<string>)").replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(body, lineitem=table(spark, sf_dir, "lineitem")).withColumn("line", F.col("line").cast("int"))


def _duck(text: str) -> str:
    return text.replace("{list}", "list_value").replace("{none}", "[]::VARCHAR[]")


def _shown(edges: DataFrame, *flags: str) -> DataFrame:
    """Operations as one text each."""
    bit = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    one = lambda o: F.concat_ws(":", o["op"], o["line"].cast("string"), F.array_join(o["sources"], "+"), bit(o["tainted"]), bit(o["possible"]), bit(o["sanitized"]), F.coalesce(o["sanitizer"], F.lit("-")))
    return edges.select("src", "dst", F.array_join(F.transform("ops", one), " ").alias("ops"), *flags)


SHOWN = "string_agg(concat_ws(':', op, line, array_to_string(sources, '+'), coalesce(tainted::VARCHAR, '-'), coalesce(possible::VARCHAR, '-'), coalesce(sanitized::VARCHAR, '-'), coalesce(sanitizer, '-')), ' ' ORDER BY rank)"
BASE = f"WITH o AS ({_duck(OPS)}), s AS ({_duck(SINKS)})"


@query(BASE + f", r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS rank, NULL AS tainted, NULL AS possible, NULL AS sanitized, NULL AS sanitizer FROM o) SELECT src, dst, {SHOWN} AS ops FROM r WHERE rank <= 60 GROUP BY src, dst")
def phased_accesses(spark, sf_dir):
    """The first sixty operations of each function and model."""
    return _shown(phases.accesses(_made(spark, sf_dir, OPS)))


@query(
    BASE
    + f""", a AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS rank FROM o WHERE len(sources) > 0 QUALIFY rank <= 60),
x AS (SELECT src, dst, op, line, source, min((ord, nth)) AS place FROM (SELECT src, dst, op, line, ord, unnest(sources) AS source, generate_subscripts(sources, 1) AS nth FROM s) GROUP BY ALL), u AS (SELECT src, dst, op, line, list(source ORDER BY place) AS added FROM x GROUP BY ALL),
g AS (SELECT src, dst, op, line, min(ord) AS ord, bool_or(tainted) AS tainted, arg_min(possible, ord) AS possible, bool_and(sanitized) AS sanitized, arg_max(sanitizer, ord) FILTER (sanitizer IS NOT NULL) AS sanitizer FROM s GROUP BY ALL),
j AS (SELECT g.*, coalesce(added, []) AS added FROM g LEFT JOIN u USING (src, dst, op, line)),
t AS (SELECT src, dst, op, line, min(rank) AS rank FROM a GROUP BY ALL), h AS (SELECT j.*, t.rank FROM j JOIN t USING (src, dst, op, line)),
held AS (SELECT src, dst, max(rank) AS held FROM a GROUP BY ALL),
m AS (SELECT j.*, row_number() OVER (PARTITION BY src, dst ORDER BY ord) + coalesce(held, 0) AS rank FROM j ANTI JOIN t USING (src, dst, op, line) LEFT JOIN held USING (src, dst)),
l AS (SELECT a.src, a.dst, a.rank, a.op, a.line, CASE WHEN h.rank IS NULL THEN a.sources ELSE a.sources || list_filter(h.added, lambda v: NOT list_contains(a.sources, v)) END AS sources, h.tainted, NULL::BOOLEAN AS possible, CASE WHEN h.rank IS NOT NULL THEN false END AS sanitized, h.sanitizer
 FROM a LEFT JOIN h ON h.src = a.src AND h.dst = a.dst AND h.rank = a.rank UNION ALL SELECT src, dst, rank, op, line, added, tainted, possible, sanitized, sanitizer FROM m WHERE rank <= 60),
f AS (SELECT src, dst, bool_or(tainted) AS e_tainted, bool_or(possible) AS e_possible, bool_and(sanitized) AS every, (list(sanitizer ORDER BY ord))[1] AS first_one FROM s GROUP BY ALL)
SELECT src, dst, {SHOWN} AS ops, any_value(e_tainted) AS tainted, any_value(e_possible) AS possible, CASE WHEN any_value(every) IS NOT NULL THEN any_value(every) AND any_value(held) IS NULL END AS sanitized,
 CASE WHEN any_value(held) IS NULL THEN any_value(first_one) END AS sanitizer FROM l LEFT JOIN held USING (src, dst) LEFT JOIN f USING (src, dst) GROUP BY src, dst"""
)
def phased_sink_flows(spark, sf_dir):
    """What functions let flow into models and other sinks: operations first, sinks after them."""
    return _shown(phases.flows_to_sinks(_made(spark, sf_dir, OPS), _made(spark, sf_dir, SINKS)), "tainted", "possible", "sanitized", "sanitizer")


@query(
    BASE
    + """, c AS (SELECT src, 'Function:g' || line % 7 AS dst, ord, sources, tainted, possible, sanitized, sanitizer, 'arg' || ord % 3 AS via, line FROM s),
x AS (SELECT src, dst, source, min((ord, nth)) AS place FROM (SELECT src, dst, ord, unnest(sources) AS source, generate_subscripts(sources, 1) AS nth FROM c) GROUP BY ALL), u AS (SELECT src, dst, string_agg(source, ' ' ORDER BY place) AS sources FROM x GROUP BY ALL)
SELECT src, dst, coalesce(u.sources, '') AS sources, (list(via ORDER BY ord))[1] AS via, (list(line ORDER BY ord))[1] AS line, (list(sanitizer ORDER BY ord))[1] AS sanitizer, bool_or(tainted) AS tainted, bool_or(possible) AS possible, bool_and(sanitized) AS sanitized
FROM c LEFT JOIN u USING (src, dst) GROUP BY src, dst, u.sources"""
)
def phased_function_flows(spark, sf_dir):
    """Inputs handed on by calls, one edge of each pair of functions."""
    calls = _made(spark, sf_dir, SINKS).withColumns({"dst": F.concat(F.lit("Function:g"), (F.col("line") % 7).cast("string")), "via": F.concat(F.lit("arg"), (F.col("ord") % 3).cast("string"))})
    return phases.flows_to_functions(calls).withColumn("sources", F.array_join("sources", " "))
