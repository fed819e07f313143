"""Proposals judged against facts, evidence and each other: a cascade of semi-joins that yields the first reason of refusal.

A proposal says that a kind of weakness (a book) concerns a subject, and cites queries of its run as evidence. Each test is a
flag worked out for all proposals at once; the first that fails is the reason. Only what passes all others can make a later one a duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators.joins import containment_match
from veldra.sources.landing import stored

# fixed values: queries whose answers are facts; of these the ones that name one route, and the listings
FACT_TOOLS = [
    "getRoutes", "getRoute", "getMiddlewareChain", "getCallGraph", "getDataflow", "getModelAccess", "getDependency", "getSensitiveAssets", "getUnprotectedRoutes",
    "getRoutesTouchingModel", "getAuthorizationGaps", "getJwtUsage", "getSecrets", "getExposure", "getFindings", "getAttackPath",
]
ROUTE_SCOPED = ["getRoute", "getDataflow", "getMiddlewareChain", "getExposure"]
LISTING = ["getRoutes", "getUnprotectedRoutes", "getAuthorizationGaps", "getRoutesTouchingModel", "getModelAccess", "getSensitiveAssets", "getExposure", "getCallGraph"]
KINDS = ["route", "jwt", "secret"]


def subject_kinds(books: DataFrame, sources: DataFrame) -> DataFrame:
    """(type, wanted): the kind of subject a book is about, by the sources (signal, source) of its signals; the first of KINDS counts."""
    each = books.select("type", F.explode(F.array_union("signals", "requires")).alias("signal")).join(sources, "signal")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("source"))
    return each.where(place > 0).groupBy("type").agg(F.min_by("source", place).alias("wanted"))


def covering(calls: DataFrame, cited: DataFrame) -> DataFrame:
    """cited (id, run, kind, subject, seq, and more) with the call it means: ``called``, ``ok``, ``fact``, ``about``.

    calls: (run, seq, tool, ok, route, named array<string>): the route that was asked for, and the ids that the answer names. A call
    is about a route that it asked for, or, without such a question, one that its listing names; for other subjects their own listing must name them.
    """
    known = calls.select("run", "seq", "tool", "ok", F.col("route").alias("asked"), "named", F.lit(True).alias("called"))
    met = cited.join(known.hint("merge"), ["run", "seq"], "left")
    named = F.coalesce(F.array_contains("named", F.col("subject")), F.lit(False))
    scoped = F.col("tool").isin(ROUTE_SCOPED) & F.col("asked").isNotNull()
    route = F.when(scoped, F.col("asked") == F.col("subject")).otherwise(F.col("tool").isin(LISTING) & named)
    about = F.when(F.col("kind") == "route", route).when(F.col("kind") == "jwt", (F.col("tool") == "getJwtUsage") & named).otherwise((F.col("tool") == "getSecrets") & named)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return met.select(*[c for c in cited.columns if c not in ("run", "kind", "subject")], flag(F.col("called")).alias("called"), flag(F.col("ok")).alias("ok"), flag(F.col("tool").isin(FACT_TOOLS)).alias("fact"), flag(about).alias("about"))


def judged(proposals: DataFrame, books: DataFrame, sources: DataFrame, allowed: DataFrame, subjects: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, code, detail): code null for accepted proposals.

    proposals: (id, run, seq, type, kind, subject, evidence array<int>), books: (type, kind, signals, requires), allowed: (run,
    type), subjects: (kind, subject, signals) that exist, calls as in ``covering``.

    What grows with the runs and subjects is joined by merging: their sizes are guessed from columns that were exploded
    since, so Spark would gather them on the driver to broadcast them. Subjects that nobody proposes aren't matched.
    """
    vulnerable = books.select("type", F.col("kind").alias("book"))
    rows = proposals.join(vulnerable, "type", "left").join(subject_kinds(books, sources), "type", "left")
    rows = rows.join(allowed.select("run", "type").distinct().withColumn("may", F.lit(True)).hint("merge"), ["run", "type"], "left")
    # proposals may be many about few subjects: what is known of these is kept, so that its size is known
    asked = stored(proposals.select("kind", "subject").distinct(), "asked")
    subjects = stored(subjects.join(asked.hint("merge"), ["kind", "subject"], "left_semi"), "subjects")
    rows = rows.join(stored(subjects.select("kind", "subject", F.lit(True).alias("exists")).distinct(), "known"), ["kind", "subject"], "left")

    # a subject's signals are matched once, whoever proposes it
    key = F.concat_ws("\n", "kind", "subject")
    signals = subjects.select(key.alias("subject"), F.explode("signals").alias("signal"))
    rules = books.where("kind <> 'reference'").select(F.col("type").alias("rule"), "signals", "requires")
    fits = containment_match(rules, signals).select(F.col("subject").alias("key"), F.col("rule").alias("type"), F.lit(True).alias("fits"))
    rows = rows.withColumn("key", key).join(stored(fits, "fits"), ["key", "type"], "left")

    cited = proposals.select("id", "run", "kind", "subject", F.posexplode("evidence").alias("nth", "seq"))
    calls_met = covering(calls, cited)
    wrong = F.when(~F.col("called"), "is not a call of this run").when(~F.col("ok"), "failed").when(~F.col("fact"), "is no fact query")
    first_wrong = F.min_by(F.concat_ws(" ", F.concat(F.lit("#"), F.col("seq").cast("string")), wrong), F.when(wrong.isNotNull(), F.col("nth")))
    evidence = calls_met.groupBy("id").agg(first_wrong.alias("wrong"), F.bool_or("about").alias("about"))
    rows = rows.join(evidence.hint("merge"), "id", "left")

    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = lambda test, code, detail: (test, F.struct(F.lit(code).alias("code"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))
    steps = [
        reason(F.col("book").isNull(), "not_found", "no such book"),
        reason(F.col("book") == "reference", "invalid_argument", "a reference, no weakness"),
        reason(~has("may"), "not_allowed", "not for this agent"),
        reason(F.col("wanted").isNotNull() & (F.col("wanted") != F.col("kind")), "invalid_argument", F.concat(F.lit("about a "), "wanted")),
        reason(~F.col("kind").isin(KINDS), "invalid_argument", "chains aren't proposed"),
        reason(~has("exists"), "not_found", "no such subject"),
        reason(~has("fits"), "not_supported_by_facts", "its signals don't fire"),
        reason(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "invalid_argument", "no evidence"),
        reason(F.col("wrong").isNotNull(), "invalid_evidence", F.col("wrong")),
        reason(~has("about"), "invalid_evidence", "none is about the subject"),
    ]
    why = F.when(*steps[0])
    for step in steps[1:]:
        why = why.when(*step)
    rows = rows.withColumn("why", why)
    nth = F.row_number().over(Window.partitionBy("run", "type", "kind", "subject", F.col("why").isNull()).orderBy("seq", "id"))
    code = F.when(F.col("why").isNotNull(), F.col("why.code")).when(nth > 1, "duplicate")
    return rows.select("id", code.alias("code"), F.when(F.col("why").isNotNull(), F.col("why.detail")).when(nth > 1, "proposed before").alias("detail"))
