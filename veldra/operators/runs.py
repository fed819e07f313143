"""Runs over projects: locks, requests for checks, and names that users give for things."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_SECONDS = 600


def locked(events: DataFrame, key: str, order: list[str], at: str, run: str, release: str, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """events with ``outcome`` and ``holder`` (the run that has the lock afterwards), as each key's events come in ``order``.

    Where ``release`` is true, the lock goes if the run holds it (released), else nothing happens (ignored). Other events ask
    for it and get it (acquired) if it is free or was taken ``stale_seconds`` ago or earlier, else not (refused). Events
    without a run or a time are ignored. Each key's events pass one task in order; the state is one lock, so a key may have
    any number of events.
    """
    micros, stale = "__at", stale_seconds * 1_000_000
    dealt = events.where(F.col(key).isNotNull()).withColumn(micros, F.unix_micros(F.col(at).cast("timestamp"))).repartition(key).sortWithinPartitions(key, *order)
    kept = events.columns

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, holder, since = None, None, 0
        for batch in batches:
            outcomes, holders = [], []
            for k, t, r, done in zip(batch[key], batch[micros], batch[run], batch[release], strict=True):
                if k != current:
                    current, holder, since = k, None, 0
                if pd.isna(r) or pd.isna(t):
                    outcome = "ignored"
                elif not pd.isna(done) and done:
                    outcome = "released" if holder == r else "ignored"
                    holder = None if holder == r else holder
                elif holder is None or since <= t - stale:
                    outcome, holder, since = "acquired", r, t
                else:
                    outcome = "refused"
                outcomes.append(outcome)
                holders.append(holder)
            yield batch[kept].assign(outcome=outcomes, holder=pd.Series(holders, dtype=object, index=batch.index))

    held = events.schema[run].dataType.simpleString()
    return dealt.mapInPandas(decide, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + f", outcome string, holder {held}")


def subject_key(kind: Column, route: Column, fn: Column, line: Column, secret: Column, findings: Column) -> Column:
    """One text for equal subjects of a check; null for kinds that aren't known."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return (
        F.when(kind == "route", F.concat(F.lit("route:"), text(route)))
        .when(kind == "jwt", F.concat(F.lit("jwt:"), text(fn), F.lit(":"), text(line)))
        .when(kind == "secret", F.concat(F.lit("secret:"), text(secret)))
        .when(kind == "chain", F.concat(F.lit("chain:"), F.array_join(F.array_sort(F.coalesce(findings, F.array().cast("array<string>"))), ",")))
    )


def drained(requests: DataFrame, order: list[str], results: DataFrame, open_findings: DataFrame, enabled: bool, configured: bool) -> DataFrame:
    """(key, id, result, reason, finding): the first pending request of each key with what comes of it.

    requests: (id, status, template, kind, subject, type, nodes array<string>); results: (id, result) of checks that ran;
    open_findings: (finding, type, nodes). A key is template, kind and subject. Without checks all are INCONCLUSIVE, with the
    reason. A confirmed one goes to the least open finding of its type about the same nodes; where there is none, ``finding``
    is ``new``.
    """
    pending = requests.where("status = 'verification-requested'").withColumn("key", F.concat_ws("::", "template", "kind", "subject"))
    columns = [c for c in pending.columns if c != "key"]
    first = pending.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("f")).select("key", "f.id", "f.type", F.array_sort("f.nodes").alias("nodes"))
    if not (enabled and configured):
        why = "verification disabled" if configured else "no target configured"
        return first.select("key", "id", F.lit("INCONCLUSIVE").alias("result"), F.lit(why).alias("reason"), F.lit(None).cast("string").alias("finding"))
    known = open_findings.groupBy("type", F.array_sort("nodes").alias("nodes")).agg(F.min("finding").cast("string").alias("finding"))
    ran = first.join(results.select("id", "result").dropDuplicates(["id"]), "id", "left").withColumn("result", F.coalesce("result", F.lit("INCONCLUSIVE")))
    finding = F.when(F.col("result") == "CONFIRMED", F.coalesce("finding", F.lit("new")))
    return ran.join(known, ["type", "nodes"], "left").select("key", "id", "result", F.lit(None).cast("string").alias("reason"), finding.alias("finding"))


def reverified(findings: DataFrame, earlier: DataFrame) -> DataFrame:
    """(finding, template, hypothesis, route): the check to make again; findings: (finding, type, agent_run, run, nodes
    array<string>), earlier: (run, template, hypothesis). What the earlier run doesn't say comes from the finding."""
    route = F.get(F.filter("nodes", lambda n: n.startswith("Route:")), F.lit(0))
    joined = findings.join(earlier.dropDuplicates(["run"]), "run", "left")
    return joined.select("finding", F.coalesce("template", "type").alias("template"), F.coalesce("hypothesis", "agent_run").alias("hypothesis"), F.coalesce(F.regexp_replace(route, "^Route:", ""), F.lit("")).alias("route"))


def resolved(asked: DataFrame, nodes: DataFrame, shown: int = 10) -> DataFrame:
    """(asked, status, id, candidates): the one node (id, name) of an asked name, case ignored.

    Status is found, ambiguous (with the first ``shown`` ids by order), or not_found.
    """
    wanted = asked.select("asked", F.lower(F.trim("asked")).alias("low")).distinct()
    named = nodes.select("id", F.lower("name").alias("low")).join(wanted.select("low").distinct(), "low", "left_semi").distinct()
    counted = named.groupBy("low").agg(F.count("*").alias("n"))
    least = named.withColumn("at", F.row_number().over(Window.partitionBy("low").orderBy("id"))).where(F.col("at") <= shown)
    listed = least.groupBy("low").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    found = wanted.join(counted.join(listed, "low"), "low", "left")
    one = F.col("n") == 1
    status = F.when(one, F.lit("found")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("not_found"))
    return found.select("asked", status.alias("status"), F.when(one, F.get("ids", F.lit(0))).alias("id"), F.when(F.col("n") > 1, F.col("ids")).alias("candidates"))


def projects_named(asked: DataFrame, projects: DataFrame) -> DataFrame:
    """(asked, project): by id, else by name (the least id), else the project indexed last; projects: (project, name, status,
    indexed_at). Ties go to the least id; a null or empty name asks for the last one."""
    wanted = asked.select("asked").distinct()
    by_id = projects.select("project", F.col("project").alias("asked"), F.lit(0).alias("rank"))
    by_name = projects.groupBy(F.col("name").alias("asked")).agg(F.min("project").alias("project")).select("project", "asked", F.lit(1).alias("rank"))
    hit = by_id.unionByName(by_name).join(wanted.where("asked <> ''"), "asked").groupBy("asked").agg(F.min_by("project", "rank").alias("named"))
    indexed = projects.where("status = 'indexed'")
    last = indexed.agg(F.min_by("project", F.struct((-F.unix_micros(F.col("indexed_at").cast("timestamp"))).alias("t"), F.col("project").alias("p"))).alias("latest"))
    return wanted.join(hit, "asked", "left").crossJoin(F.broadcast(last)).select("asked", F.coalesce("named", "latest", "asked").alias("project"))  # one row
