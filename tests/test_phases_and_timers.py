"""Edges with several writers against the writers one after another; heartbeats over shuffled micro-batches."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veldra.operators import phases
from veldra.sources.landing import landed
from veldra.streaming import timers

SINK = "src string, dst string, ord int, op string, line int, sources array<string>, tainted boolean, possible boolean, sanitized boolean, sanitizer string"


def union(a, b):
    return list(dict.fromkeys([*a, *b]))


def written(ops, sinks, cap):
    """Edges as writers leave them that come one after another."""
    edges = {}
    for src, dst, _, op, line, sources in sorted(ops, key=lambda o: o[2]):
        if sources:
            e = edges.setdefault((src, dst), {"ops": []})
            e["ops"] = [*e["ops"], {"op": op, "line": line, "sources": sources}][:cap]
    for src, dst, _, op, line, sources, tainted, possible, sanitized, sanitizer in sorted(sinks, key=lambda s: s[2]):
        new = {"op": op, "line": line, "sources": sources, "tainted": tainted, "possible": possible, "sanitized": sanitized, "sanitizer": sanitizer}
        e = edges.get((src, dst))
        if e is None:
            edges[src, dst] = {"ops": [new], "tainted": tainted, "possible": possible, "sanitized": sanitized, "sanitizer": sanitizer}
            continue
        match = next((o for o in e["ops"] if (o["op"], o["line"]) == (op, line)), None)
        if match:
            match["sources"] = union(match["sources"], sources)
            match["tainted"] = match.get("tainted") or tainted
            match["sanitized"] = bool(match.get("sanitized")) and sanitized
            match["sanitizer"] = sanitizer or match.get("sanitizer")
        else:
            e["ops"] = [*e["ops"], new][:cap]
        e["tainted"], e["possible"], e["sanitized"] = e.get("tainted") or tainted, e.get("possible") or possible, bool(e.get("sanitized")) and sanitized
    names = ("op", "line", "sources", "tainted", "possible", "sanitized", "sanitizer")
    return {k: ([tuple(o.get(n) for n in names) for o in e["ops"]], e.get("tainted"), e.get("possible"), e.get("sanitized"), e.get("sanitizer")) for k, e in edges.items()}


@pytest.mark.parametrize("cap", [1, 4, 60])
def test_phases_equal_writers_one_after_another(spark, cap):
    rng = random.Random(cap)
    names = ["req.body", "req.params.id", "req.query.q"]
    some = lambda least: rng.sample(names, rng.randrange(least, 3))
    flip = lambda p=0.5: rng.random() < p
    ops = [(f"f{rng.randrange(4)}", f"m{rng.randrange(3)}", i, f"op{rng.randrange(2)}", rng.randrange(4), some(0)) for i in range(40)]
    sinks = [
        (f"f{rng.randrange(5)}", f"m{rng.randrange(4)}", i, f"op{rng.randrange(2)}", rng.randrange(5), some(0), flip(), flip(), flip(0.8), rng.choice([None, "a", "b"])) for i in range(60)
    ]
    made = phases.flows_to_sinks(spark.createDataFrame(ops, "src string, dst string, ord int, op string, line int, sources array<string>").repartition(3), spark.createDataFrame(sinks, SINK).repartition(3), cap)
    got = {(r.src, r.dst): ([tuple(o) for o in r.ops], r.tainted, r.possible, r.sanitized, r.sanitizer) for r in made.collect()}
    assert got == written(ops, sinks, cap)
    access = {(r.src, r.dst): [(o.op, o.line) for o in r.ops] for r in phases.accesses(spark.createDataFrame(ops, "src string, dst string, ord int, op string, line int, sources array<string>"), cap).collect()}
    want = {}
    for o in ops:
        want.setdefault(o[:2], []).append(o[3:5])
    assert access == {k: v[:cap] for k, v in want.items()}


def test_heartbeats_in_any_order(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    seen = {"p": [0, 1, 4], "q": [2], "r": [6]}
    rows = [(k, day + datetime.timedelta(days=d, hours=h)) for k, ds in seen.items() for d in ds for h in (3, 5)]
    random.Random(1).shuffle(rows)
    files = [rows[::3], rows[1::3], rows[2::3], [("z", day + datetime.timedelta(days=30))]]
    for part in files:
        spark.createDataFrame(part, "project string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("project string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    beats = landed(timers.heartbeats(stream, "project", "ts", 86_400_000, "20 days"), "beats")
    zero = int(day.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) // 86_400_000
    got = sorted((r.project, r.day) for r in beats.select("project", (F.col("began") / 86_400_000 - zero).cast("int").alias("day")).collect())
    assert got == sorted((k, d) for k, ds in seen.items() for d in range(min(ds), 10) if d not in ds)
