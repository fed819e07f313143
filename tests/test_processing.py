"""Tables that change together, and changes processed as a stream: repeated batches, batches cut short, skipped projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.sources.tableset import Table, TableSet
from veldra.streaming import processing


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table_set(spark, tmp_path):
    known = {"state": Table("k int, v string", ["k"]), "log": Table("k int, v string", ["k"], log=True)}
    t = TableSet(spark, str(tmp_path / "t"), known, new=True, every=3)
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    gone = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k int")
    assert rows_of(t.read("state")) == [] and rows_of(t.read("log")) == []
    assert t.commit(0, {"state": make((1, "a"), (2, "b")), "log": make((1, "x"), (1, "x"))})
    assert t.commit(1, {"state": make((2, "c"), (3, "d")), "log": make((1, "again"), (2, "y"))}, {"state": gone(1)})
    before = rows_of(t.read("state")), rows_of(t.read("log"))
    assert before == ([(2, "c"), (3, "d")], [(1, "x", 0), (2, "y", 1)])
    assert not t.commit(1, {"state": make((9, "z")), "log": make((9, "z"))}) and not t.commit(0, {"state": make((8, "z"))})
    assert (rows_of(t.read("state")), rows_of(t.read("log"))) == before
    # a batch that wrote a folder, but no manifest, is seen by nobody, and is written anew
    make((7, "half")).withColumn("gone", F.lit(False)).withColumn("batch", F.lit(2).cast("long")).write.parquet(str(tmp_path / "t" / "state" / "batch-2"))
    other = TableSet(spark, str(tmp_path / "t"), known, new=False, every=3)
    assert rows_of(other.read("state")) == before[0] and other.batch == 1
    assert other.commit(2, {"state": make((1, "back"))}, {"state": gone(3)})
    assert [f.rsplit("/", 1)[1] for f in other.folders["state"]] == ["base-2"]
    assert rows_of(other.read("state")) == [(1, "back"), (2, "c")]
    other.commit(3, {"log": make((2, "newer"), (5, "w"))})
    other.tidy()
    t.refresh()
    assert rows_of(t.read("state")) == [(1, "back"), (2, "c")] and rows_of(t.latest("log", ["k"], ["v"])) == [(1, "x", 0), (2, "y", 1), (5, "w", 3)]
    assert sorted(p.name for p in (tmp_path / "t" / "state").iterdir()) == ["base-2"]


def node(i, hash_="a"):
    return (f"Function:{i}", "Function", i, hash_)


def call(a, b):
    return (f"CALLS|Function:{a}|Function:{b}", "CALLS", f"Function:{a}", f"Function:{b}", "a")


def test_processing(spark, tmp_path):
    t = TableSet(spark, str(tmp_path / "t"), processing.TABLES, new=True)
    change = lambda *rows: spark.createDataFrame(list(rows), processing.CHANGES)
    verdicts = spark.createDataFrame([("p", 1, "REJECTED"), ("p", 2, "CONFIRMED"), ("q", 1, "REJECTED")], "project string, finding_id long, verdict string")
    findings = [("p", 1, "open", ["Function:x"]), ("p", 2, "resolved", ["Function:far"]), ("p", 3, "open", ["Function:x"]), ("q", 1, "open", ["Function:x"])]
    t.commit(0, {"findings": spark.createDataFrame(findings, "project string, finding_id long, status string, affected_nodes array<string>")})
    first = change(
        ("p", "a.js", "added", 1, [node("w")], []),
        ("p", "a.js", "added", 2, [node("x"), node("y")], [call("x", "y"), call("y", "far")]),
        ("p", "b.js", "added", 1, [node("far")], None),
        ("q", "a.js", "added", 1, [node("x")], []),
        ("r", "a.js", "added", 1, [node("x")], []),
    )
    busy = spark.createDataFrame([("r",)], "project string")
    assert processing.process(t, first, 1, verdicts, busy)
    assert rows_of(t.read("nodes").select("project", "file", "id")) == [("p", "a.js", "Function:x"), ("p", "a.js", "Function:y"), ("p", "b.js", "Function:far"), ("q", "a.js", "Function:x")]
    status = lambda: rows_of(t.read("findings").select("project", "finding_id", "status"))
    assert status() == [("p", 1, "resolved"), ("p", 2, "regressed"), ("p", 3, "open"), ("q", 1, "resolved")]
    events = rows_of(t.read("timeline").select("project", "type", "summary"))
    assert ("p", "change.detected", "2 files changed, 5 nodes affected") in events and ("r", "change.skipped", "1 files changed, another run is active") in events
    state = [rows_of(t.read(n)) for n in processing.TABLES]
    assert not processing.process(t, first, 1, verdicts, busy) and [rows_of(t.read(n)) for n in processing.TABLES] == state

    again = spark.createDataFrame([("p", 1, "CONFIRMED")], "project string, finding_id long, verdict string")
    assert processing.process(t, change(("p", "a.js", "changed", 3, [node("x", "b")], [call("x", "far")]), ("p", "b.js", "changed", 3, [node("far")], [])), 2, again)
    assert rows_of(t.read("edges").select("id")) == [("CALLS|Function:x|Function:far",)] and ("p", 1, "regressed") in status()
    assert processing.process(t, change(("p", "a.js", "deleted", 4, [], None)), 3, again.limit(0))
    assert rows_of(t.read("nodes").select("project", "id")) == [("p", "Function:far"), ("q", "Function:x")] and t.read("edges").count() == 0
    sets = {r.change_set: r for r in t.read("change_sets").collect()}
    assert (sets["p-3"].deleted_files, sets["p-3"].nodes_changed, sets["p-3"].edges_changed) == (1, 1, 1) and set(sets) == {"p-1", "q-1", "p-2", "p-3"}
    assert rows_of(t.read("transitions").select("change_set", "finding_id", "old", "new")) == [("p-1", 1, "open", "resolved"), ("p-1", 2, "resolved", "regressed"), ("p-2", 1, "resolved", "regressed"), ("q-1", 1, "open", "resolved")]
    assert processing.process(t, change().limit(0), 4, again) and len(rows_of(t.read("change_sets"))) == 4
