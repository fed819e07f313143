"""Odd rows of index records, rule documents, runs and names."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from veldra.functions import scalars as S
from veldra.operators import records, runs


def test_locks(spark):
    at = lambda s: None if s is None else datetime.fromtimestamp(s, UTC)
    rows = [
        ("p", 0, at(0), "a", False, "acquired", "a"),
        ("p", 1, at(599), "b", False, "refused", "a"),
        ("p", 2, at(599), "b", True, "ignored", "a"),
        ("p", 3, at(600), "b", None, "acquired", "b"),
        ("p", 4, at(601), "a", True, "ignored", "b"),
        ("p", 5, at(602), "b", True, "released", None),
        ("p", 6, at(602), "b", True, "ignored", None),
        ("p", 7, None, "c", False, "ignored", None),
        ("p", 8, at(603), None, False, "ignored", None),
        ("p", 9, at(603), "c", False, "acquired", "c"),
        ("q", 0, at(603), "c", True, "ignored", None),
        ("q", 1, at(604), "d", False, "acquired", "d"),
    ]
    schema = "project string, n int, at timestamp, run string, gone boolean"
    frame = spark.createDataFrame([r[:5] for r in rows] + [(None, 0, at(0), "a", False)], schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # the state passes from batch to batch
    try:
        made = runs.locked(frame, "project", ["n"], "at", "run", "gone").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.project, r.n, r.outcome, r.holder or "") for r in made) == [(r[0], r[1], r[5], r[6] or "") for r in rows]
    assert runs.locked(frame.limit(0), "project", ["n"], "at", "run", "gone").count() == 0


def test_names(spark):
    nodes = spark.createDataFrame([(i, "Same") for i in range(12)] + [(0, "Same"), (20, "one"), (21, None)], "id int, name string")
    asked = spark.createDataFrame([(" sAme ",), ("ONE",), ("one",), ("",), (None,), ("one",)], "asked string")
    found = {r.asked: (r.status, r.id, r.candidates) for r in runs.resolved(asked, nodes).collect()}
    assert found == {" sAme ": ("ambiguous", None, list(range(10))), "ONE": ("found", 20, None), "one": ("found", 20, None), "": ("not_found", None, None), None: ("not_found", None, None)}
    none = spark.createDataFrame([], "project string, name string, status string, indexed_at timestamp")
    assert {(r.asked, r.project) for r in runs.projects_named(asked, none).collect()} == {(a, a) for a in (" sAme ", "ONE", "one", "", None)}


def test_requests_of_one_key_are_checked_once(spark):
    schema = "id int, status string, template string, kind string, subject string, type string, nodes array<string>"
    wanted = "verification-requested"
    requests = spark.createDataFrame([(3, wanted, "t", "route", "r", "x", ["b", "a"]), (2, wanted, "t", "route", "r", "x", ["a", "b"]), (1, "proposed", "t", "route", "r", "x", ["a"]), (4, wanted, "t", "jwt", "r", "x", ["a"])], schema)
    results = spark.createDataFrame([(2, "CONFIRMED"), (4, "CONFIRMED")], "id int, result string")
    known = spark.createDataFrame([("f2", "x", ["b", "a"]), ("f1", "x", ["a", "b"]), ("f0", "x", ["a", "b", "c"])], "finding string, type string, nodes array<string>")
    made = lambda *on: sorted(tuple(r) for r in runs.drained(requests, ["id"], results, known, *on).select("id", "result", "reason", "finding").collect())
    assert made(True, True) == [(2, "CONFIRMED", None, "f1"), (4, "CONFIRMED", None, "new")]
    assert made(False, True) == [(i, "INCONCLUSIVE", "verification disabled", None) for i in (2, 4)]
    kinds = spark.createDataFrame([("jwt", 7), ("jwt", None), ("chain", None), ("other", None), (None, None)], "k string, line int")
    keys = [r.x for r in kinds.select(runs.subject_key(F.col("k"), F.lit("r"), F.lit("f"), F.col("line"), F.lit("s"), F.array(F.lit("b"), F.lit("a"))).alias("x")).collect()]
    assert keys == ["jwt:f:7", "jwt:f:", "chain:a,b", None, None]


def test_sections(spark):
    bodies = [(1, "a\n## One\n x\n\n ```\n## no\n```\ny\n## Two \n"), (2, None), (3, ""), (4, "## One\n```\n## lost"), (5, "##No\n### no\n## \n## Z")]
    made = records.sections(spark.createDataFrame(bodies, "id int, body string"), "id", "body")
    assert sorted((r.id, r.pos, r.name, r.text) for r in made.collect()) == [(1, 1, "One", "x\n\n ```\n## no\n```\ny"), (1, 2, "Two", ""), (4, 1, "One", "```\n## lost"), (5, 1, "Z", "")]
    bad = {r.id: r.problem for r in records.section_problems(made, "id", ["One"], 5).collect()}
    assert bad == {1: "sections: One | Two", 5: "sections: Z"}


def test_odd_records(spark):
    files = spark.createDataFrame([("p", "indexed", 2), ("p", "odd", 5), ("p", None, 1), ("q", "recorded", None)], "project string, status string, routes int")
    assert sorted(tuple(r) for r in records.file_stats(files, ["routes"]).collect()) == [("p", 3, 1, 0, 0, 2, 2), ("q", 1, 0, 1, 0, 0, 0)]
    walked = spark.createDataFrame([("p", "a", "h", "server", "extract"), ("p", "b", None, "server", "extract"), ("p", "c", "h", "server", "skip")], "project string, path string, hash string, kind string, action string")
    before = spark.createDataFrame([("p", x, "h", "server", 1) for x in "abca"], "project string, path string, hash string, kind string, version int")
    assert sorted((r.path, r.reused) for r in records.reused(walked, before, 1).collect()) == [("a", True), ("b", False), ("c", False)]
    names = spark.createDataFrame([("f", "g", 2, 1), ("f", "g", 1, 5), ("f", None, 3, 1), ("f", "", 4, 1)], "file string, name string, line int, col int")
    assert sorted(r.unique for r in records.named_apart(names).collect()) == ["anon@3:1", "anon@4:1", "g", "g@2:1"]
    text = spark.createDataFrame([(" a  'my Password x'\tb",), ("z" * 121,), ("",), (None,)], "t string")
    assert [r.x for r in text.select(S.masked_text("t").alias("x")).collect()] == ["a '***' b", "z" * 119 + "…", "", None]
    words = spark.createDataFrame([(["react-dom", "typescript"],), ([],), (None,)], "n array<string>")
    assert [r.x for r in words.select(records.tags(F.col("n")).alias("x")).collect()] == [["React", "TypeScript"], ["Node.js"], ["Express", "Node.js", "MongoDB"]]


def test_front_matter_and_rule_documents(spark):
    from veldra.operators import records

    texts = {
        "null": None,
        "plain": "no block\n---\nx: 1",
        "empty": "---\n---\nbody",
        "crlf": "---\r\na: 1\r\nb: 'x # y'\r\n---\r\nbody\r\n",
        "lists": "---\nflow: [a, \"b, c\" , d]\nbelow:\n- x\n  - 'y'\nlast: \n---",
        "comment": "---\n# note\n\nkey: value # why\nurl: http://x/y#z\n---\nrest\n---\nmore",
        "open": "---\na: 1\n",
        "odd": "---\nno value here\n---\n",
        "twice": "---\na: 1\na: 2\n---\n",
    }
    made = records.front_matter(spark.createDataFrame(list(texts.items()), "name string, text string"), "name", "text")
    got = {r.name: (r.meta, r.body, r.meta_problem) for r in made.collect()}
    assert got["null"] == ({}, "", None) and got["plain"] == ({}, texts["plain"], None) and got["empty"] == ({}, "body", None)
    assert got["crlf"] == ({"a": "1", "b": "x # y"}, "body\n", None)
    assert got["lists"][0] == {"flow": '["a","\\"b","c\\"","d"]', "below": '["x","y"]', "last": ""}
    assert got["comment"] == ({"key": "value", "url": "http://x/y#z"}, "rest\n---\nmore", None)
    assert [got[n][2] for n in ("open", "odd", "twice")] == ["front matter never ends", "no name and value: no value here", "given twice: a"]
    none = made.limit(0)
    good, bad = records.rule_documents(none, "name", "text", {"rule": ["A"]})
    assert good.count() == bad.count() == 0
    one = spark.createDataFrame([("a", 1, "A", "t"), ("a", 2, "B", "u")], "file string, pos long, name string, text string")
    assert [r.name for r in records.chosen_sections(one, ["B"]).collect()] == ["B"] and records.chosen_sections(one).count() == 2
