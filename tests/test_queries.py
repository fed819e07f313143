"""Every registered query over the star schema against DuckDB, row by row; the entry point's contract."""

from __future__ import annotations

import re

import pytest
from compare import assert_same

import __spark_entry__
from veldra.plans import queries as plan_queries


@pytest.mark.parametrize("name", sorted(plan_queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(plan_queries.QUERIES[name](spark, sf_dir), plan_queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(plan_queries.QUERIES) - set(plan_queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert plan_queries.QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns and found.count() >= 0


def test_each_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_traversals_of_all_rows_equal_brute_force(spark, sf_dir):
    q = plan_queries.QUERIES
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).distinct().collect()]
    owner, used = dict(read("orders", "o_orderkey", "o_custkey")), read("lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    parts, customers = {p for (p,) in read("part", "p_partkey")}, dict(read("customer", "c_custkey", "c_nationkey"))
    reached = {(f"Part:{p}", f"Customer:{owner[o]}") for o, p, _ in used}
    assert {(r.target, r.id) for r in q["routes_reaching"](spark, sf_dir).collect()} == reached
    goals = {f"Part:{p}" for o, p, _ in used if customers[owner[o]] == 2} & {f"Part:{p}" for p in parts}
    assert {r.goal for r in q["bfs_path"](spark, sf_dir).collect()} == goals
    below = {(f"Customer:{c}", f"Customer:{c}", 0) for c in customers} | {(f"Customer:{c}", f"Order:{o}", 1) for o, c in owner.items()}
    below |= {(f"Customer:{owner[o]}", x, 2) for o, p, s in used for x in (f"Part:{p}", f"Supplier:{s}")}
    assert {tuple(r) for r in q["closure_depth3"](spark, sf_dir).select("start", "id", "depth").collect()} == below
    assert {(r.start, r.id) for r in q["neighbors_in"](spark, sf_dir).collect()} == {(f"Supplier:{s}", f"Order:{o}") for o, _, s in used}


def pairs_plain(text):
    """(line, name, value) of each separator that stands between a name and a value."""
    for n, line in enumerate((text or "").split("\n"), 1):
        for at, c in enumerate(line):
            if c in ":=":
                name = re.search(r"[A-Za-z0-9_-]*$", line[:at].rstrip(" \t\r\f\v"))[0].lstrip("0123456789-")
                value = re.match(r"[ \t\r\f\v]*[\"']?([A-Za-z0-9+/_-]{8,})", line[at + 1 :])
                if name and value:
                    yield n, name, value[1]


def test_all_secrets_of_a_line_are_found(spark, sf_dir, tmp_path):
    odd = [
        None,
        "",
        "user: alice_in_town password=hunter2hunter2 api_key = 'AKIA12345678'",
        "x\npassword: first_one1 token: second_one2\ny",
        "note: password=swallowed1",
        "password: my_token=abcdefghij",
        "9pwd=12345678 salt::=12345678 token=short token=12345678",
    ]
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    spark.createDataFrame(list(enumerate(odd + real)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    secret = re.compile("secret|passw(or)?d|pwd|token|api[_-]?key|apikey|private[_-]?key|credential|salt|auth[_-]?key")
    want = [(i, n, name, value[:2] + "***") for i, t in enumerate(odd + real) for n, name, value in pairs_plain(t) if secret.search(name.lower())]
    rows = plan_queries.QUERIES["secret_line_scan"](spark, str(tmp_path)).select("doc_id", "line", "name", "preview").collect()
    assert sorted(tuple(r) for r in rows) == sorted(want)
    assert [sum(r.doc_id == i for r in rows) for i in range(len(odd))] == [0, 0, 2, 2, 1, 2, 2]


def test_links_stand_on_their_own_lines(spark, tmp_path):
    pages = [(1, '<a href="/a">\n\n<a href="/b"><a href="/c\nd">\n<a href="/e">\n'), (2, 'href="/f"'), (3, "none"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = plan_queries.QUERIES["link_scan"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.line, r.link) for r in rows) == [(1, 1, "/a"), (1, 3, "/b"), (1, 3, "/c\nd"), (1, 5, "/e"), (2, 1, "/f")]
