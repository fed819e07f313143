"""Call trees under a budget against whole trees cut afterwards."""

from __future__ import annotations

import random

import pytest

from veldra.operators import traverse


def whole(edges, leaves, start, depth):
    out = []

    def visit(path, kind, cycle):
        out.append((path, kind, len(path) - 1, cycle))
        if kind == "function" and not cycle and len(path) <= depth:
            for n in {b for a, b in edges if a == path[-1]}:
                visit((*path, n), "function", n in path)
            for n, k in {(b, k) for a, b, k in leaves if a == path[-1]}:
                visit((*path, n), k, False)

    visit((start,), "function", False)
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 2, 3, 4, 5, 6, 7, 11, 40, 10_000, None])
def test_trees_equal_whole_trees_cut(spark, cap):
    rng = random.Random(cap or 0)
    names = "abcdefgh"
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(22)] + [("hub", f"n{i:03}") for i in range(60)] + [("a", "hub"), ("e", "e")]
    leaves = [(rng.choice(names), f"m{i % 4}", rng.choice(["model", "dependency"])) for i in range(15)] + [("a", "b", "model")]
    starts = [*names, "hub", "nowhere"]
    found = traverse.call_tree(
        spark.createDataFrame(edges * 2, "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "start string"), 4, cap, spark.createDataFrame(leaves, "id string, leaf string, kind string")
    ).collect()
    for s in starts:
        want = whole(edges, leaves, s, 4)
        got = sorted((tuple(r.path), r.kind, r.depth, r.cycle) for r in found if r.start == s)
        assert got == (want if cap is None else want[:cap])
        assert {r.truncated for r in found if r.start == s} == {cap is not None and len(want) > cap}


@pytest.mark.parametrize("cap", [3, 9, 30, None])
def test_trees_of_starts_that_nothing_calls(spark, cap):
    rng = random.Random(cap)
    below = [f"n{i}" for i in range(12)]
    edges = [(f"h{i}", rng.choice(below)) for i in range(9) for _ in range(3)] + [(rng.choice(below), rng.choice(below)) for _ in range(16)]
    leaves = [(rng.choice(["h1", "h2", *below]), rng.choice([*below, "m"]), rng.choice(["model", "dependency", "function "])) for _ in range(30)]
    starts = [f"h{i}" for i in range(10)] + below[:4]
    found = traverse.call_tree(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in starts], "start string"), 4, cap, spark.createDataFrame(leaves, "id string, leaf string, kind string"))
    rows = found.collect()
    for s in starts:
        want = whole(edges, leaves, s, 4)
        assert sorted((tuple(r.path), r.kind, r.depth, r.cycle) for r in rows if r.start == s) == (want if cap is None else want[:cap])
        assert {(r.truncated, r.id == r.path[-1]) for r in rows if r.start == s} == {(cap is not None and len(want) > cap, True)}


def test_trees_below_many_callers_are_made_once(spark, monkeypatch):
    """A thousand starts call the head of one chain: what is kept on the way doesn't hold its tree for each of them."""
    kept = []
    real = traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    edges = [(f"h{i}", "n0") for i in range(1000)] + [(f"n{i}", f"n{i + 1}") for i in range(6)]
    found = traverse.call_tree(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"h{i}",) for i in range(1000)], "start string"), 6)
    assert found.count() == 7000 and sum(df.count() for df in kept) < 6000
