"""Joins that are no plain equi-joins against brute force."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from veldra.operators import joins

USES = "scope string, use_id int, use_path string, use_order int, dynamic boolean"
ROUTES = "scope string, route_id int, route_path string, route_order int"


def fits(prefix, path):
    a, b = ([s for s in p.split("/") if s] for p in (prefix, path))
    return len(a) <= len(b) and all(x == y or x.startswith(":") or y.startswith(":") for x, y in zip(a, b))


def test_prefixes_by_segments_equal_brute_force(spark):
    rng = random.Random(4)
    path = lambda: rng.choice(["", "/"]) + "/".join(rng.choice(["a", "b", ":p", ":q", "", "c*"]) for _ in range(rng.randrange(6)))
    uses = [(rng.choice("xy"), i, path() if i % 20 else None, rng.randrange(50), rng.choice([True, False, None])) for i in range(120)]
    routes = [(rng.choice("xyz"), i, path() if i % 20 else None, rng.randrange(50)) for i in range(120)]
    want = sorted((u[1], r[1], bool(u[4])) for u in uses for r in routes if u[0] == r[0] and None not in (u[2], r[2]) and u[3] < r[3] and fits(u[2], r[2]))
    found = joins.prefix_segments(spark.createDataFrame(uses, USES), spark.createDataFrame(routes, ROUTES), "scope")
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 1000


def test_many_paths_of_one_scope_arent_compared_pair_by_pair(spark):
    n = 20_000  # 400 million pairs
    ids = spark.range(n)
    uses = ids.select(F.lit("s").alias("scope"), F.col("id").alias("use_id"), F.concat(F.lit("/c/"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "/:x").otherwise("")).alias("use_path"), F.lit(0).alias("use_order"), F.lit(False).alias("dynamic"))
    routes = ids.select(F.lit("s").alias("scope"), F.col("id").alias("route_id"), F.concat(F.when(F.col("id") % 3 == 0, "/:y/").otherwise("/c/"), F.col("id").cast("string"), F.lit("/z")).alias("route_path"), F.lit(1).alias("route_order"))
    began = time.perf_counter()
    assert joins.prefix_segments(uses, routes, "scope").where("use_id = route_id").count() == n
    assert time.perf_counter() - began < 60
