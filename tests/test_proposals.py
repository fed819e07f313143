"""Proposals about few of many subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldra.operators import proposals


def test_subjects_that_nobody_proposes_arent_broadcast(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/one")
    many = spark.read.parquet(f"{tmp_path}/one").select(F.explode(F.sequence(F.lit(1), F.lit(1_000_000))).alias("s"))
    subjects = many.select(F.lit("route").alias("kind"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("subject"), F.array(F.lit("open")).alias("signals"))
    books = spark.createDataFrame([("door", "rule", ["open"], [])], "type string, kind string, signals array<string>, requires array<string>")
    sources = spark.createDataFrame([("open", "route")], "signal string, source string")
    allowed = many.select(F.col("s").cast("long").alias("run"), F.lit("door").alias("type"))
    no = F.array().cast("array<string>")
    calls = many.select(F.col("s").cast("long").alias("run"), F.lit(1).alias("seq"), F.lit("getRoute").alias("tool"), F.lit(True).alias("ok"), F.lit("s7").alias("route"), no.alias("named"))
    rows = [(1, 5, 1, "door", "route", "s7", [1]), (2, 5, 2, "door", "route", "s7", [1, 1]), (3, 6, 3, "door", "route", "s0", [1]), (4, 7, 4, "door", "route", "s8", [1]), (5, 8, 5, "door", "route", "s7", [2])]
    given = spark.createDataFrame(rows, "id long, run long, seq long, type string, kind string, subject string, evidence array<int>")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "20m")
    try:
        found = {r.id: (r.code, r.detail) for r in proposals.judged(given, books, sources, allowed, subjects, calls).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert found == {
        1: (None, None),
        2: ("duplicate", "proposed before"),
        3: ("not_found", "no such subject"),
        4: ("invalid_evidence", "none is about the subject"),
        5: ("invalid_evidence", "#2 is not a call of this run"),
    }
