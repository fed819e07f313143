"""Statuses kept over several micro-batches against the whole history in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veldra.streaming import changes


@pytest.mark.parametrize("every", [1, 2, 8])
def test_statuses_of_disordered_batches_equal_the_history(spark, tmp_path, every):
    rng = random.Random(every)
    rows = [(rng.randrange(40), rng.randrange(100), i, rng.choice(["CONFIRMED", "REJECTED", "INCONCLUSIVE", None])) for i in range(400)]
    for i in range(5):
        part = spark.createDataFrame(rows[i::5], "finding long, t long, event_id long, verdict string").withColumn("ts", F.timestamp_seconds("t"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("finding long, t long, event_id long, verdict string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events").drop("t")
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == k)
        said = [v for _, _, v in mine if v in ("CONFIRMED", "REJECTED")]
        status = "resolved" if said[-1:] == ["REJECTED"] else "regressed" if said[-2:] == ["REJECTED", "CONFIRMED"] else "open"
        want[k] = (status, len(mine))
    found = changes.kept_statuses(stream, "finding", every)
    assert {r.finding: (r.status, r.steps) for r in found.collect()} == want and len(want) == 40
