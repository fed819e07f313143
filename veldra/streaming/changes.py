"""Change streams: bursts, replays, status per key, and a table kept up to date.

Each operator keeps a bounded state per key, and each holds with late, repeated and disordered events: bursts and replays
by watermark, statuses because their state doesn't depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from veldra.operators.store import newest
from veldra.sources.landing import fresh


def bursts(changes: DataFrame, key: str, ts: str, kind: str, order: str, gap: str = "300 milliseconds", late: str = "0 seconds") -> DataFrame:
    """(key, began, ended, kind, n): events of a key not further apart than ``gap``; the last event of a burst wins."""
    return (
        changes.withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gap).alias("burst"))
        .agg(F.max_by(kind, F.struct(ts, order)).alias(kind), F.count("*").alias("n"))
        .select(key, F.col("burst.start").alias("began"), F.col("burst.end").alias("ended"), kind, "n")
    )


def replayed(steps: DataFrame, keys: list[str], ts: str, late: str = "1 minute") -> DataFrame:
    """Each step once, though a replay and the live tail overlap."""
    return steps.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def statuses(events: DataFrame, key: str) -> DataFrame:
    """(key, status, steps) whenever a key's verdicts change; events: (key, ts, event_id, verdict).

    The state is the number of events and the last two decisive verdicts with their places, whatever the history's length.
    """
    decisive = ("CONFIRMED", "REJECTED")

    def fold(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, last = 0, []
        if state.exists:
            steps, *flat = state.get
            last = [tuple(flat[i : i + 3]) for i in (0, 3) if flat[i + 2]]
        for pdf in chunks:
            steps += len(pdf)
            two = pdf[pdf["verdict"].isin(decisive)].sort_values(["ts", "event_id"]).tail(2)
            last = sorted([*last, *((t.value, int(i), v) for t, i, v in zip(two["ts"], two["event_id"], two["verdict"], strict=True))])[-2:]
        after, before = (last[-1] if last else (0, 0, "")), (last[-2] if len(last) > 1 else (0, 0, ""))
        state.update((steps, *after, *before))
        status = "resolved" if after[2] == "REJECTED" else "regressed" if after[2] and before[2] == "REJECTED" else "open"
        yield pd.DataFrame({key: [keys[0]], "status": [status], "steps": [steps]})

    return events.groupBy(key).applyInPandasWithState(
        fold, f"{key} long, status string, steps long", "steps long, t1 long, i1 long, v1 string, t2 long, i2 long, v2 string", "update", GroupStateTimeout.NoTimeout
    )


def kept_statuses(events: DataFrame, key: str, every: int = 8) -> DataFrame:
    """(key, status, steps) of each key after all events that are there, as ``statuses`` would say it last; events as there.

    A batch writes what ``statuses`` has as its state for the keys it touches, made by plain aggregation; states of several
    batches add up. A base and a log are kept as in ``maintained``.
    """
    schema = events.select(key, F.lit(0).cast("long").alias("steps"), F.array(F.struct("ts", "event_id", "verdict")).alias("last")).schema

    def summed(states: DataFrame) -> DataFrame:
        """The states of a key as one: the last two decisive verdicts of all, and the number of steps."""
        each = states.select(key, F.explode("last").alias("one"))
        nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("one.ts"), F.desc("one.event_id"), F.desc("one.verdict")))
        two = each.withColumn("nth", nth).where("nth <= 2").groupBy(key).agg(F.sort_array(F.collect_list("one")).alias("last"))
        steps = states.groupBy(key).agg(F.sum("steps").alias("steps"))
        return steps.join(two.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "steps", F.coalesce("last", F.array().cast(schema["last"].dataType)).alias("last"))

    def state_of(rows: DataFrame) -> DataFrame:
        one = F.struct("ts", "event_id", "verdict")
        decisive = F.col("verdict").isin("CONFIRMED", "REJECTED")
        return summed(rows.select(key, F.lit(1).cast("long").alias("steps"), F.when(decisive, F.array(one)).otherwise(F.array().cast(schema["last"].dataType)).alias("last")))

    last = F.col("last")
    after, before = F.get(last, F.size(last) - 1)["verdict"], F.get(last, F.size(last) - 2)["verdict"]
    status = F.when(after == "REJECTED", "resolved").when((after == "CONFIRMED") & (before == "REJECTED"), "regressed").otherwise("open")
    return _logged(events, "statuses", schema, state_of, summed, every).select(key, status.alias("status"), "steps")


def maintained(changes: DataFrame, key: str, order: list[str], every: int = 8) -> DataFrame:
    """The newest change of each key, kept as a base and a log of the micro-batches since.

    A batch writes its own rows; each ``every``-th one also merges base and log into a new base. A batch overwrites its own
    folders only, so a repeated batch gives the same table. Deletions stay as marks, so a late older event can't bring a key back.
    """
    order_by = [F.desc(c) for c in order]
    return _logged(changes, "maintained", changes.schema, lambda rows: newest(rows, [key], order_by), lambda rows: newest(rows, [key], order_by), every)


def _logged(stream: DataFrame, name: str, schema: StructType, own: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame], every: int) -> DataFrame:
    """What all micro-batches of a stream come to: own makes a batch's rows, merged puts those of several together."""
    path = fresh(stream.sparkSession, name)

    def table(spark: SparkSession, batch: int) -> DataFrame:
        base = batch // every * every - 1  # the last batch that wrote a base before this one
        parts = [f"{path}/log/{i}" for i in range(base + 1, batch + 1)] + ([f"{path}/base/{base}"] if base >= 0 else [])
        return merged(spark.read.schema(schema).parquet(*parts))

    def apply(rows: DataFrame, batch: int) -> None:
        own(rows).write.mode("overwrite").parquet(f"{path}/log/{batch}")
        if batch % every == every - 1:
            table(rows.sparkSession, batch).write.mode("overwrite").parquet(f"{path}/base/{batch}")

    run = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(apply).start()
    run.awaitTermination()
    if not run.lastProgress:
        return stream.sparkSession.createDataFrame([], schema)
    return table(stream.sparkSession, run.lastProgress["batchId"])
