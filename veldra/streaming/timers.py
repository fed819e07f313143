"""Keyed streams with timers in event time: heartbeats of keys in which nothing happens, and steps put back in order.

Both decide only what the watermark has passed, so the answer doesn't depend on the order in which events arrive, nor on
how they fall into micro-batches; events later than ``late`` are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _millis(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64") // 1000).tolist()


def heartbeats(changes: DataFrame, key: str, ts: str, every_ms: int, late: str) -> DataFrame:
    """(key, began, ended): each window of ``every_ms`` after a key's first one that ended without a change of it.

    The state is the next window to be decided and those with changes that aren't decided yet, as many as fit into the lateness.
    """

    def beat(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, text = state.get if state.exists else (-1, "[]")
        seen = set(json.loads(text))
        for pdf in chunks:
            seen.update(m // every_ms for m in _millis(pdf[ts]))
        # nothing is decided before the watermark, so an earlier first change still counts
        first = min([*seen, first] if first >= 0 else seen)
        watermark, idle = state.getCurrentWatermarkMs() // every_ms, []
        while first < watermark:
            if first not in seen:
                idle.append(first)
            seen.discard(first)
            first += 1
        state.update((first, json.dumps(sorted(s for s in seen if s >= first))))
        state.setTimeoutTimestamp((first + 1) * every_ms)
        yield pd.DataFrame({key: [keys[0]] * len(idle), "began": [w * every_ms for w in idle], "ended": [(w + 1) * every_ms for w in idle]})

    made = changes.select(key, ts).withWatermark(ts, late).groupBy(key)
    kind = changes.schema[key].dataType.simpleString()
    return made.applyInPandasWithState(beat, f"{key} {kind}, began long, ended long", "first long, seen string", "append", GroupStateTimeout.EventTimeTimeout)


def ordered(steps: DataFrame, key: str, seq: str, ts: str, patience_ms: int, late: str, first: int = 1) -> DataFrame:
    """(key, place, seq, kind): the steps of each key by number, each once, however they arrive; ``place`` counts what a key has put out.

    A step waits for those before it. Once the watermark has passed the oldest waiting step by ``patience_ms``, what is missing
    before it is put out as ``gap``, and what comes for a number that is past is dropped. The state is what waits.
    """

    def sort(keys: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_, place, text = state.get if state.exists else (first, 0, "{}")
        waiting = {int(n): m for n, m in json.loads(text).items()}
        for pdf in chunks:
            for n, m in zip(pdf[seq].tolist(), _millis(pdf[ts]), strict=True):
                if n >= next_:
                    waiting[n] = min(m, waiting.get(n, m))
        out, watermark = [], state.getCurrentWatermarkMs()
        while waiting:
            if next_ in waiting:
                del waiting[next_]
                out.append((next_, "step"))
            elif min(waiting.values()) + patience_ms <= watermark:
                out.append((next_, "gap"))
            else:
                break
            next_ += 1
        state.update((next_, place + len(out), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting.values()) + patience_ms, watermark + 1))
        yield pd.DataFrame({key: [keys[0]] * len(out), "place": range(place + 1, place + len(out) + 1), "seq": [n for n, _ in out], "kind": [k for _, k in out]})

    made = steps.select(key, F.col(seq).cast("long").alias(seq), ts).withWatermark(ts, late).groupBy(key)
    kind = steps.schema[key].dataType.simpleString()
    return made.applyInPandasWithState(sort, f"{key} {kind}, place long, seq long, kind string", "next long, place long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
