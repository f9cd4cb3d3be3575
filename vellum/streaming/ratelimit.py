"""Rate limits on a stream of hits."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.operators.ratelimit import SlidingLog


def sliding_log_stream(hits: DataFrame, limit: int, window_s: int, forget: bool = False) -> DataFrame:
    """hits: a stream of key, ts, event_id. As operators.ratelimit.sliding_log(), with each key's log kept in the state store;
    a key's hits of one trigger are read in order of time. A log holds at most `limit` times; late hits are judged on arrival.

    forget, for streams that run on: a key that has been idle for a window, by the clock, is forgotten, since all its hits lie
    outside the window then; ts must be the time of arrival. (A query that is to end by itself would wait for such keys.)"""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "event_id"], ignore_index=True)
        log = SlidingLog(limit, window_s, json.loads(state.get[0]) if state.exists else None)
        got = [log.hit(t) for t in rows["at"].tolist()]
        state.update((json.dumps(list(log.times)),))
        if forget:
            state.setTimeoutDuration(int(window_s * 1000) + 1000)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "allowed": [a for a, _ in got], "retry_after": [r for _, r in got]})

    rows = hits.select("key", F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id")
    kind = hits.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, event_id long, allowed boolean, retry_after int", "log string", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def window_counts_stream(hits: DataFrame, window_s: int, late_s: int = 600) -> DataFrame:
    """hits: a stream of key, ts. Hits of each key and fixed window, emitted when the watermark has passed."""
    timed = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_s} seconds")
    return timed.groupBy("key", F.window("ts", f"{window_s} seconds")).agg(F.count(F.lit(1)).alias("hits"))
