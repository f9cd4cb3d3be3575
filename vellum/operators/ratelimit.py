"""Rate limits over a table of hits: a sliding log, and fixed windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limiter_key(api_key: Column, address: Column, forwarded: Column | None = None, trusted: Column | bool = False) -> Column:
    """What hits are counted by: a hash of the key, or else the address, which is the first forwarded one behind a trusted
    proxy only."""
    given = F.coalesce(forwarded if forwarded is not None else F.lit(""), F.lit(""))
    behind = trusted if isinstance(trusted, Column) else F.lit(trusted)
    own = F.coalesce(F.when(behind & (given != ""), F.trim(F.substring_index(given, ",", 1))), address, F.lit("unknown"))
    return F.when(F.coalesce(api_key, F.lit("")) != "", F.substring(F.sha2(api_key, 256), 1, 16)).otherwise(F.concat(F.lit("ip:"), own))


def fixed_window(hits: DataFrame, limit: int, window_s: int) -> DataFrame:
    """hits: key, ts, event_id. Adds allowed and retry_after: every hit counts in its window, those beyond the limit are denied."""
    bucket = F.floor(F.unix_timestamp("ts") / window_s)
    nth = F.row_number().over(Window.partitionBy("key", bucket).orderBy("ts", "event_id"))
    return hits.withColumn("allowed", nth <= limit).withColumn("retry_after", F.when(~F.col("allowed"), window_s).otherwise(0))


class SlidingLog:
    """Times of the hits that were let through and lie inside the window; a denied hit leaves no trace."""

    def __init__(self, limit: int, window_s: float, times: list[float] | None = None):
        self.limit, self.window, self.times = limit, window_s, deque(times or [])

    def hit(self, now: float) -> tuple[bool, int]:
        while self.times and self.times[0] < now - self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False, max(1, int(self.window - (now - self.times[0])) + 1)
        self.times.append(now)
        return True, 0


def sliding_log(hits: DataFrame, limit: int, window_s: int) -> DataFrame:
    """hits: key, ts (timestamp), event_id. Returns key, event_id, allowed and retry_after. Rows are dealt by key and read in
    order, so a key with any number of hits needs memory for `limit` of them."""
    rows = hits.select("key", F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id").repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = object(), None
        for batch in batches:
            allowed, retry = [], []
            for key, at in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if key != last:
                    last, log = key, SlidingLog(limit, window_s)
                ok, after = log.hit(at)
                allowed.append(ok)
                retry.append(after)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), pa.array(allowed), pa.array(retry, pa.int32())], ["key", "event_id", "allowed", "retry_after"])

    kind = hits.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, event_id long, allowed boolean, retry_after int")
