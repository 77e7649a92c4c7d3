"""Structured Streaming: versioned ingest, rate limits with state, usage counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import metrics, store
from ..operators.tenancy import bucket_step


def ingest(changes: DataFrame, path: str, checkpoint: str, *, key: str = "key", version: str = "seq"):
    """Appends each micro-batch's latest rows to path. A batch that is run again replaces its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        store.latest(batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, path: str, *, key: str = "key", version: str = "seq") -> DataFrame:
    return store.latest(spark.read.parquet(path).drop("batch"), key, version)


def rate_limit(requests: DataFrame, rpm: int, *, idle_seconds: float = 300.0, expire: bool = True) -> DataFrame:
    """A token bucket for each tenant over a stream of (tenant, seq, ts); output (tenant, seq, allowed, remaining).

    The bucket is state. A bucket idle for longer than idle_seconds of the
    requests' own time starts anew; with expire its state is dropped after as
    long without requests, too. (A query that ends with its input sets expire to
    False: waiting for timeouts would keep it running.) Inside a micro-batch
    requests are taken in order of (ts, seq).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        now = state.get if state.exists else None
        out = []
        for seq, ts in zip(rows["seq"], rows["ts"], strict=True):
            if now is not None and ts.timestamp() - now[1] > idle_seconds:
                now = None
            now, ok, left = bucket_step(now, ts.timestamp(), rpm)
            out.append((key[0], seq, ok, left))
        state.update(now)
        if expire:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame(out, columns=["tenant", "seq", "allowed", "remaining"])

    return requests.groupBy("tenant").applyInPandasWithState(step, "tenant string, seq long, allowed boolean, remaining int", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def usage(operations: DataFrame) -> DataFrame:
    """Each tenant's counter of a stream of (tenant, seq, delta), never below 0."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for d in pd.concat(list(frames)).sort_values("seq", kind="stable")["delta"]:
            n = max(0, n + int(d))
        state.update((n,))
        yield pd.DataFrame([(key[0], n)], columns=["tenant", "usage"])

    return operations.groupBy("tenant").applyInPandasWithState(step, "tenant string, usage long", "n long", "update", GroupStateTimeout.NoTimeout)


def windowed_latency(events: DataFrame, *, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and cumulative latency buckets by event-time window; late events beyond the watermark are dropped."""
    cells = [F.sum(F.when(F.col("value") <= b, 1).otherwise(0)).alias(f"le_{str(b).replace('.', '_')}") for b in metrics.SEARCH_BUCKETS]
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"), *cells)
