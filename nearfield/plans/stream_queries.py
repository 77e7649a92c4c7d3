"""Queries that run a stream over a table to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir, table
from ..streaming import streams
from .registry import query
from .store_queries import BUCKETS


def _folder(spark, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir: str):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")


@query("SELECT user_id AS key, max(event_id) AS seq, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_ingest(spark, sf_dir):
    """Each user's last event, ingested as versions of a document."""
    changes = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type")
    path = _folder(spark, "ingest")
    streams.ingest(changes, path, _folder(spark, "ingest-state")).awaitTermination()
    return streams.read_ingested(spark, path)


def _to_table(spark, stream, mode: str, kind: str):
    """What a stateful stream puts out, as a table."""
    path = _folder(spark, kind)

    def write(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", _folder(spark, kind + "-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("n")


@query(BUCKETS)
def stream_rate_limit(spark, sf_dir):
    r = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("tenant"), F.col("event_id").alias("seq"), "ts")
    return _to_table(spark, streams.rate_limit(r, 2, expire=False), "append", "rate").drop("batch")


@query(
    """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS tenant, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN -2 ELSE 3 END AS delta FROM events),
       s AS (SELECT *, sum(delta) OVER (PARTITION BY tenant ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM o)
       SELECT tenant, CAST(max_by(s, seq) - least(0, min(s)) AS BIGINT) AS usage FROM s GROUP BY tenant"""
)
def stream_usage(spark, sf_dir):
    """Counters that never fall below zero, as streaming state."""
    ops = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("tenant"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), -2).otherwise(3).alias("delta"))
    out = _to_table(spark, streams.usage(ops), "update", "usage")
    return out.groupBy("tenant").agg(F.max_by("usage", "batch").alias("usage"))
