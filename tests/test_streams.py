from pyspark.sql import functions as F

from nearfield.operators import metrics
from nearfield.plans import stream_queries
from nearfield.sources import collections as C
from nearfield.streaming import streams

SF = "/root/testdata/sf0.001"


def test_windowed_latency(spark):
    stream = streams.windowed_latency(stream_queries._event_stream(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latency").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT sum(n) AS n, round(sum(total), 6) AS total FROM latency").first()
    events = spark.read.parquet(f"{SF}/events.parquet").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).first()
    assert got["n"] == events["n"] and abs(got["total"] - events["total"]) < 1e-3


def test_ingest_twice_is_ingest_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, seq long, v string").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("key string, seq long, v string").parquet(source)
        streams.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r["key"]: r["v"] for r in streams.read_ingested(spark, str(tmp_path / "out")).collect()} == {"a": "y", "b": "z"}


def test_json_lines(spark):
    lines = spark.createDataFrame([('{"id":"a","text":"t","vector":[1,2],"metadata":{"k":"v"}}',), ("{broken",), ('{"text":"no id"}',), (None,)], "value string")
    good, bad = C.from_json_lines(lines)
    assert [(r["key"], r["vector"], r["metadata"]) for r in good.collect()] == [("a", [1.0, 2.0], {"k": "v"})]
    assert bad.count() == 3


def test_histogram_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([("a", 0.003), ("a", None), ("a", 9.0)], "g string, v double")
    got = {r["le"]: r["n"] for r in metrics.histogram(rows, "v", by="g").collect()}
    assert got["0.001"] == 0 and got["0.005"] == 1 and got["+Inf"] == 2
    line = metrics.prometheus(rows.limit(1), "m", F.lit(1), {"g": F.col("g")}).first()["line"]
    assert line == 'm{g="a"} 1'


def test_percentiles_are_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 5.0)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p95"], r["p99"], r["count"]) for r in metrics.latency_summary(rows, "v", "g").collect()}
    assert got == {"a": (50.0, 95.0, 99.0, 100), "b": (5.0, 5.0, 5.0, 1)}


def test_idle_buckets_expire(spark, tmp_path):
    """The state of a tenant without requests goes after a while."""
    import time

    schema = "tenant string, seq long, ts timestamp"
    rows = spark.sql("SELECT concat('t', id % 3) AS tenant, id AS seq, timestamp_seconds(1700000000 + id) AS ts FROM range(9)")
    rows.write.parquet(f"{tmp_path}/in")
    limited = streams.rate_limit(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2, idle_seconds=1.0)
    q = limited.writeStream.format("memory").queryName("idle_buckets").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        until, held = time.time() + 90, set()
        while time.time() < until and not (held and 0 in held and spark.table("idle_buckets").count() == 9):
            held |= {o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]}
            time.sleep(0.5)
        assert spark.table("idle_buckets").count() == 9 and 3 in held and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()
