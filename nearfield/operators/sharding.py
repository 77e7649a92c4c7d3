"""Shards: placement, routing, resharding, failover, and the command log of the cluster's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import shard_for_key


def with_shard(docs: DataFrame, shards: int, key: str = "key") -> DataFrame:
    return docs.withColumn("shard", shard_for_key(F.col(key), shards))


def all_shards(spark: SparkSession, shards: int) -> DataFrame:
    return spark.range(shards).withColumnRenamed("id", "shard")


def placement(spark: SparkSession, shards: int, nodes: list[str], replicas: int) -> DataFrame:
    """(shard, replica, node): replica i of shard s is on node (s + i) modulo nodes; replica 0 leads."""
    nodes = sorted(nodes)
    if len(nodes) < replicas:
        raise ValueError(f"insufficient_nodes: have {len(nodes)}, need {replicas}")
    at = F.array(*[F.lit(n) for n in nodes])
    grid = all_shards(spark, shards).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return grid.withColumn("node", F.element_at(at, (F.col("shard") % len(nodes) + F.col("replica")).cast("int") % len(nodes) + 1))


def promote(replicas: Column, leader: Column) -> Column:
    """The replicas with a new leader in front."""
    return F.array_prepend(F.array_remove(replicas, leader), leader)


def fail_over(assignments: DataFrame, dead: str, nodes: list[str], replicas: int) -> DataFrame:
    """Assignments (shard, replicas, version) after a node is lost.

    The next replica leads; spare nodes, in order, fill up to the number of
    replicas; the version rises for shards that change.
    """
    alive = F.array(*[F.lit(n) for n in sorted(nodes) if n != dead])
    left = F.array_remove(F.col("replicas"), dead)
    spare = F.array_except(alive, left)
    filled = F.concat(left, F.slice(spare, 1, F.greatest(F.lit(replicas) - F.size(left), F.lit(0))))
    hit = F.array_contains("replicas", dead)
    return assignments.select("shard", F.when(hit, filled).otherwise(F.col("replicas")).alias("replicas"), (F.col("version") + hit.cast("int")).alias("version")).withColumn("leader", F.get("replicas", F.lit(0)))


def reshard(docs: DataFrame, old: int, new: int, key: str = "key") -> DataFrame:
    """(key, old_shard, new_shard) for every document."""
    if old == new:
        raise ValueError("same_shard_count")
    return docs.select(key, shard_for_key(F.col(key), old).alias("old_shard"), shard_for_key(F.col(key), new).alias("new_shard"))


def write_sharded(docs: DataFrame, path: str, shards: int, key: str = "key", mode: str = "overwrite") -> None:
    """One folder for each shard, so that a read of one key prunes all others."""
    with_shard(docs, shards, key).repartition(shards, "shard").write.mode(mode).partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, key_value, shards: int) -> DataFrame:
    """The shard that holds a key; other folders aren't listed in the scan."""
    import hashlib

    shard = int(hashlib.md5(str(key_value).encode()).hexdigest()[:8], 16) % shards
    return spark.read.parquet(path).where(F.col("shard") == shard)


def read_key(spark: SparkSession, path: str, key_value, shards: int, key: str = "key") -> DataFrame:
    """The rows of one key: one folder is read, and the comparison goes into its scan."""
    return read_shard(spark, path, key_value, shards).where(F.col(key) == F.lit(key_value)).drop("shard")


def move_shards(spark: SparkSession, path: str, to: str, old: int, new: int, key: str = "key") -> DataFrame:
    """Rewrites a sharded folder for another number of shards; returns (old_shard, new_shard, rows) as moved.

    Every row is moved, none is left behind. The old folder stays until the caller
    drops it, so readers aren't disturbed.
    """
    if old == new:
        raise ValueError("same_shard_count")
    rows = spark.read.parquet(path)
    write_sharded(rows.drop("shard"), to, new, key)
    return spark.read.parquet(to).groupBy(shard_for_key(F.col(key), old).alias("old_shard"), F.col("shard").cast("long").alias("new_shard")).agg(F.count("*").alias("rows"))


def replay_keys(log: DataFrame) -> DataFrame:
    """(key, tenant_id, created_seq) of the keys that exist after a log of (seq, op, key, tenant_id): create, delete.

    Creating a key that exists has no effect: of the creates behind the last delete the first counts.
    """
    gone = F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy("key")), F.lit(-1))
    live = log.withColumn("gone", gone).where((F.col("op") == "create") & (F.col("seq") > F.col("gone")))
    return live.groupBy("key").agg(F.min_by("tenant_id", "seq").alias("tenant_id"), F.min("seq").alias("created_seq"))


def replay_quotas(log: DataFrame) -> DataFrame:
    """(tenant_id, vectors) after a log of (seq, op, tenant_id, n): init sets the counter to 0, incr and decr change it, never below 0."""
    w = Window.partitionBy("tenant_id")
    reset = F.coalesce(F.max(F.when(F.col("op") == "init", F.col("seq"))).over(w), F.lit(-1))
    live = log.withColumn("reset", reset).where("seq > reset OR op = 'init' AND seq = reset")
    n = F.coalesce("n", F.lit(0))
    delta = F.when(F.col("op") == "incr", n).when(F.col("op") == "decr", -n).otherwise(0)
    upto = Window.partitionBy("tenant_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = live.withColumn("s", F.sum(delta).over(upto))
    return sums.groupBy("tenant_id").agg((F.max_by("s", "seq") - F.least(F.min("s"), F.lit(0))).cast("long").alias("vectors"))


def replay_collections(log: DataFrame) -> DataFrame:
    """Collections after a log of (seq, op, name, status): create, update, delete.

    Creating an existing name and changing a missing one have no effect. After
    the last effective delete, the first create makes the collection and the
    last update gives its status.
    """
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy("name"))
    live = log.withColumn("gone", F.coalesce(gone, F.lit(-1))).where(F.col("seq") > F.col("gone"))
    created = F.min(F.when(F.col("op") == "create", F.col("seq"))).over(Window.partitionBy("name"))
    live = live.withColumn("created", created).where(F.col("created").isNotNull() & (F.col("seq") >= F.col("created")) & ((F.col("op") == "update") | (F.col("seq") == F.col("created"))))
    return live.groupBy("name").agg(F.max("created").alias("created_seq"), F.max_by("status", "seq").alias("status"))


def replay_membership(log: DataFrame) -> DataFrame:
    """Each node's last state of a log of (seq, node, op): join, status changes, leave."""
    last = log.groupBy("node").agg(F.max_by("op", "seq").alias("state"), F.max("seq").alias("version"))
    return last.where("state <> 'leave'")


def silent_nodes(heartbeats: DataFrame, now: Column, most_seconds: float = 30.0) -> DataFrame:
    """(node, last, silent): when each node of (node, ts) was heard last, and whether that is longer ago than allowed."""
    last = heartbeats.groupBy("node").agg(F.max("ts").alias("last"))
    return last.withColumn("silent", now.cast("double") - F.col("last").cast("double") > F.lit(most_seconds))
