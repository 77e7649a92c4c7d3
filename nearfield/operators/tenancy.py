"""Tenants: keys, prefixes, quotas, token buckets and the gateway's chain of checks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import tenant_prefix

#: Limits where a key sets none.
DEFAULTS = {"rpm_limit": 100, "max_vectors": 100_000, "max_collections": 10, "max_storage_mb": 1024}


def collection_name(tenant: Column, name: Column) -> Column:
    return F.concat(tenant_prefix(tenant), name)


def owned(collections: DataFrame, tenant: str, name: str = "name") -> DataFrame:
    """A tenant's collections under the names it knows; the bare prefix isn't one."""
    p = tenant_prefix(F.lit(tenant))
    return collections.where(F.startswith(F.col(name), p) & (F.length(name) > F.length(p))).withColumn("own_name", F.expr(f"substring({name}, length({_sql_prefix(tenant)}) + 1)"))


def _sql_prefix(tenant: str) -> str:
    quoted = tenant.replace("\\", "\\\\").replace("'", "\\'")
    return f"concat_ws('_', substring(md5(cast('{quoted}' as binary)), 1, 4), '{quoted}', '')"


def list_keys(keys: DataFrame, tenant: str | None = None) -> DataFrame:
    """Keys by their first twelve characters only."""
    rows = keys.where(F.col("tenant_id") == tenant) if tenant is not None else keys
    return rows.select(F.substring("key", 1, 12).alias("key_prefix"), "tenant_id", F.coalesce("rpm_limit", F.lit(DEFAULTS["rpm_limit"])).alias("rpm_limit"))


def quota_checks(operations: DataFrame, limit: int | None, *, tenant: str = "tenant", order: str = "seq", amount: str = "n") -> DataFrame:
    """(tenant, seq, used, allowed): whether a tenant's use stays within the limit (none: unlimited), and its use after that.

    A refused operation uses nothing, so a smaller one after it may pass. What
    passes depends on all before it: a tenant's rows are streamed in order with
    the use as the only state. Tenants share nothing, so they run side by side.
    A null amount is none.
    """
    rows = operations.select(F.col(tenant).alias("tenant"), F.col(order).alias("seq"), F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("n"))
    ordered = rows.repartition("tenant").sortWithinPartitions("tenant", "seq")
    schema = T.StructType([rows.schema["tenant"], rows.schema["seq"], T.StructField("used", T.LongType()), T.StructField("allowed", T.BooleanType())])

    def run(batches) -> Iterator:
        import pyarrow as pa

        now, used = object(), 0
        for b in batches:
            after, passed = [], []
            for who, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if who != now:
                    now, used = who, 0
                ok = limit is None or used + n <= limit
                used += n if ok else 0
                after.append(used)
                passed.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(after, pa.int64()), pa.array(passed, pa.bool_())], names=schema.names)

    return ordered.mapInArrow(run, schema)


def clamped_usage(operations: DataFrame, *, tenant: str = "tenant", order: str = "seq", delta: str = "delta") -> DataFrame:
    """Each tenant's counter after all changes, never below 0 on the way.

    The counter after step t is S_t - min(0, least S up to t), S being the plain
    running sum, so windows give it without a fold.
    """
    w = Window.partitionBy(tenant).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = operations.withColumn("s", F.sum(delta).over(w))
    low = s.withColumn("low", F.least(F.min("s").over(w), F.lit(0)))
    return low.withColumn("usage", F.col("s") - F.col("low")).drop("s", "low")


def bucket_step(state: tuple[float, float] | None, now: float, rpm: int) -> tuple[tuple[float, float], bool, int]:
    """One request against a bucket (tokens, last refill): new state, allowed, tokens left.

    A new bucket is full less the request. A refused request leaves the state as
    it was, so nothing of the refill is lost.
    """
    if state is None:
        return (float(rpm - 1), now), True, rpm - 1
    tokens, last = state
    tokens = min(float(rpm), tokens + (now - last) * rpm / 60.0)
    if tokens >= 1.0:
        return (tokens - 1.0, now), True, int(tokens - 1.0)
    return state, False, 0


def token_bucket(requests: DataFrame, rpm: int, *, tenant: str = "tenant", time: str = "ts", order: str = "seq", idle_seconds: float = 300.0) -> DataFrame:
    """(tenant, seq, allowed, remaining) for each request, in order of (time, seq).

    Rows of a tenant are streamed through one task in order, with the bucket as
    the only state; a bucket idle for longer than idle_seconds starts anew.
    """
    rows = requests.select(F.col(tenant).cast("string").alias("tenant"), F.col(order).cast("long").alias("seq"), F.col(time).cast("timestamp").cast("double").alias("t"))
    ordered = rows.repartition("tenant").sortWithinPartitions("tenant", "t", "seq")

    def run(batches) -> Iterator:
        import pyarrow as pa

        now, state = object(), None
        for b in batches:
            out = []
            for who, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if who != now:
                    now, state = who, None
                if state is not None and t - state[1] > idle_seconds:
                    state = None
                state, ok, left = bucket_step(state, t, rpm)
                out.append((ok, left))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.int32())], names=["tenant", "seq", "allowed", "remaining"])

    return ordered.mapInArrow(run, "tenant string, seq long, allowed boolean, remaining int")


def tenant_limits(keys: DataFrame) -> DataFrame:
    """Each tenant's limits: those of its first key (in order of the keys), defaults where it sets none."""
    named = [c for c in DEFAULTS if c in keys.columns]
    first = keys.groupBy("tenant_id").agg(*[F.min_by(F.struct(c), "key").alias(c) for c in named])
    return first.select("tenant_id", *[F.coalesce(F.col(c)[c], F.lit(DEFAULTS[c])).alias(c) for c in named])


def gateway(requests: DataFrame, keys: DataFrame, *, max_vectors: int | None = None, idle_seconds: float = 300.0) -> DataFrame:
    """(seq, tenant, status, reason) for each request (seq, ts, key, tenant, vectors).

    401 without a known key and 403 for another's tenant; then 429 if the
    tenant's token bucket is empty, 403 if the vectors don't fit its quota, else
    200. A request refused by the bucket takes no token, and one refused by the
    quota uses nothing of it (its token is spent). Buckets and quotas are the
    tenant's, so its requests are streamed in order of (ts, seq) with both as
    the state; those that need neither are dealt evenly.
    """
    limits = tenant_limits(keys)
    if "max_vectors" not in limits.columns or max_vectors is not None:
        limits = limits.withColumn("max_vectors", F.lit(DEFAULTS["max_vectors"] if max_vectors is None else max_vectors))
    known = keys.select("key", F.col("tenant_id").alias("owner")).join(limits.withColumnRenamed("tenant_id", "owner"), "owner")
    r = requests.join(known, "key", "left")
    early = F.when(F.col("owner").isNull(), 401).when(~F.col("owner").eqNullSafe(F.col("tenant")), 403)
    lane = F.when(early.isNull(), F.concat(F.lit("+"), "owner")).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64("seq"), F.lit(64))))
    rows = r.select(lane.alias("lane"), F.col("ts").cast("timestamp").cast("double").alias("t"), "seq", F.col("tenant").cast("string").alias("tenant"), early.alias("early"), F.greatest(F.col("rpm_limit").cast("int"), F.lit(1)).alias("rpm"), F.col("max_vectors").cast("long").alias("most"), F.coalesce(F.col("vectors").cast("long"), F.lit(0)).alias("n"))
    ordered = rows.repartition("lane").sortWithinPartitions("lane", "t", "seq")
    schema = T.StructType([rows.schema["seq"], T.StructField("tenant", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("reason", T.StringType())])

    def run(batches) -> Iterator:
        import pyarrow as pa

        now, bucket, used = None, None, 0
        for b in batches:
            out = []
            for who, t, early, rpm, most, n in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5, 6, 7)), strict=True):
                if early:
                    out.append((early, "invalid_key" if early == 401 else "forbidden"))
                    continue
                if who != now:
                    now, bucket, used = who, None, 0
                if bucket is not None and t - bucket[1] > idle_seconds:
                    bucket = None
                bucket, ok, _ = bucket_step(bucket, t, rpm)
                if not ok:
                    out.append((429, "rate_limit_exceeded"))
                elif used + n > most:
                    out.append((403, "vector_quota_exceeded"))
                else:
                    used += n
                    out.append((200, None))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=schema.names)

    return ordered.mapInArrow(run, schema)


def create_key(keys: DataFrame, tenant: str, secret: str, created_at: int, **limits: int | None) -> DataFrame:
    """The keys with one more; a key that exists already is an error."""
    if keys.where(F.col("key") == secret).limit(1).count():
        raise ValueError("already_exists")
    row = [(secret, tenant, created_at, limits.get("rpm_limit"), limits.get("max_vectors"), limits.get("max_collections"), limits.get("max_storage_mb"))]
    one = keys.sparkSession.createDataFrame(row, KEYS)
    return keys.unionByName(one, allowMissingColumns=True)


def revoke_key(keys: DataFrame, secret: str) -> DataFrame:
    """The keys without one; revoking twice changes nothing."""
    return keys.where(F.col("key") != secret)


def validate(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests with their key's tenant and limits (defaults where the key sets none); unknown keys have null."""
    known = keys.select("key", "tenant_id", *[F.coalesce(c, F.lit(DEFAULTS[c])).alias(c) for c in ("rpm_limit", "max_vectors", "max_collections") if c in keys.columns])
    return requests.join(known, "key", "left")


#: The schema of a table of keys.
KEYS = "key string, tenant_id string, created_at long, rpm_limit int, max_vectors int, max_collections int, max_storage_mb int"


def usage(collections: DataFrame, documents: DataFrame, *, tenant: str = "tenant", collection: str = "collection", size: str = "bytes") -> DataFrame:
    """Each tenant's collections, vectors and bytes, counted from the data itself."""
    n = collections.groupBy(tenant).agg(F.countDistinct(collection).alias("collections"))
    v = documents.groupBy(tenant).agg(F.count("*").alias("vectors"), F.sum(size).alias("bytes"))
    return n.join(v, tenant, "left").select(tenant, "collections", F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
