"""Queries over document maintenance, shards, tenants and figures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import embed
from ..functions import text as X
from ..operators import knn, metrics, sharding, store, tenancy
from ..sources import collections as C
from ..session import shared_dir, table
from .registry import query
from .text_queries import _TOKENS, documents


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# documents


def _versions(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", "n_chars", F.lit(1).cast("long").alias("seq"))
    second = d.where("doc_id % 3 = 0").withColumn("seq", F.lit(2).cast("long")).withColumn("n_chars", F.col("n_chars") + 1)
    third = d.where("doc_id % 6 = 0").withColumn("seq", F.lit(3).cast("long")).withColumn("n_chars", F.col("n_chars") + 2)
    return d, second.unionByName(third)


_VERSIONS = """d AS (SELECT doc_id, lang, n_chars, 1 AS seq FROM documents), c AS (SELECT doc_id, lang, n_chars + 1 AS n_chars, 2 AS seq FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, n_chars + 2, 3 FROM d WHERE doc_id % 6 = 0)"""


@query(f"WITH {_VERSIONS}, a AS (SELECT * FROM d UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS k FROM a) SELECT doc_id, lang, n_chars, CAST(seq AS BIGINT) AS seq FROM r WHERE k = 1")
def upsert_latest(spark, sf_dir):
    base, changes = _versions(spark, sf_dir)
    return store.upsert(base, changes, "doc_id")


@query(f"WITH {_VERSIONS}, b AS (SELECT * FROM d WHERE doc_id % 2 = 0), k AS (SELECT doc_id, max(seq) AS seq, max_by(n_chars, seq) AS n_chars FROM c GROUP BY doc_id) SELECT b.doc_id, coalesce(k.n_chars, b.n_chars) AS n_chars, CAST(coalesce(k.seq, b.seq) AS BIGINT) AS seq FROM b LEFT JOIN k ON b.doc_id = k.doc_id")
def update_existing(spark, sf_dir):
    """Changes to keys that the table hasn't are left out."""
    base, changes = _versions(spark, sf_dir)
    return store.update(base.where("doc_id % 2 = 0"), changes, "doc_id")[0].select("doc_id", "n_chars", "seq")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 2")
def delete_antijoin(spark, sf_dir):
    d = documents(spark, sf_dir)
    return store.delete(d, d.where("doc_id % 5 = 2"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 10")
def peek(spark, sf_dir):
    return store.peek(documents(spark, sf_dir), 10, "doc_id", complete=["text"]).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 17")
def get_by_key(spark, sf_dir):
    return store.get(documents(spark, sf_dir), 17, "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def multi_get(spark, sf_dir):
    """Metadata for a list of hits."""
    d = documents(spark, sf_dir)
    top = d.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    hits = top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return store.multi_get(hits, d, ["source"], "doc_id").select("doc_id", "source", "rank")


@query("SELECT doc_id, source FROM documents")
def project_metadata(spark, sf_dir):
    """The texts aren't read."""
    return store.project(documents(spark, sf_dir), key="doc_id", metadata=["source"])


@query(f"SELECT count(*) AS documents, CAST(sum(len({_TOKENS})) AS BIGINT) AS total_tokens, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes FROM documents")
def store_stats(spark, sf_dir):
    return store.stats(documents(spark, sf_dir))


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source = 'src3'")
def json_filter(spark, sf_dir):
    """All of the given metadata values; a missing key never matches."""
    d = documents(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))
    return d.where(store.equals({"lang": "de", "source": "src3"}, F.col("metadata"))).select("doc_id", "lang", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND n_chars % 2 = 0")
def json_typed_filter(spark, sf_dir):
    """Metadata as JSON: a number isn't its text, and the text isn't the number."""
    d = documents(spark, sf_dir).select("doc_id", "n_chars", F.to_json(F.struct("lang", (F.col("n_chars") % 2).alias("odd"), (F.col("n_chars") % 2).cast("string").alias("text"), (F.col("n_chars") % 2 == 0).alias("even"))).alias("metadata"))
    typed = store.json_equals({"lang": "de", "odd": 0, "text": "0", "even": True}, F.col("metadata"))
    untyped = store.json_equals({"odd": "0"}, F.col("metadata")) | store.json_equals({"text": 0}, F.col("metadata")) | store.json_equals({"missing": None}, F.col("metadata"))
    return d.where(typed & ~untyped).select("doc_id", "n_chars")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, lang, source FROM documents WHERE doc_id % 9 <> 4")
def json_roundtrip(spark, sf_dir):
    """Documents to JSON lines and back; broken lines are rejected."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    lines = C.to_json_lines(d).withColumn("value", F.when(F.get_json_object("value", "$.id").cast("long") % 9 == 4, F.lit("{broken")).otherwise(F.col("value")))
    good, _ = C.from_json_lines(lines)
    return good.select("key", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("SELECT 'documents_total{lang=\"' || lang || '\",source=\"' || source || '\"} ' || count(*) AS line FROM documents GROUP BY lang, source")
def prometheus_export(spark, sf_dir):
    n = documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    return metrics.prometheus(n, "documents_total", F.col("n"), {"lang": F.col("lang"), "source": F.col("source")})


_BOUNDS = "(VALUES ('0.001', 0.001::DOUBLE), ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('+Inf', 'Infinity'::DOUBLE)) b(s, x)"


@query(
    f"""WITH e AS (SELECT event_type AS t, value / 100 AS v FROM events),
       h AS (SELECT 'latency_bucket{{event_type="' || t || '",le="' || b.s || '"}} ' || count(*) FILTER (v <= b.x) AS line FROM e, {_BOUNDS} GROUP BY t, b.s)
       SELECT line FROM h UNION ALL SELECT 'latency_count{{event_type="' || t || '"}} ' || count(v) FROM e GROUP BY t
       UNION ALL SELECT 'latency_sum{{event_type="' || t || '"}} ' || coalesce(sum(CAST(round(v * 1000000) AS BIGINT)), 0) FROM e GROUP BY t"""
)
def prometheus_histogram(spark, sf_dir):
    """Buckets, sum and count as lines."""
    return metrics.prometheus_histogram(events(spark, sf_dir).withColumn("seconds", F.col("value") / 100), "latency", "seconds", by="event_type")


@query()
def embed_search(spark, sf_dir):
    """Texts embedded by hashing, searched with the first document's own vector."""
    d = documents(spark, sf_dir)
    vectors = d.select("doc_id", embed.embed_column(F.col("text"), 64).alias("vector"))
    text = store.get(d, 0, "doc_id").first()["text"]
    return knn.search_vector(vectors, embed.hash_embed(text, 64), 5, key="doc_id").select("rank", "doc_id", F.round("score", 6).alias("score"))


# shards

_SHARD = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT)"


@query(f"SELECT {_SHARD} % 8 AS shard, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY 1")
def shard_for_key(spark, sf_dir):
    s = sharding.with_shard(documents(spark, sf_dir), 8, "doc_id")
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_key"))


@query(f"SELECT {_SHARD} % 4 AS old_shard, {_SHARD} % 6 AS new_shard, count(*) AS n FROM documents GROUP BY 1, 2")
def reshard_counts(spark, sf_dir):
    return sharding.reshard(documents(spark, sf_dir), 4, 6, "doc_id").groupBy("old_shard", "new_shard").agg(F.count("*").alias("n"))


@query(f"SELECT {_SHARD} % 4 AS old_shard, {_SHARD} % 6 AS new_shard, count(*) AS rows FROM documents GROUP BY 1, 2")
def reshard_moves(spark, sf_dir):
    """Four shards rewritten as six: every row arrives."""
    old, new = (f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}" for _ in range(2))
    sharding.write_sharded(documents(spark, sf_dir).select("doc_id", "lang", "source"), old, 4, "doc_id")
    return sharding.move_shards(spark, old, new, 4, 6, "doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 33")
def routed_get(spark, sf_dir):
    """One key of a sharded table: the other shards' folders aren't read."""
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    sharding.write_sharded(documents(spark, sf_dir).select("doc_id", "lang", "source"), path, 4, "doc_id")
    return sharding.read_key(spark, path, 33, 4, "doc_id")


@query(
    """WITH o AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'create' END AS op, md5(CAST(o_custkey % 90 AS VARCHAR)) AS key, 't' || o_custkey % 7 AS tenant_id FROM orders),
       g AS (SELECT *, coalesce(max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY key), -1) AS gone FROM o)
       SELECT key, min_by(tenant_id, seq) AS tenant_id, min(seq) AS created_seq FROM g WHERE op = 'create' AND seq > gone GROUP BY key"""
)
def key_log(spark, sf_dir):
    """A log of created and deleted keys, made of orders, replayed into the keys that exist."""
    op = F.when(F.col("o_orderkey") % 3 == 0, "delete").otherwise("create")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), op.alias("op"), F.md5((F.col("o_custkey") % 90).cast("string").cast("binary")).alias("key"), F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("tenant_id"))
    return sharding.replay_keys(o)


@query(
    """WITH e AS (SELECT 't' || user_id % 30 AS tenant_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'init' WHEN 'error' THEN 'decr' ELSE 'incr' END AS op, event_id % 9 AS n FROM events),
       r AS (SELECT *, coalesce(max(CASE WHEN op = 'init' THEN seq END) OVER (PARTITION BY tenant_id), -1) AS reset FROM e),
       s AS (SELECT *, sum(CASE op WHEN 'incr' THEN n WHEN 'decr' THEN -n ELSE 0 END) OVER (PARTITION BY tenant_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM r WHERE seq >= reset)
       SELECT tenant_id, CAST(max_by(s, seq) - least(0, min(s)) AS BIGINT) AS vectors FROM s GROUP BY tenant_id"""
)
def quota_log(spark, sf_dir):
    """A log of quota commands, made of events, replayed into counters."""
    op = F.when(F.col("event_type") == "signup", "init").when(F.col("event_type") == "error", "decr").otherwise("incr")
    return sharding.replay_quotas(events(spark, sf_dir).select(F.concat(F.lit("t"), F.col("user_id") % 30).alias("tenant_id"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 9).alias("n")))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT 'node' || user_id % 40 AS node, epoch(max(now)) - epoch(max(ts)) > 3600 AS silent FROM events, m GROUP BY 1")
def silent_nodes(spark, sf_dir):
    """Nodes that weren't heard for an hour."""
    beats = events(spark, sf_dir).select(F.concat(F.lit("node"), F.col("user_id") % 40).alias("node"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit(beats.agg(F.max("ts")).first()[0])
    return sharding.silent_nodes(beats, now, 3600.0).select("node", "silent")


@query("SELECT s AS shard, CAST(r AS INTEGER) AS replica, (['n1', 'n2', 'n3', 'n4', 'n5'])[(s % 5 + r) % 5 + 1] AS node FROM range(12) a(s), range(3) b(r)")
def shard_placement(spark, sf_dir):
    return sharding.placement(spark, 12, ["n3", "n1", "n2", "n5", "n4"], 3)


@query(
    """WITH p AS (SELECT s AS shard, list((['n1', 'n2', 'n3', 'n4', 'n5'])[(s % 5 + r) % 5 + 1] ORDER BY r) AS reps FROM range(12) a(s), range(3) b(r) GROUP BY s),
       x AS (SELECT shard, reps, list_filter(reps, lambda n: n <> 'n2') AS l, list_filter(['n1', 'n3', 'n4', 'n5'], lambda n: NOT list_contains(reps, n)) AS spare FROM p),
       y AS (SELECT shard, l || spare[1:3 - len(l)] AS f, list_contains(reps, 'n2') AS hit FROM x)
       SELECT shard, array_to_string(f, ',') AS replicas, CAST(1 + hit::INT AS INTEGER) AS version, f[1] AS leader FROM y"""
)
def shard_failover(spark, sf_dir):
    """Node n2 is lost."""
    p = sharding.placement(spark, 12, ["n1", "n2", "n3", "n4", "n5"], 3)
    a = p.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("replica", "node"))), lambda s: s["node"]).alias("replicas"), F.lit(1).alias("version"))
    after = sharding.fail_over(a, "n2", ["n1", "n2", "n3", "n4", "n5"], 3)
    return after.select("shard", F.array_join("replicas", ",").alias("replicas"), "version", "leader")


@query(
    """WITH o AS (SELECT o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'create' WHEN 2 THEN 'create' ELSE 'update' END AS op, 'c' || (o_custkey % 50) AS name, o_orderpriority AS status FROM orders),
       g AS (SELECT *, coalesce(max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY name), -1) AS gone FROM o), l AS (SELECT *, min(CASE WHEN op = 'create' THEN seq END) OVER (PARTITION BY name) AS created FROM g WHERE seq > gone)
       SELECT name, max(created) AS created_seq, max_by(status, seq) AS status FROM l WHERE created IS NOT NULL AND seq >= created AND (op = 'update' OR seq = created) GROUP BY name"""
)
def collection_log(spark, sf_dir):
    """A command log, made of orders, replayed into the collections that exist."""
    o = table(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderkey") % 7 == 0, "delete").when(F.col("o_orderkey") % 7 <= 2, "create").otherwise("update")
    log = o.select(F.col("o_orderkey").alias("seq"), op.alias("op"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("name"), F.col("o_orderpriority").alias("status"))
    return sharding.replay_collections(log)


@query(
    """WITH o AS (SELECT event_id AS seq, 'node' || (user_id % 40) AS node, CASE event_type WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'up' END AS op FROM events),
       m AS (SELECT node, max_by(op, seq) AS state, max(seq) AS version FROM o GROUP BY node) SELECT node, state, version FROM m WHERE state <> 'leave'"""
)
def membership_log(spark, sf_dir):
    op = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "leave").otherwise("up")
    log = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.concat(F.lit("node"), F.col("user_id") % 40).alias("node"), op.alias("op"))
    return sharding.replay_membership(log)


# tenants


@query("SELECT c_custkey, substr(md5(c_name), 1, 4) || '_' || c_name || '_' || 'docs' AS collection FROM customer")
def tenant_prefix(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tenancy.collection_name(F.col("c_name"), F.lit("docs")).alias("collection"))


@query("SELECT 'set' || c_custkey AS own_name FROM customer WHERE c_nationkey = 3")
def tenant_collections(spark, sf_dir):
    """Of the collections of all nations as tenants, those of nation 3 under their own names."""
    named = table(spark, sf_dir, "customer").select(tenancy.collection_name(F.concat(F.lit("nation"), F.col("c_nationkey")), F.concat(F.lit("set"), F.col("c_custkey"))).alias("name"))
    return tenancy.owned(named, "nation3").select("own_name")


@query("SELECT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS key_prefix, 't' || c_nationkey AS tenant_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 50 AS INTEGER) ELSE 100 END AS rpm_limit FROM customer")
def api_keys(spark, sf_dir):
    return tenancy.list_keys(_keys(spark, sf_dir))


def _keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("key"), F.concat(F.lit("t"), F.col("c_nationkey")).alias("tenant_id"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 50).cast("int")).alias("rpm_limit"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS tenant, event_id AS seq, event_id % 5 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
       f AS (SELECT tenant, seq, k, CAST(CASE WHEN n <= 10 THEN n ELSE 0 END AS BIGINT) AS used, n <= 10 AS allowed FROM e WHERE k = 1
             UNION ALL SELECT e.tenant, e.seq, e.k, CAST(f.used + CASE WHEN f.used + e.n <= 10 THEN e.n ELSE 0 END AS BIGINT), f.used + e.n <= 10 FROM f JOIN e ON e.tenant = f.tenant AND e.k = f.k + 1)
       SELECT tenant, seq, used, allowed FROM f"""
)
def quota_running(spark, sf_dir):
    """Ten units for each user; what is refused uses nothing."""
    ops = events(spark, sf_dir).select(F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("n"))
    return tenancy.quota_checks(ops, 10)


@query(
    """WITH o AS (SELECT user_id AS tenant, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN -2 ELSE 3 END AS delta FROM events),
       s AS (SELECT *, sum(delta) OVER (PARTITION BY tenant ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM o), m AS (SELECT *, least(0, min(s) OVER (PARTITION BY tenant ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS low FROM s)
       SELECT tenant, seq, CAST(delta AS INTEGER) AS delta, CAST(s - low AS BIGINT) AS usage FROM m"""
)
def quota_clamped(spark, sf_dir):
    """Counters that never fall below zero."""
    ops = events(spark, sf_dir).select(F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), -2).otherwise(3).alias("delta"))
    return tenancy.clamped_usage(ops)


#: Two requests a minute for each user; a bucket idle for over 300 s starts anew.
BUCKETS = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS tenant, event_id AS seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
       b AS (SELECT tenant, seq, k, t AS last, 1e0 AS tokens, TRUE AS allowed, 1 AS remaining FROM e WHERE k = 1
             UNION ALL SELECT tenant, seq, k, CASE WHEN idle OR r >= 1 THEN t ELSE last END, CASE WHEN idle THEN 1e0 WHEN r >= 1 THEN r - 1 ELSE tokens END, idle OR r >= 1, CASE WHEN idle THEN 1 WHEN r >= 1 THEN CAST(floor(r - 1) AS INTEGER) ELSE 0 END
             FROM (SELECT e.tenant, e.seq, e.k, e.t, b.last, b.tokens, e.t - b.last > 300 AS idle, least(2e0, b.tokens + (e.t - b.last) * 2 / 6e1) AS r FROM b JOIN e ON e.tenant = b.tenant AND e.k = b.k + 1))
       SELECT tenant, seq, allowed, remaining FROM b"""


@query(BUCKETS)
def token_bucket(spark, sf_dir):
    """Two requests a minute for each user."""
    r = events(spark, sf_dir).select(F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), "ts")
    return tenancy.token_bucket(r, 2)


@query(
    """WITH RECURSIVE y AS (SELECT c_custkey, 't' || c_nationkey AS owner, md5(CAST(c_custkey AS VARCHAR)) AS key, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 ELSE 100 END AS own_rpm FROM customer WHERE c_custkey % 13 <> 5),
       l AS (SELECT owner, greatest(arg_min(own_rpm, key), 1) AS rpm FROM y GROUP BY owner),
       r AS (SELECT event_id AS seq, (epoch_us(ts) // 10000) / 1e6 AS t, CASE WHEN event_id % 11 = 0 THEN 't99' ELSE 't' || c_nationkey END AS tenant, event_id % 4 AS n, owner, rpm FROM events LEFT JOIN customer ON customer.c_custkey = user_id LEFT JOIN y ON y.c_custkey = user_id LEFT JOIN l USING (owner)),
       a AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY t, seq) AS k FROM r WHERE owner = tenant),
       f AS (SELECT owner, seq, k, t AS last, rpm - 1e0 AS tokens, TRUE AS ok, CAST(CASE WHEN n <= 300 THEN n ELSE 0 END AS BIGINT) AS used, n <= 300 AS fits FROM a WHERE k = 1
             UNION ALL SELECT owner, seq, k, CASE WHEN idle OR refilled >= 1 THEN t ELSE last END, CASE WHEN idle THEN rpm - 1e0 WHEN refilled >= 1 THEN refilled - 1 ELSE tokens END, idle OR refilled >= 1,
                CAST(CASE WHEN (idle OR refilled >= 1) AND used + n <= 300 THEN used + n ELSE used END AS BIGINT), used + n <= 300
             FROM (SELECT a.owner, a.seq, a.k, a.t, a.n, a.rpm, f.last, f.tokens, f.used, a.t - f.last > 300 AS idle, least(a.rpm::DOUBLE, f.tokens + (a.t - f.last) * a.rpm / 6e1) AS refilled FROM f JOIN a ON a.owner = f.owner AND a.k = f.k + 1)),
       s AS (SELECT r.seq, r.tenant, CASE WHEN r.owner IS NULL THEN 'invalid_key' WHEN r.owner <> r.tenant THEN 'forbidden' WHEN NOT ok THEN 'rate_limit_exceeded' WHEN NOT fits THEN 'vector_quota_exceeded' END AS reason FROM r LEFT JOIN f ON f.seq = r.seq)
       SELECT seq, tenant, CAST(CASE reason WHEN 'invalid_key' THEN 401 WHEN 'rate_limit_exceeded' THEN 429 WHEN 'forbidden' THEN 403 WHEN 'vector_quota_exceeded' THEN 403 ELSE 200 END AS INTEGER) AS status, reason FROM s"""
)
def gateway(spark, sf_dir):
    """Events, ten thousand times as dense, as requests with customers' keys, some revoked: known key, own tenant, rate, quota."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    e = events(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey"), "left")
    tenant = F.when(F.col("event_id") % 11 == 0, F.lit("t99")).otherwise(F.concat(F.lit("t"), F.col("c_nationkey")))
    r = e.select(F.col("event_id").alias("seq"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("key"), tenant.alias("tenant"), (F.col("event_id") % 4).alias("vectors"), F.timestamp_micros(F.expr("unix_micros(cast(ts AS timestamp)) div 10000")).alias("ts"))
    revoked = table(spark, sf_dir, "customer").where("c_custkey % 13 = 5").select(F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("key"))
    return tenancy.gateway(r, _keys(spark, sf_dir).join(revoked, "key", "left_anti"), max_vectors=300)


@query(
    """SELECT o_orderkey AS seq, 't' || c_nationkey AS tenant_id, CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 50 AS INTEGER) ELSE 100 END AS rpm_limit
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 7 <> 0"""
)
def validate_keys(spark, sf_dir):
    """Orders as requests with their customer's key; the keys of every seventh customer are revoked."""
    alive = _keys(spark, sf_dir).join(table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("key")), "key", "left_anti")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.md5(F.col("o_custkey").cast("string").cast("binary")).alias("key"))
    return tenancy.validate(r, alive).select("seq", "tenant_id", "rpm_limit")


@query("SELECT lang AS tenant, count(DISTINCT source) AS collections, count(*) AS vectors, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def tenant_usage(spark, sf_dir):
    """Languages as tenants, sources as their collections."""
    d = documents(spark, sf_dir).select(F.col("lang").alias("tenant"), F.col("source").alias("collection"), F.octet_length("text").alias("bytes"))
    return tenancy.usage(d, d)


# figures


@query(
    """SELECT event_type, le, n FROM (SELECT event_type, '+Inf' AS le, count(value) AS n FROM events GROUP BY event_type
       UNION ALL SELECT event_type, b.s AS le, count(*) FILTER (value / 100 <= b.x) AS n FROM events, (VALUES ('0.001', 0.001::DOUBLE), ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5)) b(s, x) GROUP BY event_type, b.s)"""
)
def latency_histogram(spark, sf_dir):
    return metrics.histogram(events(spark, sf_dir).withColumn("seconds", F.col("value") / 100), "seconds", by="event_type")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
       SELECT event_type, count(*) AS "count", min(value) AS "min", max(value) AS "max", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev,
       min(value) FILTER (k >= greatest(round(n * 50 / 100.0), 1)) AS p50, min(value) FILTER (k >= greatest(round(n * 90 / 100.0), 1)) AS p90, min(value) FILTER (k >= greatest(round(n * 95 / 100.0), 1)) AS p95,
       min(value) FILTER (k >= greatest(round(n * 99 / 100.0), 1)) AS p99 FROM r GROUP BY event_type"""
)
def latency_percentiles(spark, sf_dir):
    s = metrics.latency_summary(events(spark, sf_dir), "value", "event_type")
    return s.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query(
    """WITH e AS (SELECT event_type AS name, event_id % 2 AS half, count(*)::DOUBLE AS ops, max(value) AS p95 FROM events GROUP BY 1, 2)
       SELECT b.name, round(c.ops / b.ops - 1, 6) AS ops_change, round(c.p95 / b.p95 - 1, 6) AS p95_change,
       CASE WHEN c.ops / b.ops - 1 < -0.1 OR c.p95 / b.p95 - 1 > 0.1 THEN 'regression' WHEN c.ops / b.ops - 1 > 0.1 OR c.p95 / b.p95 - 1 < -0.1 THEN 'improvement' ELSE 'unchanged' END AS verdict
       FROM e b JOIN e c ON b.name = c.name AND b.half = 0 AND c.half = 1"""
)
def regression_compare(spark, sf_dir):
    """Even events as the baseline, odd ones as the current run."""
    e = events(spark, sf_dir).groupBy(F.col("event_type").alias("name"), (F.col("event_id") % 2).alias("half")).agg(F.count("*").cast("double").alias("ops_per_sec"), F.max("value").alias("p95"))
    c = metrics.compare_runs(e.where("half = 0"), e.where("half = 1"))
    return c.withColumn("ops_change", F.round("ops_change", 6)).withColumn("p95_change", F.round("p95_change", 6))


@query(f"SELECT count(DISTINCT term) AS vocabulary, (SELECT count(DISTINCT source) FROM documents) AS sources FROM (SELECT unnest({_TOKENS}) AS term FROM documents)")
def distinct_counts(spark, sf_dir):
    d = documents(spark, sf_dir)
    words = d.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).agg(F.countDistinct("term").alias("vocabulary"))
    return words.join(F.broadcast(d.agg(F.countDistinct("source").alias("sources"))))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def sql_smoke(spark, sf_dir):
    """Plain SQL over a view, for ad-hoc questions beside the operators."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("nearfield_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM nearfield_lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
