import hashlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from nearfield.collection import Collection, NotClustered, NotEnabled
from nearfield.functions import embed
from nearfield.operators.indexes import Index
from nearfield.operators import bm25, fusion, metrics, postings, sharding, store, tenancy
from nearfield.sources.collections import CollectionSpec


@pytest.fixture()
def people(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/people", CollectionSpec.of({"name": "people", "dimensions": 16, "num_shards": 2}))
    rows = [("a", "red apple pie", {"type": "apple"}), ("b", "yellow banana bread", {"type": "banana"}), ("c", "green apple tart", {"type": "apple"})]
    c.add(spark.createDataFrame(rows, "key string, text string, metadata map<string,string>"))
    return c


def test_collection(spark, people):
    c = people
    assert c.count() == 3
    assert c.get("a")["text"] == "red apple pie" and c.get("zz") is None
    assert [r["key"] for r in c.peek(2).collect()] == ["a", "b"]
    assert c.search("red apple pie", 1).first()["key"] == "a"
    only = c.search("apple", 3, where=F.col("metadata")["type"] == "apple")
    assert {r["key"] for r in only.collect()} == {"a", "c"}
    assert {r["key"] for r in c.search_bm25("apple").collect()} == {"a", "c"}
    assert c.search_hybrid("banana", 1).first()["key"] == "b"
    c.upsert(spark.createDataFrame([("a", "blue plum"), ("d", "cherry")], "key string, text string"))
    assert c.count() == 4 and c.get("a")["text"] == "blue plum"
    with pytest.raises(KeyError):
        c.update(spark.createDataFrame([("nope", "x")], "key string, text string"))
    c.delete(["b", "b", "nope"])
    assert c.count() == 3 and c.get("b") is None
    c.compact()
    assert c.rows().count() == 3
    again = Collection(spark, c.path, c.spec)
    assert again.generation == 1 and again.count() == 3
    assert again.stats()["documents"] == 3
    with pytest.raises(ValueError, match="dimension_mismatch"):
        c.search_vector([1.0], 1)
    with pytest.raises(ValueError, match="dimension_mismatch"):
        c.add(spark.createDataFrame([("x", "y", [1.0])], "key string, text string, vector array<float>"))
    assert "metadata" not in c.search("plum", 1, include_metadata=False).columns


def test_collection_is_opened_by_its_specification(spark, people, tmp_path):
    again = Collection(spark, people.path)
    assert again.spec == people.spec and again.count() == 3
    with pytest.raises(ValueError, match="another specification"):
        Collection(spark, people.path, CollectionSpec("people", dimension=8))
    with pytest.raises(FileNotFoundError):
        Collection(spark, f"file://{tmp_path}/nothing")
    # two handles write: both batches count, each under a number of its own
    people.add(spark.createDataFrame([("x", "one")], "key string, text string"))
    again.add(spark.createDataFrame([("x", "two"), ("y", "three")], "key string, text string"))
    assert again.get("x")["text"] == "two" and people.get("x")["text"] == "two" and people.count() == 5
    assert len(people.folder.names("log")) == 3
    with pytest.raises(ValueError, match="dimension_mismatch"):
        people.add(spark.createDataFrame([("z", "y", [1.0])], "key string, text string, vector array<float>"))
    assert people.count() == 5 and people.get("z") is None
    assert people.compact_if_due() and not people.compact_if_due() and people.generation == 1
    folder = people.export_sharded()
    assert people.get_routed("y")["text"] == "three" and people.get_routed("nope") is None and folder.startswith(people.path)
    assert {r["key"] for r in people.search_bm25_sharded("apple").collect()} == {"a", "c"}
    assert people.search_sharded("two", 1).first()["key"] == "x"


@pytest.mark.parametrize("backend", ["vamana", "hnsw", "pq"])
def test_collection_backends(spark, tmp_path, backend):
    """With an index the hits are those of exact search, whatever is written after it was built."""
    import numpy as np

    x = np.random.default_rng(4).normal(size=(300, 8)).round(3)
    made = [(f"k{i}", f"text {i}", v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(made, "key string, text string, vector array<float>")
    one, two = (Collection(spark, f"file://{tmp_path}/{b}", CollectionSpec(b, dimension=8, backend=b)) for b in (backend, "exact"))
    for c in (one, two):
        c.add(docs)
        c.compact()
    assert one.build_index().describe()["size"] == 300 and two.build_index() is None
    hits = lambda c, q: [r["key"] for r in c.search_vector(x[q].tolist(), 5).collect()]
    assert hits(one, 7) == hits(two, 7) and hits(one, 7)[0] == "k7"
    for c in (one, two):
        c.delete(["k7"])
        c.upsert(spark.createDataFrame([("new", "n", x[7].tolist()), ("k8", "moved", (-x[7]).tolist())], docs.schema))
    assert hits(one, 7) == hits(two, 7) and hits(one, 7)[0] == "new"
    assert Collection(spark, one.path).index().info.kind == backend


def test_index(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(120, 8))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<float>")
    asked = spark.createDataFrame([(q, x[q].tolist()) for q in (3, 50)], "query_id long, query_vector array<double>")
    nearest = lambda i: {r["query"]: r["key"] for r in i.search(asked, 3).where("rank = 1").collect()}
    with pytest.raises(ValueError):
        Index.build(docs, str(tmp_path), "other")
    for kind in ("exact", "vamana", "hnsw", "pq"):
        path = f"file://{tmp_path}/{kind}"
        made = Index.build(docs.where("key < 100"), path, kind, metric="euclidean")
        made.insert(docs.where("key >= 100"))
        made.insert(spark.createDataFrame([(5, x[3].tolist())], docs.schema))
        assert made.size() == 120 and {r["key"] for r in made.search(asked, 2).where("query = 3").collect()} == {3, 5}, kind
        made.delete(spark.createDataFrame([(3,), (50,), (999,)], "key long"))
        again = Index.open(spark, path)
        assert again.size() == 118 and again.describe()["deleted"] == 2 and nearest(again)[3] == 5 and nearest(again)[50] != 50, kind
        again.delete(docs.where("key < 40").select("key"))  # more than a tenth: compacted
        assert again.describe()["deleted"] == 0 and again.vectors().count() == again.size() == 79, kind
        assert min(r["key"] for r in again.search(asked, 5).collect()) >= 40


def test_json_is_compared_by_type(spark):
    made = ['{"a":1}', '{"a":"1"}', '{"a":1.0}', '{"a":true}', '{"a":null}', '{"b":1}', "{bad", None, '{"a":"x","it\'s":1.5}']
    df = spark.createDataFrame([(j,) for j in made], "j string")
    match = lambda c: [i for i, r in enumerate(df.select(store.json_equals(c, F.col("j")).alias("m")).collect()) if r["m"]]
    assert [match({"a": v}) for v in (1, "1", 1.0, True, None)] == [[0], [1], [2], [3], [4]]
    assert match({"a": "x", "it's": 1.5}) == [8] and match({}) == list(range(9))


def test_replays(spark):
    log = spark.createDataFrame([(1, "create", "k", "t"), (2, "create", "k", "u"), (3, "delete", "k", None), (4, "create", "k", "v"), (5, "create", "m", "t"), (6, "delete", "m", None), (7, "delete", "z", None)], "seq long, op string, key string, tenant_id string")
    assert [tuple(r) for r in sharding.replay_keys(log).collect()] == [("k", "v", 4)]
    quotas = spark.createDataFrame([(1, "incr", "t", 9), (2, "init", "t", None), (3, "decr", "t", 5), (4, "incr", "t", 3), (5, "incr", "u", 2)], "seq long, op string, tenant_id string, n long")
    assert sorted(tuple(r) for r in sharding.replay_quotas(quotas).collect()) == [("t", 3), ("u", 2)]
    beats = spark.createDataFrame([("a", 100), ("a", 130), ("b", 90)], "node string, s long").select("node", F.timestamp_seconds("s").alias("ts"))
    got = {r["node"]: r["silent"] for r in sharding.silent_nodes(beats, F.timestamp_seconds(F.lit(140))).collect()}
    assert got == {"a": False, "b": True}


def test_shards_are_moved(spark, tmp_path):
    d = spark.range(500).withColumnRenamed("id", "key")
    sharding.write_sharded(d, str(tmp_path / "old"), 4)
    moved = sharding.move_shards(spark, str(tmp_path / "old"), str(tmp_path / "new"), 4, 6)
    assert moved.agg(F.sum("rows")).first()[0] == 500
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "new")).collect()) == list(range(500))
    assert sharding.read_key(spark, str(tmp_path / "new"), 33, 6).collect()[0]["key"] == 33


def test_prometheus_histogram(spark):
    v = spark.createDataFrame([('a"b\\c\n', 0.003), ('a"b\\c\n', 3.0), ("x", None)], "name string, s double")
    lines = {r["line"] for r in metrics.prometheus_histogram(v, "search_seconds", "s", by="name").collect()}
    name = 'a\\"b\\\\c\\n'
    assert f'search_seconds_bucket{{name="{name}",le="0.005"}} 1' in lines and f'search_seconds_bucket{{name="{name}",le="+Inf"}} 2' in lines
    assert f'search_seconds_sum{{name="{name}"}} 3003000' in lines and f'search_seconds_count{{name="{name}"}} 2' in lines
    assert 'search_seconds_sum{name="x"} 0' in lines and len(lines) == 2 * 13
    rows, seen = metrics.observed(v, "adds", "s")
    rows.collect()
    assert seen.get == {"n": 3, "total": 3.003, "largest": 3.0}


def test_without_bm25(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/x", CollectionSpec("x", dimension=4, bm25=False))
    assert c.count() == 0
    with pytest.raises(NotEnabled):
        c.search_bm25("a")
    for asked in (lambda: c.export_sharded(), lambda: c.search_sharded("a")):
        with pytest.raises(NotClustered, match="not_clustered"):
            asked()
    with pytest.raises(ValueError):
        CollectionSpec("x", backend="other")


def test_embedder_chain():
    embed.register("broken", lambda t, d: 1 / 0)
    assert embed.first_that_works(["broken", "hashing"], "a b", 8) == embed.hash_embed("a b", 8)
    with pytest.raises(RuntimeError):
        embed.first_that_works(["broken"], "a", 8)
    assert embed.hash_embed(None, 4) == [0, 0, 0, 0]


def test_bm25_formula(spark):
    one = spark.createDataFrame([(1, "cat dog")], "key long, text string")
    assert bm25.search(one, "cat").first()["score"] == pytest.approx(0.28768, abs=1e-4)
    two = spark.createDataFrame([(1, "apple pie"), (2, "banana split")], "key long, text string")
    assert bm25.search(two, "apple").first()["score"] == pytest.approx(0.6931, abs=1e-3)
    assert bm25.search(two, "zzz").count() == 0 and bm25.search(two, "--").count() == 0
    twice = bm25.search(two, "apple apple").first()["score"]
    assert twice == bm25.search(two, "apple").first()["score"]
    empty = spark.createDataFrame([], "key long, text string")
    assert bm25.search(empty, "apple").count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "key long, text string")
    assert bm25.search(blank, "apple").count() == 0
    assert bm25.corpus_stats(blank).first()["avgdl"] == 0


def test_block_max_skips_and_agrees(spark):
    rows = [(i, "common " + ("rare rare rare" if i < 10 else "filler " * (i % 7))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "key long, text string")
    found, said = bm25.search_block_max(docs, "common rare", 5)
    assert [r["key"] for r in found.collect()] == [r["key"] for r in bm25.search(docs, "common rare", 5).collect()]
    assert said["blocks_skipped"] > 0 and said["blocks_total"] == said["blocks_scanned"] + said["blocks_skipped"]
    assert bm25.search_block_max(docs, "nothing", 5)[1]["blocks_total"] == 0


def test_stored_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 64)
    monkeypatch.setattr(postings, "SEEDS", 2)
    made = [(f"k{i:05d}", "common " + ("rare rare rare" if i < 10 else "filler " * (i % 7))) for i in range(3000)]
    docs = spark.createDataFrame([*made, ("k00001", "common rare rare rare"), (None, "common"), ("kx", None), ("ky", "")], "key string, text string")
    path = f"file://{tmp_path}/index"
    postings.build(docs, path, buckets=4)
    index = postings.StoredIndex(spark, path, buckets=4)
    found, figures = index.search("common rare", 5)
    plain = docs.where("key IS NOT NULL").dropDuplicates(["key"])
    want = [(r["key"], round(r["score"], 9)) for r in bm25.search(plain, "common rare", 5).collect()]
    assert [(r["key"], round(r["score"], 9)) for r in found.collect()] == want
    f = figures.first()
    assert f["blocks_total"] == 47 + 1 and 0 < f["blocks_scanned"] < 10 and f["blocks_skipped"] == f["blocks_total"] - f["blocks_scanned"] and f["query_terms"] == 2
    found, figures = index.search("nothing", 5)
    assert found.count() == 0 and figures.first()["blocks_total"] == 0
    assert index.info().first()["n"] == 3002
    numbers = [(r["number"], r["key"]) for r in index.table("documents").orderBy("number").select("number", "key").collect()]
    assert numbers == list(enumerate(sorted({k for k, _ in made} | {"kx", "ky"})))
    postings.build(docs.limit(0), path + "0", buckets=4)
    assert postings.StoredIndex(spark, path + "0", buckets=4).search("common", 3)[0].count() == 0


def test_fusion(spark):
    lex = spark.createDataFrame([("d1", 2.5), ("d2", 1.0)], "key string, score double")
    vec = spark.createDataFrame([("d1", 0.8), ("d2", 0.4)], "key string, score double")
    got = {r["key"]: r["score"] for r in fusion.linear(lex, vec).collect()}
    assert got == pytest.approx({"d1": 0.9, "d2": 0.4})
    a = spark.createDataFrame([("d1", 3.0), ("d2", 2.0), ("d3", 1.0)], "key string, score double")
    b = spark.createDataFrame([("d1", 3.0), ("d4", 2.0), ("d2", 1.0)], "key string, score double")
    top = fusion.rrf(a, b, 3).collect()
    assert top[0]["key"] == "d1" and len(top) == 3
    assert top[0]["score"] == pytest.approx(1 / 61)
    with pytest.raises(ValueError):
        fusion.search_hybrid(a.withColumn("text", F.lit("x")).withColumn("vector", F.array(F.lit(1.0))), "x", [1.0], fusion="other")


def test_latest_prefers_higher_version_and_breaks_ties(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "p"), ("b", 1, "q"), (None, 1, "n")], "key string, seq long, v string")
    assert {r["key"]: r["v"] for r in store.latest(rows).collect()} == {"a": "y", "b": "q", None: "n"}
    assert store.latest(rows.limit(0)).count() == 0


def test_compaction_rules():
    assert not store.needs_compaction(100, 10) and store.needs_compaction(100, 11) and not store.needs_compaction(0, 5)
    assert store.hot_is_full(80, 100) and not store.hot_is_full(79, 100)


def test_shards(spark, tmp_path):
    d = spark.range(200).withColumnRenamed("id", "key")
    sharding.write_sharded(d, str(tmp_path / "s"), 4)
    part = sharding.read_shard(spark, str(tmp_path / "s"), 17, 4)
    assert part.where("key = 17").count() == 1 and part.count() < 200
    shard = int(hashlib.md5(b"17").hexdigest()[:8], 16) % 4
    assert {r["shard"] for r in part.select("shard").distinct().collect()} == {shard}
    with pytest.raises(ValueError, match="insufficient_nodes"):
        sharding.placement(spark, 4, ["a"], 2)
    with pytest.raises(ValueError, match="same_shard_count"):
        sharding.reshard(d, 4, 4)
    promoted = spark.range(1).select(sharding.promote(F.array(F.lit("a"), F.lit("b")), F.lit("b")).alias("r")).first()["r"]
    assert promoted == ["b", "a"]


def test_token_bucket(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()
    times = [0, 0, 0, 10, 30, 31, 500]
    rows = [("t", i, datetime.fromtimestamp(t0 + s, timezone.utc)) for i, s in enumerate(times)]
    got = {r["seq"]: r["allowed"] for r in tenancy.token_bucket(spark.createDataFrame(rows, "tenant string, seq long, ts timestamp"), 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_tenants(spark):
    names = spark.createDataFrame([("O'Neil \\ ü",)], "t string").select(tenancy.collection_name(F.col("t"), F.lit("docs")).alias("name"))
    assert [r["own_name"] for r in tenancy.owned(names, "O'Neil \\ ü").collect()] == ["docs"]
    assert tenancy.owned(names, "other").count() == 0
    ops = spark.createDataFrame([("a", 1, 5), ("a", 2, -9), ("a", 3, 2)], "tenant string, seq long, delta long")
    assert [r["usage"] for r in tenancy.clamped_usage(ops).orderBy("seq").collect()] == [5, 0, 2]
    assert tenancy.quota_checks(ops.withColumn("n", F.lit(1)), None).where("allowed").count() == 3


def test_refused_operations_use_nothing(spark):
    ops = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("a", 4, 1), ("b", 1, 11), ("b", 2, None), (None, 1, 10), (None, 2, 1)], "tenant string, seq long, n long")
    got = [(r["tenant"], r["seq"], r["used"], r["allowed"]) for r in tenancy.quota_checks(ops, 10).collect()]
    assert sorted(got, key=str) == sorted([("a", 1, 6, True), ("a", 2, 6, False), ("a", 3, 10, True), ("a", 4, 10, False), ("b", 1, 0, False), ("b", 2, 0, True), (None, 1, 10, True), (None, 2, 10, False)], key=str)
    assert tenancy.quota_checks(ops.limit(0), 10).count() == 0


def test_gateway(spark):
    keys = spark.createDataFrame([("k1", "t", 0, 2, 5, None, None), ("k2", "t", 0, 99, 99, None, None), ("k3", "u", 0, None, None, None, None)], tenancy.KEYS)
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    asked = [(1, "k1", "t", 4, 0), (2, "k2", "t", 2, 1), (3, "k1", "t", 1, 2), (4, "k2", "t", 1, 60), (5, "k1", "t", 0, 61), (6, "k9", "t", 1, 1), (7, "k3", "t", 1, 1), (8, "k3", "u", 9, 1), (9, None, "u", 9, 1)]
    requests = spark.createDataFrame([(s, k, t, n, at(x)) for s, k, t, n, x in asked], "seq long, key string, tenant string, vectors long, ts timestamp")
    got = {r["seq"]: (r["status"], r["reason"]) for r in tenancy.gateway(requests, keys).collect()}
    full, slow = (403, "vector_quota_exceeded"), (429, "rate_limit_exceeded")
    # the limits of the first key; the bucket is empty at 2 s and has one token and more at 60 s
    assert got == {1: (200, None), 2: full, 3: slow, 4: (200, None), 5: (200, None), 6: (401, "invalid_key"), 7: (403, "forbidden"), 8: (200, None), 9: (401, "invalid_key")}


def test_key_lifecycle(spark):
    keys = spark.createDataFrame([], tenancy.KEYS)
    keys = tenancy.create_key(keys, "t", "secret", 1, rpm_limit=7)
    with pytest.raises(ValueError, match="already_exists"):
        tenancy.create_key(keys, "u", "secret", 2)
    asked = spark.createDataFrame([("secret",), ("other",)], "key string")
    got = {r["key"]: (r["tenant_id"], r["rpm_limit"], r["max_vectors"]) for r in tenancy.validate(asked, keys).collect()}
    assert got == {"secret": ("t", 7, 100_000), "other": (None, None, None)}
    assert tenancy.revoke_key(tenancy.revoke_key(keys, "secret"), "secret").count() == 0


def test_compare_runs(spark):
    make = lambda x: spark.createDataFrame([("a", 100.0 * x, 1.0), ("b", 100.0, 1.0 / x), ("c", 100.0, 1.0)], "name string, ops_per_sec double, p95 double")
    got = {r["name"]: r["verdict"] for r in metrics.compare_runs(make(1.0), make(0.8)).collect()}
    assert got == {"a": "regression", "b": "regression", "c": "unchanged"}
