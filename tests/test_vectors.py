import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import graphs, knn, quant
from nearfield.plans import registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dot_and_distances(spark):
    a, b = V.literal([1, 2, 3, 4]), V.literal([1, 2, 3, 4])
    assert one(spark, V.dot(a, b)) == 30
    assert one(spark, V.dot(V.literal([1, 2, 3]), V.literal([-1, -2, -3]))) == -14
    assert one(spark, V.cosine_distance(a, b)) == pytest.approx(0)
    assert one(spark, V.cosine_distance(V.literal([1, 0]), V.literal([0, 1]))) == pytest.approx(1)
    assert one(spark, V.cosine_distance(V.literal([1, 0]), V.literal([-1, 0]))) == pytest.approx(2)
    assert one(spark, V.cosine_distance(V.literal([0, 0]), V.literal([1, 0]))) == 1
    assert one(spark, V.euclidean_distance(V.literal([0, 0]), V.literal([3, 4]))) == pytest.approx(5)
    with pytest.raises(ValueError):
        V.distance("manhattan", a, b)


def test_int8_rounds_half_away_from_zero(spark):
    assert one(spark, V.int8_codes(V.literal([127.0, 0.5, -0.5, 1.5]))) == [127, 1, -1, 2]
    assert one(spark, V.int8_codes(V.literal([0.0, 0.0]))) == [0, 0]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-0.5, 0.5, (400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "key long, vector array<float>, tag int").cache()


def test_post_filter_may_leave_fewer(spark, docs):
    q = docs.where("key = 3").first()["vector"]
    found = knn.search_vector(docs, q, 10, post_filter=F.col("tag") == 1, columns=["tag"]).collect()
    assert found[0]["key"] == 3 and found[0]["score"] == pytest.approx(1, abs=1e-6)
    assert len(found) < 10 and all(r["tag"] == 1 for r in found)
    assert knn.search_vector(docs, q, 10, pre_filter=F.col("tag") == 1).count() == 10


def test_batch_search_matches_single(spark, docs, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_FLOATS", 16 * 3)  # several blocks of queries
    q = docs.where("key < 8").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    for metric in ("cosine", "euclidean", "inner_product", "cosine_normalized"):
        got = {(r["query_id"], r["rank"]): r["key"] for r in knn.search_batch(docs, q, 4, metric=metric).collect()}
        for r in q.where("query_id in (0, 7)").collect():
            want = [x["key"] for x in knn.search_vector(docs, r["query_vector"], 4, metric=metric).orderBy("rank").collect()]
            assert [got[(r["query_id"], k)] for k in range(1, 5)] == want


def test_batch_search_of_nothing(spark, docs):
    q = docs.where("key < 0").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    assert knn.search_batch(docs, q, 3).count() == 0


def test_dimension_guard(spark, docs):
    rows = docs.limit(5).unionByName(spark.createDataFrame([(99, [1.0], 0), (98, None, 0)], docs.schema))
    good, bad = knn.dimension_guard(rows, 16)
    assert good.count() == 5
    assert sorted(r["error"] for r in bad.collect()) == ["dimension_mismatch: expected 16, got -1", "dimension_mismatch: expected 16, got 1"]


def test_graph_recall_and_deletes(spark, docs):
    x = np.array([r["vector"] for r in docs.orderBy("key").collect()], float)
    g = graphs.Vamana(x, degree=16, width=48)
    exact = lambda q, alive: [i for _, i in sorted((1 - x[i] @ q, i) for i in alive)][:10]
    hits = sum(len({i for _, i in g.search(x[q], 10)} & set(exact(x[q], range(400)))) for q in range(0, 400, 20))
    assert hits / 200 >= 0.9
    for i in range(0, 100):
        g.delete(i)
    assert g.needs_consolidation()
    assert not {i for _, i in g.search(x[150], 10)} & g.deleted
    g.consolidate()
    assert not g.deleted and all(j >= 100 for own in g.links.values() for j in own)
    new = g.insert_many([x[0], x[1]])
    assert g.search(x[0], 1)[0][1] == new[0]
    assert g.search(x[300], 1)[0][1] == 300
    assert g.insert(x[2]) == new[-1] + 1
    h = graphs.Hnsw(m=8, width=60)
    for v in x:
        h.insert(v)
    hits = sum(len({i for _, i in h.search(x[q], 10)} & set(exact(x[q], range(400)))) for q in range(0, 400, 20))
    assert hits / 200 >= 0.9
    for i in range(50):
        h.delete(i)
    assert all(i >= 50 for _, i in h.search(x[10], 10))


@pytest.mark.parametrize("floats", [4_000_000, 8 * 30])
def test_graph_recall_asks_every_fiftieth_id(spark, tmp_path, monkeypatch, floats):
    monkeypatch.setattr(knn, "BLOCK_FLOATS", floats)  # one block of queries, or four
    x = np.random.default_rng(8).normal(size=(120, 8))
    rows = [(50 * i if i < 100 else 50 * i + 1, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked, plain = [], knn.recall

    def spy(found, exact, k, *, keys):
        asked.extend(sorted(r["query"] for r in df.select("query").distinct().collect()) for df in (found, exact))
        return plain(found, exact, k, keys=keys)

    monkeypatch.setattr(knn, "recall", spy)
    report = registry.QUERIES["vamana_recall"](spark, str(tmp_path)).first()
    assert asked[0] == asked[1] and len(asked[0]) == 100
    assert report["nodes"] == 120 and report["recall"] >= 0.9


def test_hnsw_query_finds_neighbours_in_clusters(spark, tmp_path):
    """Layer 0 links clusters hardly at all, so a beam from one entry stays in one of them."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 16))
    x = centres[np.arange(800) % 8] + 0.1 * rng.normal(size=(800, 16))
    rows = [(50 * i, v.tolist()) for i, v in enumerate(x)]  # each is a query
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["hnsw_recall"](spark, str(tmp_path)).first()["recall"] >= 0.9


@pytest.mark.parametrize("kind", ["vamana", "hnsw"])
def test_graph_tables(spark, docs, kind):
    """Insert, delete, consolidate and insert again; only shards that are touched change."""
    from nearfield.session import shared_dir

    shared_dir(spark)
    first = docs.where("key < 300")
    graph = graphs.build_graph(first, kind, shards=3).checkpoint()
    grown = graphs.insert_into_graph(graph, first, docs.where("key >= 290"), kind, shards=3).checkpoint()
    assert grown.where("layer = 0").count() == 400
    same = graphs.insert_into_graph(grown, docs, docs.where("key < 5"), kind, shards=3)
    assert sorted(map(str, same.collect())) == sorted(map(str, grown.collect()))
    marked = graphs.delete_from_graph(grown, spark.createDataFrame([(i,) for i in range(0, 400, 3)] + [(9999,)], "key long")).checkpoint()
    assert {r["shard"] for r in graphs.shards_to_consolidate(marked).collect()} == {0, 1, 2} and graphs.shards_to_consolidate(grown).count() == 0
    asked = docs.where("key % 20 = 1").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    left = docs.where("key % 3 <> 0")
    exact = knn.search_batch(left, asked, 10).withColumnRenamed("query_id", "query")
    clean = graphs.consolidate_graph(marked, docs, kind, shards=3).checkpoint()
    for g, total in ((marked, 400), (clean, left.count())):
        assert g.where("layer = 0").count() == total
        found = graphs.search_graph(docs, g, asked, 10, shards=3)
        assert found.where("key % 3 = 0").count() == 0
        assert knn.recall(found, exact, 10, keys=["query", "key"]).first()["recall"] >= 0.9
    assert clean.where("deleted").count() == 0 and clean.select(F.explode("neighbours").alias("n")).where("n % 3 = 0").count() == 0
    assert graphs.insert_into_graph(graph.limit(0), docs.limit(0), docs, kind, shards=3).where("layer = 0").count() == 400


def test_graph_search_on_codes(spark, docs):
    graph = graphs.build_graph(docs, shards=2)
    asked = docs.where("key % 20 = 1").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    pq = quant.ProductQuantizer.fit(quant.sample_matrix(docs, "vector"), 8, 64)
    found = graphs.search_graph_codes(docs, graph, asked, pq, 10, shards=2)
    exact = knn.search_batch(docs, asked, 10).withColumnRenamed("query_id", "query")
    assert knn.recall(found, exact, 10, keys=["query", "key"]).first()["recall"] >= 0.9


def test_spread_centroids():
    x = np.repeat(np.array([[0.0, 0], [9, 9], [-9, 5], [4, -8]]), 50, axis=0) + np.random.default_rng(2).normal(0, 0.1, (200, 2))
    pq = quant.ProductQuantizer.fit(x, 1, 4, spread=True)
    assert np.abs(pq.decode(pq.encode(x)) - x).max() < 1
    assert quant.ProductQuantizer.fit(np.ones((5, 4)), 2, 3, spread=True).codebooks.shape == (2, 3, 2)


def test_nearest_is_the_start_of_a_stable_sort():
    d = np.random.default_rng(6).integers(0, 9, (40, 200)).astype(float)
    d[3] = np.inf
    for k in (1, 5, 30, 60, 300):
        assert (knn.nearest(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_many_queries_hold_a_bounded_matrix(spark, monkeypatch):
    """60,000 queries against 300 rows: the nearest of each is itself."""
    rows = spark.range(300).select(F.col("id").alias("key"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    asked = spark.range(60_000).select(F.col("id").alias("query_id"), F.array((F.col("id") % 300).cast("float"), F.lit(1.0).cast("float")).alias("query_vector"))
    got = knn.search_batch(rows, asked, 1, metric="euclidean")
    assert got.count() == 60_000 and got.where("key <> query_id % 300").count() == 0


def test_prune_keeps_nearest_and_degree():
    space = graphs.Space(np.array([[0, 0], [1, 0], [1.1, 0], [0, 2.0]]), "euclidean")
    assert graphs.prune(space, 0, [1, 2, 3], 1.2, 8) == [1, 3]
    assert graphs.prune(space, 0, [1, 2, 3], 1.2, 1) == [1]


def test_codec_sizes_and_errors():
    assert quant.polar_bytes(64, 3) == 88 and quant.polar_bytes(768, 3) == 1012
    assert [quant.subspaces_for(d) for d in (128, 256, 512, 1024, 2048, 4096)] == [1, 2, 4, 8, 16, 32]
    for bad in (lambda: quant.PolarCodec(7), lambda: quant.PolarCodec(8, 5), lambda: quant.SubspaceCodec(10, 4), lambda: quant.check_pq(10, 4, 16), lambda: quant.check_pq(8, 4, 300)):
        with pytest.raises(ValueError):
            bad()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for c in (quant.PolarCodec(32, 4), quant.SubspaceCodec(32, 2, 4)):
        codes = c.encode(x)
        assert {len(b) for b in codes} == {c.code_bytes}
        back = c.decode(codes)
        assert np.linalg.norm(back - x, axis=1).mean() < 0.3
        true = np.linalg.norm(x - x[0], axis=1)
        assert np.abs(c.distances(x[0], codes) - true)[1:].mean() < 0.15
        assert c.encode(x[:3]) == c.encode(x[:3])
    pq = quant.ProductQuantizer.fit(x, 4, 16)
    codes = pq.encode(x)
    assert codes.shape == (300, 4) and pq.info()["bytes"] == 4
    d = quant.asymmetric_distance(pq.table(x[0]), codes)
    assert np.allclose(d, np.linalg.norm(pq.decode(codes) - x[0], axis=1))
    assert np.isfinite(quant.PolarCodec(8).decode(quant.PolarCodec(8).encode(np.zeros((1, 8))))).all()
    assert math.isclose(quant.ProductQuantizer.fit(np.ones((3, 8)), 2, 4).decode(np.zeros((1, 2), np.uint8)).sum(), 8)


@pytest.fixture(scope="module")
def hard():
    """Vectors without structure: each one's neighbours are hardly nearer than the others."""
    x = np.random.default_rng(11).normal(size=(1500, 48))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def walk_of(g, gone=()):
    return graphs.Walk(g.space, [g.links] if isinstance(g, graphs.Vamana) else g.layers, [g.entry], set(gone))


@pytest.mark.parametrize("kind", ["vamana", "hnsw"])
def test_marks_dont_widen_beams(hard, kind, monkeypatch):
    """A third marked: as many distances as without marks, not as many as there are marks, and no marked node is found."""
    g = graphs.Vamana(hard) if kind == "vamana" else graphs.Hnsw()
    if kind == "hnsw":
        g.insert_many(hard)
    asked, plain, count = hard[::50], graphs.Space.pairs, []
    monkeypatch.setattr(graphs.Space, "pairs", lambda self, points, rows, ids: count.append(len(ids)) or plain(self, points, rows, ids))
    walk_of(g).walk(asked, 10, 16)
    clean = sum(count)
    count.clear()
    found, _ = walk_of(g, range(0, 1500, 3)).walk(asked, 10, 16)
    assert (found % 3 != 0).all() and sum(count) < 2 * clean


def test_a_build_prunes_targets_once_for_a_batch(hard, monkeypatch):
    pruned, plain = [], graphs.prune_many
    monkeypatch.setattr(graphs, "prune_many", lambda space, p, *rest: pruned.append(len(p)) or plain(space, p, *rest))
    g = graphs.Vamana(hard)
    assert sum(pruned) < 16 * len(hard) and len(pruned) < 200  # one by one: two passes, up to 33 a node
    assert all(len(own) <= 32 and len(set(own)) == len(own) and i not in own for i, own in g.links.items())
    h = graphs.Hnsw()
    assert h.insert_many(hard) == list(range(1500)) and h.insert_many(hard[:2]) == [1500, 1501]
    assert all(len(set(own)) == len(own) <= (16 if k else 32) and i not in own for k, layer in enumerate(h.layers) for i, own in layer.items())


def test_code_candidates_of_each_shard_are_ranked(spark, hard):
    """Coarse codes of unstructured vectors: the nearest by code over all shards have too few true neighbours, those of each shard have."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(hard)], "key long, vector array<float>").cache()
    graph = graphs.build_graph(rows, shards=6).cache()
    asked = rows.where("key % 25 = 0").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    pq = quant.ProductQuantizer.fit(hard, 12, 64)
    found = graphs.search_graph_codes(rows, graph, asked, pq, 10, over=2, shards=6)
    exact = knn.search_batch(rows, asked, 10).withColumnRenamed("query_id", "query")
    assert knn.recall(found, exact, 10, keys=["query", "key"]).first()["recall"] >= 0.9


@pytest.mark.parametrize("kind", ["vamana", "hnsw"])
def test_narrow_beams_widen_until_neighbours_are_found(hard, kind):
    """After inserts and after a fourth is removed, the width that a shard takes from 10 on finds the neighbours."""
    if kind == "vamana":
        g = graphs.Vamana(hard[:1350])
    else:
        g = graphs.Hnsw()
        g.insert_many(hard[:1350])
    g.insert_many(hard[1350:])
    for gone in (set(), set(range(1, 1500, 4))):
        w = walk_of(g, gone)
        edge = w.scan(hard[::10], 10)[1][:, -1:] + 1e-9
        wide = w.width_for(hard[:1500:24], 10, 10)
        assert (w.walk(hard[::10], 10, wide)[1] <= edge).mean() >= 0.9
    if kind == "vamana":
        g.deleted = set(range(1, 1500, 4))
        g.consolidate()
    else:
        g.delete_many(set(range(1, 1500, 4)))
    layers = [g.links] if kind == "vamana" else g.layers
    assert all(j % 4 != 1 for layer in layers for i, own in layer.items() for j in [i, *own])


@pytest.mark.parametrize("kind", ["vamana", "hnsw"])
def test_copies_share_a_node(spark, hard, kind):
    """Each vector under seven keys: of equals the smallest live keys are found, after inserts, marks and consolidation."""
    from nearfield.session import shared_dir

    shared_dir(spark)
    rows = spark.createDataFrame([(300 * c + i, v.tolist()) for c in range(7) for i, v in enumerate(hard[:300])], "key long, vector array<float>").cache()
    asked = rows.where("key % 20 = 0 AND key < 300").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    first, gone = rows.where("key % 10 <> 7"), "(key < 300 OR key % 4 = 1)"
    graph = graphs.build_graph(first, kind, shards=2).checkpoint()
    grown = graphs.insert_into_graph(graph, first, rows.where("key % 10 IN (7, 8)"), kind, shards=2).checkpoint()
    marked = graphs.delete_from_graph(grown, rows.where(gone)).checkpoint()
    clean = graphs.consolidate_graph(marked, rows, kind, shards=2).checkpoint()
    for g, live in ((grown, rows), (marked, rows.where(f"NOT {gone}")), (clean, rows.where(f"NOT {gone}"))):
        assert g.where("layer = 0 AND NOT deleted").select("id").distinct().count() == g.where("layer = 0 AND NOT deleted").count() == live.count()
        exact = knn.search_batch(live, asked, 10).withColumnRenamed("query_id", "query")
        assert knn.recall(graphs.search_graph(rows, g, asked, 10, shards=2), exact, 10, keys=["query", "key", "rank"]).first()["recall"] >= 0.99
    assert clean.where("layer = 0").count() == 1350 and graphs.average_degree(graph).first()["average_degree"] < 16
    pq = quant.ProductQuantizer.fit(hard[:300], 12, 64)
    exact = knn.search_batch(rows, asked, 10).withColumnRenamed("query_id", "query")
    assert knn.recall(graphs.search_graph_codes(rows, grown, asked, pq, 10, shards=2), exact, 10, keys=["query", "key"]).first()["recall"] >= 0.9


@pytest.mark.parametrize("kind", ["vamana", "hnsw"])
def test_inserted_copies_join_nodes(spark, hard, kind):
    """A copy of a marked key makes its node live again, a smaller key takes the links, and no key is lost."""
    stored = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(hard[:60])], "key long, vector array<float>")
    new = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(hard[:70])], "key long, vector array<float>")
    graph = graphs.delete_from_graph(graphs.build_graph(stored, kind), stored.where("key < 1010"))
    grown = graphs.insert_into_graph(graph, stored, new, kind).cache()
    rows = {r["id"]: r for r in grown.where("layer = 0").collect()}
    assert sorted(rows) == [*range(70), *range(1000, 1060)] and {i for i, r in rows.items() if r["deleted"]} == set(range(1000, 1010))
    assert all(rows[1000 + i]["neighbours"] == [i] for i in range(60)) and all(j < 70 for r in rows.values() for j in r["neighbours"])
    both = stored.unionByName(new)
    asked = new.where("key < 20").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    found = graphs.search_graph(both, grown, asked, 2)
    got = {(r["query"], r["key"]) for r in found.collect()}
    assert {(i, i) for i in range(20)} | {(i, 1000 + i) for i in range(10, 20)} <= got and not any(1000 <= j < 1010 for _, j in got)


def test_beams_leave_a_family_of_near_copies():
    """A third are near copies of one vector, the medoid among them: the others are found too, after a build and an insert."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + rng.normal(size=(500, 64)) * 0.0125
    g = graphs.Vamana(x[np.arange(1500) % 10 != 7], degree=8, width=16)
    g.insert_many(x[np.arange(1500) % 10 == 7])
    w, asked = walk_of(g), g.space.x[::7]
    assert (w.walk(asked, 10, 64)[1] <= w.scan(asked, 10)[1][:, -1:] + 1e-9).mean() >= 0.75


def test_a_width_is_measured_on_enough_queries():
    """A tenth of the queries that finds nothing hardly ever passes for less than a twentieth."""
    few = int((1 - graphs.AIM) * graphs.SAMPLE + 1e-9)
    assert sum(math.comb(graphs.SAMPLE, i) * 0.1**i * 0.9 ** (graphs.SAMPLE - i) for i in range(few + 1)) < 0.01
