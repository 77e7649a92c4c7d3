"""Queries over vectors."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..operators import graphs, indexes, knn, quant, store
from ..session import shared_dir, table
from .registry import query

DIMENSION = 64


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """A stored vector as the query; the filter reaches the scan."""
    return list(store.get(embeddings(spark, sf_dir), vec_id, "vec_id").first()["embedding"])


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = "CASE WHEN sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) < 1e-10 THEN 1.0 ELSE 1.0 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) END"
_E = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _topk_sql(distance: str, k: int = 10, where: str = "", after: str = "") -> str:
    return f"""WITH {_Q}, {_E}, d AS (SELECT vec_id, label, {distance} AS d FROM v, q {where}),
        t AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS rank FROM d)
        SELECT CAST(rank AS INTEGER) AS rank, vec_id, round(1.0 - d, 6) AS score FROM t WHERE rank <= {k} {after}"""


def _scores(df: DataFrame) -> DataFrame:
    return df.select("rank", "vec_id", F.round("score", 6).alias("score"))


def _knn(metric: str, k: int = 10, **options):
    def run(spark, sf_dir):
        return _scores(knn.search_vector(embeddings(spark, sf_dir), vector_of(spark, sf_dir), k, metric=metric, key="vec_id", vector="embedding", **options))

    return run


@query(_topk_sql(_COS))
def knn_cosine(spark, sf_dir):
    return _knn("cosine")(spark, sf_dir)


@query(_topk_sql("1.0 - list_dot_product(e, q)"))
def knn_cosine_normalized(spark, sf_dir):
    return _knn("cosine_normalized")(spark, sf_dir)


@query(_topk_sql("sqrt(list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"))
def knn_euclidean(spark, sf_dir):
    return _knn("euclidean")(spark, sf_dir)


@query(_topk_sql("-list_dot_product(e, q)"))
def knn_dot(spark, sf_dir):
    return _knn("inner_product")(spark, sf_dir)


@query(_topk_sql(_COS, 50, after="AND label = 3"))
def knn_postfilter(spark, sf_dir):
    """The predicate concerns the 50 hits, so fewer stay."""
    return _knn("cosine", 50, post_filter=F.col("label") == 3, columns=["label"])(spark, sf_dir)


@query(_topk_sql(_COS, 10, where="WHERE label = 3"))
def knn_prefilter(spark, sf_dir):
    return _knn("cosine", 10, pre_filter=F.col("label") == 3)(spark, sf_dir)


@query(
    """SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
       round((embedding::DOUBLE[])[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_component,
       round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS self_dot FROM embeddings"""
)
def vector_norms(spark, sf_dir):
    v = F.col("embedding")
    return embeddings(spark, sf_dir).select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(F.get(V.normalize(v), F.lit(0)), 6).alias("first_component"), F.round(V.dot(v, v), 6).alias("self_dot"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
       p AS (SELECT a.vec_id AS query_id, b.vec_id, 1.0 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS d
             FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)
       SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM r WHERE rank <= 5"""
)
def knn_join_top5(spark, sf_dir):
    """Every fiftieth row as a query against all rows."""
    e = embeddings(spark, sf_dir)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = knn.search_batch(e, q, 5, key="vec_id", vector="embedding", exclude_same=True)
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query(_topk_sql(_COS))
def knn_per_shard_merge(spark, sf_dir):
    """2k from each of four shards, merged; the same as over the whole."""
    rows = embeddings(spark, sf_dir).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    return _scores(knn.search_sharded(rows, vector_of(spark, sf_dir), 10, key="vec_id", vector="embedding"))


@query(_topk_sql(_COS, 10, where="WHERE vec_id % 3 <> 1"))
def knn_without_deleted(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return _scores(knn.search_alive(e, e.where("vec_id % 3 = 1"), vector_of(spark, sf_dir), 10, key="vec_id", vector="embedding"))


@query(
    f"""WITH {_Q}, v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings),
        d AS (SELECT vec_id, {_COS} AS d FROM v, q)
        SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(1.0 - d, 6) AS score FROM d ORDER BY d, vec_id LIMIT 10"""
)
def knn_hot_over_base(spark, sf_dir):
    """A hot layer replaces every seventh vector by its opposite."""
    e = embeddings(spark, sf_dir).select("vec_id", V.doubles(F.col("embedding")).alias("embedding"))
    hot = e.where("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return _scores(knn.search_layers(hot, e, vector_of(spark, sf_dir), 10, key="vec_id", vector="embedding"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
       c AS (SELECT list(m ORDER BY pos) AS q FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY pos)),
       d AS (SELECT vec_id, """
    + _COS
    + """ AS d FROM v, c) SELECT vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 1"""
)
def medoid(spark, sf_dir):
    return knn.medoid(embeddings(spark, sf_dir), key="vec_id", vector="embedding").select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    """SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM
       (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos"""
)
def vector_mean_by_label(spark, sf_dir):
    c = knn.centroid(embeddings(spark, sf_dir), "embedding", by="label")
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


_INT8 = """i AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS s FROM embeddings),
       c AS (SELECT vec_id, e, s, sqrt(list_dot_product(e, e)) AS n, list_transform(e, lambda x: greatest(-127, least(127, round(x * 127.0 / s)))) AS codes FROM i)"""


@query(f"WITH {_INT8} SELECT vec_id, round(s, 6) AS scale, CAST(list_sum(list_transform(codes, lambda x: abs(x))) AS BIGINT) AS magnitude, CAST(codes[1] AS INTEGER) AS first_code FROM c")
def scalar_quantize(spark, sf_dir):
    t = knn.int8_table(embeddings(spark, sf_dir), "vec_id", "embedding")
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + F.abs(x))
    return t.select("vec_id", F.round("scale", 6).alias("scale"), total.alias("magnitude"), F.get("codes", F.lit(0)).alias("first_code"))


_INT8_TOP = f"""WITH {_INT8}, d AS (SELECT a.vec_id, 1.0 - list_dot_product(a.codes::DOUBLE[], b.codes::DOUBLE[]) * a.s * b.s / 16129.0 / (a.n * b.n) AS d FROM c a, c b WHERE b.vec_id = 0)"""


@query(_INT8_TOP + " SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10")
def int8_cosine_topk(spark, sf_dir):
    t = knn.int8_table(embeddings(spark, sf_dir), "vec_id", "embedding")
    return knn.search_int8(t, vector_of(spark, sf_dir), 10, key="vec_id").select("rank", "vec_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_INT8}, d AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.codes, b.codes), lambda p: (p[1] * a.s / 127.0 - p[2] * b.s / 127.0) * (p[1] * a.s / 127.0 - p[2] * b.s / 127.0)))) AS d FROM c a, c b WHERE b.vec_id = 0)
        SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10"""
)
def int8_euclidean_topk(spark, sf_dir):
    t = knn.int8_table(embeddings(spark, sf_dir), "vec_id", "embedding")
    return knn.search_int8(t, vector_of(spark, sf_dir), 10, key="vec_id", metric="euclidean").select("rank", "vec_id", F.round("distance", 6).alias("distance"))


def _int8_candidates(spark, sf_dir, n: int):
    return knn.search_int8(knn.int8_table(embeddings(spark, sf_dir), "vec_id", "embedding"), vector_of(spark, sf_dir), n, key="vec_id")


@query(
    _INT8_TOP
    + f""", t AS (SELECT vec_id FROM d ORDER BY d, vec_id LIMIT 40), {_Q}, {_E}, x AS (SELECT v.vec_id, {_COS} AS d FROM v JOIN t ON v.vec_id = t.vec_id, q)
        SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(1.0 - d, 6) AS score FROM x ORDER BY d, vec_id LIMIT 10"""
)
def rerank_int8_exact(spark, sf_dir):
    """Four times as many candidates by code, then the true distances."""
    e = embeddings(spark, sf_dir)
    return _scores(knn.rerank(_int8_candidates(spark, sf_dir, 40), e, vector_of(spark, sf_dir), 10, key="vec_id", vector="embedding"))


@query(
    _INT8_TOP
    + f""", a AS (SELECT vec_id FROM d ORDER BY d, vec_id LIMIT 10), {_Q}, {_E}, x AS (SELECT vec_id, {_COS} AS d FROM v, q), b AS (SELECT vec_id FROM x ORDER BY d, vec_id LIMIT 10)
        SELECT (SELECT count(*) FROM a JOIN b ON a.vec_id = b.vec_id) / CAST((SELECT count(*) FROM b) AS DOUBLE) AS recall"""
)
def recall_int8(spark, sf_dir):
    exact = knn.search_vector(embeddings(spark, sf_dir), vector_of(spark, sf_dir), 10, key="vec_id", vector="embedding")
    return knn.recall(_int8_candidates(spark, sf_dir, 10), exact, 10, keys=["vec_id"])


@query("""SELECT CASE WHEN len(CASE WHEN vec_id % 10 = 3 THEN embedding[1:32] ELSE embedding END) = 64 THEN 'accepted' ELSE 'rejected' END AS verdict, count(*) AS n FROM embeddings GROUP BY 1""")
def dimension_guard(spark, sf_dir):
    """Every tenth vector cut in half, and what the guard says."""
    cut = embeddings(spark, sf_dir).withColumn("embedding", F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    good, bad = knn.dimension_guard(cut, DIMENSION, "embedding")
    both = good.select(F.lit("accepted").alias("verdict")).unionByName(bad.select(F.lit("rejected").alias("verdict")))
    return both.groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS t, e AS q FROM v WHERE vec_id < 4),
       m AS (SELECT label, t, max(list_dot_product(e, q)) AS best FROM v, q GROUP BY label, t)
       SELECT label, round(sum(best), 6) AS score FROM m GROUP BY label ORDER BY sum(best) DESC, label LIMIT 5"""
)
def max_sim(spark, sf_dir):
    """Labels as documents of many token vectors, four vectors as the query's tokens."""
    e = embeddings(spark, sf_dir)
    tokens = [list(r["embedding"]) for r in e.where("vec_id < 4").orderBy("vec_id").collect()]  # four rows
    return knn.max_sim(e, tokens, 5, doc="label", vector="embedding").select("label", F.round("score", 6).alias("score"))


@query(
    """SELECT * FROM (VALUES ('pq', 64, 8, 32.0), ('pq', 128, 8, 64.0), ('pq', 256, 8, 128.0), ('polar2', 768, 964, 768 * 4.0 / 964), ('polar3', 64, 100 - 12, 256.0 / 88), ('polar3', 768, 1012, 3072.0 / 1012),
       ('polar4', 768, 1060, 3072.0 / 1060)) AS t(codec, dimension, bytes, ratio)"""
)
def codec_sizes(spark, sf_dir):
    """What the codecs say of their codes' bytes."""
    pq = [("pq", d, quant.ProductQuantizer(np.zeros((8, 1, d // 8))).info()["bytes"]) for d in (64, 128, 256)]
    polar = [(f"polar{bits}", d, quant.polar_bytes(d, bits)) for d, bits in ((768, 2), (64, 3), (768, 3), (768, 4))]
    rows = spark.createDataFrame(pq + polar, "codec string, dimension int, bytes int")
    return rows.select("codec", "dimension", "bytes", (F.col("dimension") * 4.0 / F.col("bytes")).alias("ratio"))


@query("SELECT vec_id, 256 AS bytes, TRUE AS same FROM embeddings")
def vector_binary(spark, sf_dir):
    """Vectors packed as 32-bit floats and unpacked again."""
    p = embeddings(spark, sf_dir).select("vec_id", "embedding", quant.pack_column(F.col("embedding")).alias("packed"))
    return p.select("vec_id", F.octet_length("packed").alias("bytes"), (quant.unpack_column(F.col("packed")) == F.col("embedding")).alias("same"))


@query("SELECT count(*) AS nodes, TRUE AS bounded FROM embeddings WHERE embedding IS NOT NULL")
def average_degree(spark, sf_dir):
    """Of a graph index over the vectors: its nodes, and whether the mean degree is within the index's bound."""
    e = embeddings(spark, sf_dir)
    graph = graphs.build_graph(e, shards=graphs.shards_for(e.count()), key="vec_id", vector="embedding")
    return graphs.average_degree(graph).select("nodes", F.col("average_degree").between(1, 32).alias("bounded"))


@query()
def pq_search(spark, sf_dir):
    """Product quantization: candidates by code distance, reranked by the true one."""
    e = embeddings(spark, sf_dir)
    pq = quant.ProductQuantizer.fit(quant.sample_matrix(e, "embedding", key="vec_id"), 8, 256)
    return _scores(quant.search_codes(e, pq, vector_of(spark, sf_dir), 10, over=8, key="vec_id", vector="embedding"))


@query()
def polar_search(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return _scores(quant.search_codes(e, quant.PolarCodec(DIMENSION), vector_of(spark, sf_dir), 10, over=8, key="vec_id", vector="embedding"))


@query()
def subspace_search(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return _scores(quant.search_codes(e, quant.SubspaceCodec(DIMENSION, 4), vector_of(spark, sf_dir), 10, over=8, key="vec_id", vector="embedding"))


@query()
def codec_errors(spark, sf_dir):
    """The mean relative error of decoded vectors, by codec."""
    e = embeddings(spark, sf_dir)
    codecs = {"pq": quant.ProductQuantizer.fit(quant.sample_matrix(e, "embedding", key="vec_id"), 8, 256), "polar": quant.PolarCodec(DIMENSION), "subspace": quant.SubspaceCodec(DIMENSION, 4)}
    out = None
    for name, c in codecs.items():
        back = quant.decode_column(spark, c, quant.encode_column(spark, c, F.col("embedding")))
        one = e.select("embedding", back.alias("back")).agg(F.avg(V.euclidean_distance(F.col("embedding"), F.col("back")) / V.norm(F.col("embedding"))).alias("error")).select(F.lit(name).alias("codec"), "error")
        out = one if out is None else out.unionByName(one)
    return out


def _asked(e):
    """Every fiftieth id as a query."""
    return e.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _exact(e, asked):
    return knn.search_batch(e, asked, 10, key="vec_id", vector="embedding").withColumnRenamed("query_id", "query")


def _graph_recall(kind: str, spark, sf_dir):
    """Over all vectors, every fiftieth id as a query."""
    e = embeddings(spark, sf_dir)
    shards = graphs.shards_for(e.count())
    asked = _asked(e)
    shared_dir(spark)
    graph = graphs.build_graph(e, kind, shards=shards, key="vec_id", vector="embedding").checkpoint()  # read by each block of queries, and for the degree
    found = graphs.search_graph(e, graph, asked, 10, shards=shards, key="vec_id", vector="embedding")
    return knn.recall(found, _exact(e, asked), 10, keys=["query", "vec_id"]).join(F.broadcast(graphs.average_degree(graph)))


@query()
def vamana_recall(spark, sf_dir):
    return _graph_recall("vamana", spark, sf_dir)


@query()
def hnsw_recall(spark, sf_dir):
    return _graph_recall("hnsw", spark, sf_dir)


def _report(name, live, found, asked, graph):
    """One row: live nodes, marked ones, hits that aren't live, and whether nine tenths of the true neighbours are found."""
    enough = knn.recall(found, _exact(live, asked), 10, keys=["query", "vec_id"]).select((F.col("recall") >= 0.9).alias("enough"))
    n = graph.where("layer = 0").agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("marked"))
    wrong = found.join(live.select("vec_id"), "vec_id", "left_anti").agg(F.count("*").alias("wrong"))
    return n.join(F.broadcast(wrong)).join(F.broadcast(enough)).select(F.lit(name).alias("graph"), "live", "marked", "wrong", "enough")


def _maintained(spark, sf_dir, change):
    """The report for both kinds of graph after change(kind, vectors, options) has given (graph, live vectors)."""
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    shards = max(2, graphs.shards_for(e.count()))
    options = {"shards": shards, "key": "vec_id", "vector": "embedding"}
    shared_dir(spark)
    out = None
    for kind in ("vamana", "hnsw"):
        graph, live = change(kind, e, options)
        graph, asked = graph.checkpoint(), _asked(live)
        found = graphs.search_graph(e, graph, asked, 10, **options)
        one = _report(kind, live, found, asked, graph)
        out = one if out is None else out.unionByName(one)
    return out


_KINDS = "(VALUES ('vamana'), ('hnsw')) k(graph)"


@query(f"SELECT graph, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS live, 0::BIGINT AS marked, 0::BIGINT AS wrong, TRUE AS enough FROM {_KINDS}")
def graph_insert(spark, sf_dir):
    """A graph of nine tenths of the vectors, then the others inserted."""

    def change(kind, e, options):
        first = e.where("vec_id % 10 <> 7")
        graph = graphs.build_graph(first, kind, **options).checkpoint()
        return graphs.insert_into_graph(graph, first, e.where("vec_id % 10 IN (7, 8)"), kind, **options), e

    return _maintained(spark, sf_dir, change)


@query(f"SELECT graph, count(*) FILTER (vec_id % 12 <> 5) AS live, count(*) FILTER (vec_id % 12 = 5) AS marked, 0::BIGINT AS wrong, TRUE AS enough FROM embeddings, {_KINDS} WHERE embedding IS NOT NULL GROUP BY graph")
def graph_delete(spark, sf_dir):
    """Every twelfth vector marked as deleted; none of them is found."""

    def change(kind, e, options):
        return graphs.delete_from_graph(graphs.build_graph(e, kind, **options), e.where("vec_id % 12 = 5"), "vec_id"), e.where("vec_id % 12 <> 5")

    return _maintained(spark, sf_dir, change)


@query(f"SELECT graph, count(*) FILTER (vec_id % 4 <> 1) AS live, 0::BIGINT AS marked, 0::BIGINT AS wrong, TRUE AS enough FROM embeddings, {_KINDS} WHERE embedding IS NOT NULL GROUP BY graph")
def graph_consolidate(spark, sf_dir):
    """Every fourth vector deleted, and the graph rewritten without them."""

    def change(kind, e, options):
        marked = graphs.delete_from_graph(graphs.build_graph(e, kind, **options), e.where("vec_id % 4 = 1"), "vec_id").checkpoint()
        return graphs.consolidate_graph(marked, e, kind, **options), e.where("vec_id % 4 <> 1")

    return _maintained(spark, sf_dir, change)


@query("SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, TRUE AS enough FROM embeddings WHERE embedding IS NOT NULL")
def pq_beam(spark, sf_dir):
    """A Vamana graph walked on product codes, and the hits ranked by their true distances."""
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    shards = graphs.shards_for(e.count())
    shared_dir(spark)
    graph = graphs.build_graph(e, "vamana", shards=shards, key="vec_id", vector="embedding").checkpoint()
    pq = quant.ProductQuantizer.fit(quant.sample_matrix(e, "embedding", key="vec_id"), 16, 256)
    found = graphs.search_graph_codes(e, graph, _asked(e), pq, 10, shards=shards, key="vec_id", vector="embedding")
    recall = knn.recall(found, _exact(e, _asked(e)), 10, keys=["query", "vec_id"])
    return recall.join(F.broadcast(_asked(e).agg(F.count("*").alias("queries")))).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("SELECT codec, count(*) FILTER (vec_id % 50 = 0) AS queries, TRUE AS enough FROM embeddings, (VALUES ('pq'), ('polar'), ('subspace')) c(codec) WHERE embedding IS NOT NULL GROUP BY codec")
def codec_recall(spark, sf_dir):
    """Whether nine tenths of the true neighbours of every fiftieth vector are found by codes, by codec."""
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    asked = _asked(e)
    exact, n = _exact(e, asked), asked.agg(F.count("*").alias("queries"))
    codecs = {"pq": quant.ProductQuantizer.fit(quant.sample_matrix(e, "embedding", key="vec_id"), 8, 256, spread=True), "polar": quant.codec("polar", DIMENSION), "subspace": quant.codec("subspace", DIMENSION, m=4)}
    out = None
    for name, c in codecs.items():
        found = quant.search_codes_many(e, c, asked, 10, key="vec_id", vector="embedding").withColumnRenamed("query_id", "query")
        one = knn.recall(found, exact, 10, keys=["query", "vec_id"]).join(F.broadcast(n)).select(F.lit(name).alias("codec"), "queries", (F.col("recall") >= 0.9).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT kind, count(*) FILTER (vec_id % 12 <> 5) AS size, count(*) FILTER (vec_id % 12 = 5) AS deleted, 0::BIGINT AS wrong FROM embeddings, (VALUES ('exact'), ('hnsw'), ('vamana'), ('pq')) k(kind) WHERE embedding IS NOT NULL GROUP BY kind")
def index_kinds(spark, sf_dir):
    """An index of each kind, written, changed and opened again; deleted keys aren't found."""
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = e.where("key % 50 = 0 AND vector IS NOT NULL").select(F.col("key").alias("query_id"), F.col("vector").alias("query_vector"))
    rows, out = [], None
    for kind in indexes.KINDS:
        path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        indexes.Index.build(e, path, kind).delete(e.where("key % 12 = 5"))
        again = indexes.Index.open(spark, path)
        rows.append((kind, again.size(), again.describe()["deleted"]))
        wrong = again.search(asked, 10).where("key % 12 = 5").agg(F.count("*").alias("wrong")).select(F.lit(kind).alias("kind"), "wrong")
        out = wrong if out is None else out.unionByName(wrong)
    return spark.createDataFrame(rows, "kind string, size long, deleted long").join(F.broadcast(out), "kind")
