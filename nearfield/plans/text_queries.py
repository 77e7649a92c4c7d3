"""Queries over texts, and over texts with vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import bm25, fusion, knn, postings
from ..session import shared_dir, table
from .registry import query
from .vector_queries import _COS, _Q, embeddings, vector_of

QUERY = "the thing from worthless idiot"
LICENSE = "license conditions warranty"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, with the vector's label as metadata."""
    e = embeddings(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return documents(spark, sf_dir).join(e, "doc_id")


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]+'), lambda x: length(x) >= 1)"
_TOK = f"tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)"
_TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term)"
_DL = f"dl AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents)"
_STATS = "st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl)"
_DF = "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_W = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_WEIGHTS = f"{_TOK}, {_TF}, {_DL}, {_STATS}, {_DF}, w AS (SELECT tf.doc_id, tf.term, {_W} AS w FROM tf JOIN df ON tf.term = df.term JOIN dl ON tf.doc_id = dl.doc_id, st)"


def _terms_sql(q: str) -> str:
    return ", ".join(f"'{t}'" for t in bm25.query_terms(q))


def _scores_sql(q: str) -> str:
    return f"{_WEIGHTS}, sc AS (SELECT doc_id, sum(w) AS score FROM w WHERE term IN ({_terms_sql(q)}) GROUP BY doc_id)"


def _top_sql(q: str, k: int = 10) -> str:
    return f"WITH {_scores_sql(q)} SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(sc.score, 9) DESC, doc_id LIMIT {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {_DL} SELECT doc_id, CAST(dl AS BIGINT) AS dl FROM dl")
def doc_lengths(spark, sf_dir):
    return bm25.doc_lengths(documents(spark, sf_dir), "doc_id")


@query(f"WITH {_DL} SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_tokens, round(sum(dl) / count(*), 6) AS avgdl FROM dl")
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(documents(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {_TOK}, {_TF} SELECT doc_id, term, tf FROM tf")
def term_frequencies(spark, sf_dir):
    return bm25.term_frequencies(documents(spark, sf_dir), "doc_id").select("doc_id", "term", "tf")


@query(f"WITH {_TOK}, {_TF}, {_DF}, nn AS (SELECT count(*) AS n FROM documents) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, nn")
def term_doc_freq(spark, sf_dir):
    d = documents(spark, sf_dir)
    df = bm25.document_frequencies(d)
    return df.join(F.broadcast(d.agg(F.count("*").alias("n")))).select("term", "df", F.round(X.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(_top_sql(QUERY))
def bm25_topk(spark, sf_dir):
    return _rounded(bm25.search(documents(spark, sf_dir), QUERY, 10, key="doc_id"))


@query(_top_sql("license mit apache"))
def bm25_rare_terms(spark, sf_dir):
    return _rounded(bm25.search(documents(spark, sf_dir), "License: MIT, Apache -- license", 10, key="doc_id"))


@query(f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9]+'), lambda x: length(x) >= 3)) AS BIGINT) AS dl FROM documents")
def tokens_min_length_case(spark, sf_dir):
    """Tokens of three characters or more, as they are written."""
    return bm25.doc_lengths(documents(spark, sf_dir), "doc_id", min_length=3, lowercase=False)


@query(
    f"""WITH {_WEIGHTS}, q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark), sc AS (SELECT item_id, doc_id, sum(w) AS score FROM q JOIN w ON q.term = w.term GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0)
        SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def bm25_multi_query(spark, sf_dir):
    """Benchmark items as queries."""
    q = table(spark, sf_dir, "benchmark")
    found = bm25.search_many(documents(spark, sf_dir), q, 3, key="doc_id", query_key="item_id", query_text="text")
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "rank")


@query(f"WITH {_WEIGHTS} SELECT doc_id, count(*) AS terms, round(sum(w), 4) AS weight, round(max(w), 6) AS heaviest FROM w GROUP BY doc_id")
def bm25_sparse_vector(spark, sf_dir):
    w = bm25.sparse_vectors(documents(spark, sf_dir), "doc_id")
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.max("weight"), 6).alias("heaviest"))


@query(
    f"""WITH {_TOK}, {_TF}, {_DL}, {_STATS}, {_DF}, q AS (SELECT * FROM (VALUES ('the', 2), ('thing', 1), ('zzzunknown', 1)) AS t(term, tf))
        SELECT q.term, round(ln((n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 4 / avgdl)), 6) AS weight FROM q LEFT JOIN df ON q.term = df.term, st"""
)
def bm25_encode(spark, sf_dir):
    return bm25.encode(documents(spark, sf_dir), "The thing: the ZZZunknown").select("term", F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {_TOK}, {_TF}, p AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block FROM tf)
        SELECT term, CAST(block AS BIGINT) AS block, min(doc_id) AS "first", max(doc_id) AS "last", count(*) AS postings, round(max(tf * 2.2 / (tf + 1.2 * 0.25)), 6) AS max_impact FROM p GROUP BY term, block"""
)
def bm25_block_max(spark, sf_dir):
    return bm25.block_max(documents(spark, sf_dir), key="doc_id").withColumn("max_impact", F.round("max_impact", 6))


@query(_top_sql(QUERY))
def bm25_block_max_search(spark, sf_dir):
    """Blocks that can't reach the ten best are skipped; the result is the same."""
    found, _ = bm25.search_block_max(documents(spark, sf_dir), QUERY, 10, key="doc_id", block=16)
    return _rounded(found)


def _stored(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    postings.build(documents(spark, sf_dir), path, key="doc_id", buckets=8)
    return postings.StoredIndex(spark, path, buckets=8)


@query(_top_sql(QUERY))
def bm25_stored_search(spark, sf_dir):
    """The index is written, and searched by its blocks."""
    found, _ = _stored(spark, sf_dir).search(QUERY, 10)
    return _rounded(found.withColumnRenamed("key", "doc_id"))


@query(f"WITH {_TOK}, {_TF}, p AS (SELECT DISTINCT term, (doc_id // 4096) AS range FROM tf WHERE term IN ({_terms_sql(LICENSE)})) SELECT 3 AS query_terms, count(*) AS blocks_total, TRUE AS adds_up FROM p")
def bm25_skip_figures(spark, sf_dir):
    """Blocks of the query's terms; what is skipped and scanned adds up."""
    _, figures = _stored(spark, sf_dir).search(LICENSE, 10)
    return figures.select("query_terms", "blocks_total", (F.col("blocks_scanned") + F.col("blocks_skipped") == F.col("blocks_total")).alias("adds_up"))


@query(f"WITH {_TOK}, {_TF}, {_DL}, p AS (SELECT term, doc_id // 4096 AS range, count(*) AS c FROM tf GROUP BY ALL) SELECT (SELECT count(*) FROM dl) AS n, (SELECT CAST(sum(dl) AS BIGINT) FROM dl) AS total_tokens, (SELECT round(avg(dl), 6) FROM dl) AS avgdl, count(DISTINCT term) AS vocabulary, CAST(sum(c) AS BIGINT) AS postings, count(*) AS blocks FROM p")
def bm25_index_info(spark, sf_dir):
    return _stored(spark, sf_dir).info().withColumn("avgdl", F.round("avgdl", 6))


@query("SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents")
def id_dictionary(spark, sf_dir):
    """Dense numbers for ids, and back."""
    shared_dir(spark)
    return postings.number_ids(documents(spark, sf_dir), "doc_id").select("key", "number")


@query(f"""WITH {_scores_sql(QUERY)}, c AS (SELECT doc_id FROM sc WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT 20)
        SELECT doc_id, CAST(len(list_intersect({_TOKENS}, ['the', 'thing', 'from', 'worthless', 'idiot'])) AS INTEGER) AS score FROM c JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""")
def rerank_by_model(spark, sf_dir):
    """Twenty candidates in the order of a pluggable model; this one counts distinct query terms."""
    d = documents(spark, sf_dir)
    model = lambda q, text: F.size(F.array_intersect(X.tokens(text), X.tokens(q)))
    near = d.join(F.broadcast(bm25.search(d, QUERY, 20, key="doc_id").select("doc_id")), "doc_id")
    return knn.rerank_by(near, model, QUERY, 10, key="doc_id").select("doc_id", "score")


_SHARD = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 4"


@query(
    f"""WITH {_TOK}, {_TF}, s AS (SELECT doc_id, {_SHARD} AS shard, len({_TOKENS}) AS dl FROM documents), st AS (SELECT shard, count(*) AS n, sum(dl) / count(*) AS avgdl FROM s GROUP BY shard),
        h AS (SELECT tf.doc_id, term, tf, shard, dl FROM tf JOIN s ON tf.doc_id = s.doc_id WHERE term IN ({_terms_sql(QUERY)})), df AS (SELECT shard, term, count(*) AS df FROM h GROUP BY shard, term),
        sc AS (SELECT h.doc_id, sum({_W}) AS score FROM h JOIN df ON h.shard = df.shard AND h.term = df.term JOIN st ON h.shard = st.shard GROUP BY h.doc_id)
        SELECT doc_id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(sc.score, 9) DESC, doc_id LIMIT 10"""
)
def bm25_sharded_local_idf(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("shard", X.shard_for_key(F.col("doc_id"), 4))
    return _rounded(bm25.search_sharded(rows, QUERY, 10, key="doc_id"))


@query(_top_sql(QUERY).replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' idiot' ELSE text END AS text FROM documents))"))
def bm25_two_layers(spark, sf_dir):
    """A hot layer with new versions of every fifth document, ranked as one corpus with the base."""
    d = documents(spark, sf_dir)
    hot = d.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" idiot")))
    return _rounded(bm25.search_layers(hot, d, QUERY, 10, key="doc_id"))


@query(_top_sql(QUERY).replace("FROM documents)", "FROM (SELECT * FROM documents WHERE doc_id % 4 <> 1))"))
def bm25_after_delete(spark, sf_dir):
    """Statistics follow the documents that are left."""
    d = documents(spark, sf_dir)
    return _rounded(bm25.search(d.join(d.where("doc_id % 4 = 1").select("doc_id"), "doc_id", "left_anti"), QUERY, 10, key="doc_id"))


_CORPUS = "documents AS (SELECT d.*, label, embedding FROM main.documents d JOIN embeddings e ON d.doc_id = e.vec_id)"


def _arms(n: int) -> str:
    lexical = f"lx AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM (SELECT * FROM sc WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id LIMIT {n}))"
    cosine = _COS.replace("(e, ", "(embedding::DOUBLE[], ").replace("(e, e)", "(embedding::DOUBLE[], embedding::DOUBLE[])").replace(", e)", ", embedding::DOUBLE[])")
    vector = f"vx AS (SELECT doc_id, 1.0 - d AS score, row_number() OVER (ORDER BY d, doc_id) AS r FROM (SELECT doc_id, {cosine} AS d FROM documents, q ORDER BY d, doc_id LIMIT {n}))"
    return f"{lexical}, {vector}"


def _hybrid_sql(score: str) -> str:
    return f"""WITH {_CORPUS}, {_Q}, {_scores_sql(QUERY)}, {_arms(20)}, top AS (SELECT greatest(coalesce(max(score), 0.0), 0.001) AS top FROM lx),
        f AS (SELECT coalesce(lx.doc_id, vx.doc_id) AS doc_id, {score} AS score FROM lx FULL JOIN vx ON lx.doc_id = vx.doc_id CROSS JOIN top)
        SELECT doc_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 10"""


def _hybrid(spark, sf_dir, fused: str):
    found = fusion.search_hybrid(corpus(spark, sf_dir), QUERY, vector_of(spark, sf_dir), 10, fusion=fused, key="doc_id", vector="embedding")
    return _rounded(found)


@query(_hybrid_sql("0.5 / (60 + coalesce(lx.r, 1000)) + 0.5 / (60 + coalesce(vx.r, 1000))"))
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, "rrf")


@query(_hybrid_sql("0.5 * coalesce(lx.score / top, 0.0) + 0.5 * coalesce(vx.score, 0.0)"))
def hybrid_linear(spark, sf_dir):
    return _hybrid(spark, sf_dir, "linear")


@query(
    f"""WITH {_CORPUS}, {_Q}, {_TOK}, {_TF}, s AS (SELECT doc_id, {_SHARD} AS shard, len({_TOKENS}) AS dl FROM documents), st AS (SELECT shard, count(*) AS n, sum(dl) / count(*) AS avgdl FROM s GROUP BY shard),
        h AS (SELECT tf.doc_id, term, tf, shard, dl FROM tf JOIN s ON tf.doc_id = s.doc_id WHERE term IN ({_terms_sql(QUERY)})), df AS (SELECT shard, term, count(*) AS df FROM h GROUP BY shard, term),
        sc AS (SELECT h.doc_id, sum({_W}) AS score FROM h JOIN df ON h.shard = df.shard AND h.term = df.term JOIN st ON h.shard = st.shard GROUP BY h.doc_id), {_arms(20)},
        f AS (SELECT coalesce(lx.doc_id, vx.doc_id) AS doc_id, 0.5 / (60 + coalesce(lx.r, 1000)) + 0.5 / (60 + coalesce(vx.r, 1000)) AS score FROM lx FULL JOIN vx ON lx.doc_id = vx.doc_id)
        SELECT doc_id, round(score, 6) AS score FROM f ORDER BY round(f.score, 9) DESC, doc_id LIMIT 10"""
)
def hybrid_sharded(spark, sf_dir):
    rows = corpus(spark, sf_dir).withColumn("shard", X.shard_for_key(F.col("doc_id"), 4))
    return _rounded(fusion.search_hybrid_sharded(rows, QUERY, vector_of(spark, sf_dir), 10, key="doc_id", vector="embedding"))


@query(
    f"""WITH {_Q}, e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), a AS (SELECT vec_id, 1.0 - {_COS} AS s FROM e, q), h AS (SELECT vec_id, s FROM a UNION ALL SELECT vec_id, s * 0.5 FROM a WHERE vec_id % 2 = 0)
        SELECT vec_id, round(max(s), 6) AS score FROM h GROUP BY vec_id"""
)
def dedup_keep_max(spark, sf_dir):
    """Hits of two shards with common keys: the higher score stays."""
    e = embeddings(spark, sf_dir)
    hits = e.select("vec_id", V.cosine_similarity(F.col("embedding"), V.literal(vector_of(spark, sf_dir))).alias("score"))
    again = hits.where("vec_id % 2 = 0").withColumn("score", F.col("score") * 0.5)
    return _rounded(fusion.keep_best(fusion.union_hits(hits, again), "vec_id"))


@query("SELECT vec_id AS key FROM embeddings WHERE label < 4 UNION SELECT vec_id AS key FROM embeddings WHERE label > 2")
def union_of_keys(spark, sf_dir):
    e = embeddings(spark, sf_dir).withColumnRenamed("vec_id", "key")
    return fusion.union_keys(e.where("label < 4"), e.where("label > 2"))


@query(
    """WITH g AS (SELECT l.doc_id, quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
       h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
       j AS (SELECT source, doc_id, grade, row_number() OVER (PARTITION BY source ORDER BY grade DESC, doc_id) AS place FROM g WHERE grade > 0),
       i AS (SELECT source, count(*) FILTER (grade = 2) AS relevant, sum(grade / log2(place + 1)) FILTER (place <= 10) AS ideal FROM j GROUP BY source),
       f AS (SELECT h.source, count(*) FILTER (grade = 2) AS hits, sum(grade / log2(rank + 1)) AS dcg FROM h JOIN j ON h.source = j.source AND h.doc_id = j.doc_id WHERE rank <= 10 GROUP BY h.source)
       SELECT i.source, coalesce(hits, 0) / 10.0::DOUBLE AS "precision", round(CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant ELSE 0 END, 6) AS recall, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg
       FROM i LEFT JOIN f ON i.source = f.source"""
)
def retrieval_metrics(spark, sf_dir):
    """Each source as a query: its longest documents as hits, labels as judgments."""
    d = documents(spark, sf_dir)
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    judged = table(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id").select("source", "doc_id", grade.alias("grade"))
    hits = d.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    m = fusion.metrics_at_k(hits, judged, 10, query="source", key="doc_id")
    return m.select("source", "precision", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))
