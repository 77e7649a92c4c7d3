"""Nearest neighbours: exact top-k, batches of queries, filters, rerank and per-shard search."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import vectors as V

#: A block of queries that is broadcast: rows and bytes are bounded by this many floats.
BLOCK_FLOATS = 4_000_000
#: So many queries are taken without counting them first.
FEW_QUERIES = 1000
#: Distances that a task holds at a time, queries times rows.
MATRIX_CELLS = 8_000_000
#: Distances agreeing to so many digits are ties: sums of equal vectors' products may differ in the last ones.
TIE_DIGITS = 12


def rank_hits(hits: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """rank from 1 for an already limited set of hits."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*(order or [F.col("distance"), F.col(key)]))))


def search_vector(
    docs: DataFrame,
    query: Iterable[float],
    k: int = 5,
    *,
    metric: str = "cosine",
    key: str = "key",
    vector: str = "vector",
    post_filter: Column | None = None,
    pre_filter: Column | None = None,
    columns: Iterable[str] = (),
) -> DataFrame:
    """The k nearest rows: rank, key, distance, score = 1 - distance, and columns.

    post_filter is applied to the k rows found, so fewer may stay; pre_filter is
    applied before the search and always leaves k if there are k. Each task
    keeps k rows, so what is sorted at the end doesn't grow with the table.
    """
    q = V.literal(query)
    rows = docs.where(pre_filter) if pre_filter is not None else docs
    keep = list(dict.fromkeys([key, *columns]))
    hits = rows.select(*keep, V.distance(metric, F.col(vector), q).alias("distance")).where(F.col("distance").isNotNull())
    top = rank_hits(hits.orderBy("distance", key).limit(k), key)
    if post_filter is not None:
        top = top.where(post_filter)
    return top.select("rank", *keep, "distance", (F.lit(1.0) - F.col("distance")).alias("score"))


def dimension_guard(docs: DataFrame, dimension: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by the vector's length; null vectors are rejected."""
    ok = F.coalesce(F.size(vector) == dimension, F.lit(False))
    return docs.where(ok), docs.where(~ok).withColumn("error", F.format_string("dimension_mismatch: expected %d, got %d", F.lit(dimension), F.coalesce(F.size(vector), F.lit(-1))))


def search_batch(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    metric: str = "cosine",
    key: str = "key",
    vector: str = "vector",
    query_key: str = "query_id",
    query_vector: str = "query_vector",
    exclude_same: bool = False,
) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest rows for each query.

    Queries are taken in blocks of bounded size. A block is broadcast; of each
    Arrow batch of rows k candidates for each query go on, so the shuffle carries
    k rows for each query and batch. The distances of a batch are computed for as
    many queries at a time as MATRIX_CELLS allows.
    """
    spark = docs.sparkSession
    queries = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("query_vector"))
    id_type, key_type = queries.schema["query_id"].dataType, docs.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("distance", T.DoubleType())])
    out = None
    for rows in query_blocks(queries):
        names = [r["query_id"] for r in rows]
        dim = len(rows[0]["query_vector"]) if rows else 1
        matrix = np.array([r["query_vector"] for r in rows], np.float64).reshape(len(rows), dim)
        found = _one_block(docs.select(key, vector), spark.sparkContext.broadcast((names, matrix)), schema, k, metric, exclude_same)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_blocks(queries: DataFrame) -> Iterator[list]:
    """Lists of (query_id, query_vector), all queries in blocks of at most about BLOCK_FLOATS; one empty list for no queries."""
    few = queries.limit(FEW_QUERIES + 1).collect()
    dim = next((len(r["query_vector"]) for r in few if r["query_vector"]), 1)
    if len(few) <= FEW_QUERIES and len(few) * dim <= BLOCK_FLOATS:
        yield sorted(few, key=lambda r: str(r["query_id"]))  # one job instead of three
        return
    blocks = max(1, -(-queries.count() * dim // BLOCK_FLOATS))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        yield sorted(part.collect(), key=lambda r: str(r["query_id"]))


def distances(matrix: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """One row for each query, one column for each row."""
    if metric in ("euclidean", "l2"):
        d = (matrix * matrix).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2.0 * (matrix @ rows.T)
        return np.sqrt(np.maximum(d, 0.0))
    product = matrix @ rows.T
    if metric == "inner_product":
        return -product
    if metric == "cosine_normalized":
        return 1.0 - product
    size = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    return np.where(size < V.TINY, 1.0, 1.0 - product / np.maximum(size, V.TINY))


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k least of each row, in order; of equals the first columns.

    The k-th value is found without sorting; only columns up to it are ordered.
    """
    if d.shape[1] <= 4 * k:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(d), k), np.int64)
    for i in range(len(d)):
        near = np.flatnonzero(d[i] <= edge[i])
        out[i] = near[np.argsort(d[i][near], kind="stable")[:k]]
    return out


def _one_block(docs: DataFrame, block, schema: T.StructType, k: int, metric: str, exclude_same: bool) -> DataFrame:
    def run(frames):
        import pandas as pd

        names, matrix = block.value
        if not names:
            return
        for f in frames:
            f = f[f.iloc[:, 1].map(lambda v: v is not None and len(v) == matrix.shape[1])]
            if not len(f):
                continue
            keys = f.iloc[:, 0].to_numpy()
            rows = np.stack(f.iloc[:, 1].to_numpy()).astype(np.float64)
            order = np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            step = max(1, MATRIX_CELLS // len(keys))
            for at in range(0, len(names), step):
                part = names[at : at + step]
                d = np.round(distances(matrix[at : at + step], rows, metric), TIE_DIGITS)
                if exclude_same:
                    d[np.array(part, dtype=object)[:, None] == keys[None, :].astype(object)] = np.inf
                top = nearest(d, k)
                q = np.repeat(np.arange(len(part)), top.shape[1])
                got = d[q, top.ravel()]
                on = np.isfinite(got)
                yield pd.DataFrame({schema.names[0]: [part[i] for i in q[on]], schema.names[1]: keys[top.ravel()[on]], "distance": got[on]})

    return docs.mapInPandas(run, schema)


def search_sharded(docs: DataFrame, query: Iterable[float], k: int = 10, *, shard: str = "shard", metric: str = "cosine", key: str = "key", vector: str = "vector") -> DataFrame:
    """Each shard gives its 2k nearest; they are deduplicated by key, keeping the better, and cut to k."""
    hits = docs.select(shard, key, V.distance(metric, F.col(vector), V.literal(query)).alias("distance"))
    local = Window.partitionBy(shard).orderBy("distance", key)
    gathered = hits.withColumn("r", F.row_number().over(local)).where(F.col("r") <= 2 * k)
    best = gathered.groupBy(key).agg(F.min("distance").alias("distance"))
    return rank_hits(best.orderBy("distance", key).limit(k), key).select("rank", key, "distance", (F.lit(1.0) - F.col("distance")).alias("score"))


def search_alive(docs: DataFrame, deleted: DataFrame, query: Iterable[float], k: int = 10, *, key: str = "key", **options) -> DataFrame:
    """Search without soft-deleted keys; they go before the cut, so k are found if there are k."""
    return search_vector(docs.join(deleted.select(key).distinct(), key, "left_anti"), query, k, key=key, **options)


def search_layers(hot: DataFrame, base: DataFrame, query: Iterable[float], k: int = 10, *, key: str = "key", **options) -> DataFrame:
    """A hot layer over a base: where both have a key the hot row counts."""
    rows = hot.unionByName(base.join(hot.select(key), key, "left_anti"))
    return search_vector(rows, query, k, key=key, **options)


def rerank(candidates: DataFrame, docs: DataFrame, query: Iterable[float], k: int, *, metric: str = "cosine", key: str = "key", vector: str = "vector") -> DataFrame:
    """The k nearest of the candidates by their true distances."""
    rows = docs.join(candidates.select(key).distinct(), key, "left_semi")
    return search_vector(rows, query, k, metric=metric, key=key, vector=vector)


def int8_table(docs: DataFrame, key: str = "key", vector: str = "vector") -> DataFrame:
    """key, codes, scale and norm of each vector."""
    v = F.col(vector)
    return docs.select(key, V.int8_codes(v).alias("codes"), V.int8_scale(v).alias("scale"), V.norm(v).alias("norm"))


def search_int8(codes: DataFrame, query: Iterable[float], k: int, *, metric: str = "cosine", key: str = "key") -> DataFrame:
    """Search over int8 codes, the query being coded alike."""
    q = V.literal(query)
    qc, qs, qn = V.int8_codes(q), V.int8_scale(q), V.norm(q)
    c, s, n = F.col("codes"), F.col("scale"), F.col("norm")
    d = V.int8_euclidean_distance(c, s, qc, qs) if metric in ("euclidean", "l2") else V.int8_cosine_distance(c, s, n, qc, qs, qn)
    return rank_hits(codes.select(key, d.alias("distance")).orderBy("distance", key).limit(k), key)


def medoid(docs: DataFrame, *, metric: str = "cosine", key: str = "key", vector: str = "vector") -> DataFrame:
    """The row nearest to the centroid; of equals the smallest key. One row: key, distance."""
    center = centroid(docs, vector)
    d = docs.join(F.broadcast(center)).select(key, V.distance(metric, F.col(vector), F.col("centroid")).alias("distance"))
    return d.orderBy("distance", key).limit(1)


def centroid(docs: DataFrame, vector: str = "vector", by: str | None = None) -> DataFrame:
    """The element-wise mean, of all rows (one row: centroid) or for each value of by."""
    keys = [by] if by else []
    each = docs.select(*keys, V.add_vectors(vector)).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def max_sim(doc_tokens: DataFrame, query_tokens: list[list[float]], k: int, *, doc: str = "doc", vector: str = "vector") -> DataFrame:
    """Late interaction: for each query token the best dot product with a document's tokens, summed."""
    best = [F.max(V.dot(F.col(vector), V.literal(q))) for q in query_tokens]
    total = best[0]
    for x in best[1:]:
        total = total + x
    return doc_tokens.groupBy(doc).agg(total.alias("score")).orderBy(F.desc("score"), doc).limit(k)


def rerank_by(candidates: DataFrame, scorer: Callable[[Column, Column], Column], query: str, k: int, *, key: str = "key", text: str = "text") -> DataFrame:
    """Candidates in the order of a pluggable model: scorer(query, text) is a column, usually a pandas UDF."""
    return candidates.withColumn("score", scorer(F.lit(query), F.col(text))).orderBy(F.desc("score"), key).limit(k)


def recall(found: DataFrame, exact: DataFrame, k: int, *, keys: list[str]) -> DataFrame:
    """One row: the share of the exact hits that were found."""
    hits = found.select(*keys).distinct().join(exact.select(*keys).distinct(), keys, "inner").agg(F.count("*").alias("hits"))
    total = exact.select(*keys).distinct().agg(F.count("*").alias("total"))
    return hits.join(F.broadcast(total)).select((F.col("hits") / F.greatest(F.col("total"), F.lit(1))).alias("recall"))
