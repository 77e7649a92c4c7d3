"""Fusion of ranked lists, merging of shard results, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bm25, knn

#: The rank of a document that an arm has not found.
MISSING_RANK = 1000


def ranked(hits: DataFrame, score: str = "score", key: str = "key", name: str = "rank") -> DataFrame:
    """Adds the 1-based place by falling score. For hits that are already cut to a few."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc(F.round(score, bm25.TIE_DIGITS)), key)))


def rrf(lexical: DataFrame, vector: DataFrame, k: int = 10, *, lexical_weight: float = 0.5, vector_weight: float = 0.5, constant: int = 60, key: str = "key") -> DataFrame:
    """Reciprocal rank fusion of two hit lists (key, score)."""
    a = ranked(lexical.select(key, "score"), key=key, name="lexical_rank").select(key, "lexical_rank")
    b = ranked(vector.select(key, "score"), key=key, name="vector_rank").select(key, "vector_rank")
    part = lambda weight, rank: F.lit(weight) / (F.lit(constant) + F.coalesce(F.col(rank), F.lit(MISSING_RANK)))
    fused = a.join(b, key, "full_outer").select(key, (part(lexical_weight, "lexical_rank") + part(vector_weight, "vector_rank")).alias("score"))
    return fused.orderBy(F.desc("score"), key).limit(k)


def linear(lexical: DataFrame, vector: DataFrame, k: int = 10, *, lexical_weight: float = 0.5, vector_weight: float = 0.5, least: float = 0.001, key: str = "key") -> DataFrame:
    """Weighted sum of the lexical score over its maximum and the vector score; a missing one is 0."""
    a = lexical.select(key, F.col("score").alias("lexical"))
    top = a.agg(F.greatest(F.coalesce(F.max("lexical"), F.lit(0.0)), F.lit(least)).alias("top"))
    a = a.join(F.broadcast(top)).select(key, (F.col("lexical") / F.col("top")).alias("lexical"))
    b = vector.select(key, F.col("score").alias("vector"))
    total = F.lit(lexical_weight) * F.coalesce("lexical", F.lit(0.0)) + F.lit(vector_weight) * F.coalesce("vector", F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, total.alias("score")).orderBy(F.desc("score"), key).limit(k)


def search_hybrid(
    docs: DataFrame,
    query: str,
    query_vector: Iterable[float],
    k: int = 10,
    *,
    fusion: str = "rrf",
    lexical_weight: float = 0.5,
    vector_weight: float = 0.5,
    rrf_constant: int = 60,
    metric: str = "cosine",
    key: str = "key",
    text: str = "text",
    vector: str = "vector",
    post_filter: Column | None = None,
    columns: Iterable[str] = (),
) -> DataFrame:
    """Both arms at 2k, fused once. post_filter concerns the vector arm only."""
    a = bm25.search(docs, query, 2 * k, key=key, text=text)
    b = knn.search_vector(docs, query_vector, 2 * k, metric=metric, key=key, vector=vector, post_filter=post_filter, columns=columns)
    if fusion == "rrf":
        return rrf(a, b, k, lexical_weight=lexical_weight, vector_weight=vector_weight, constant=rrf_constant, key=key)
    if fusion == "linear":
        return linear(a, b, k, lexical_weight=lexical_weight, vector_weight=vector_weight, key=key)
    raise ValueError(f"unknown fusion {fusion!r}; known: linear, rrf")


def search_hybrid_sharded(docs: DataFrame, query: str, query_vector: Iterable[float], k: int = 10, *, shard: str = "shard", key: str = "key", text: str = "text", vector: str = "vector") -> DataFrame:
    """Every shard gives both arms; the arms are merged each, then fused once."""
    a = bm25.search_sharded(docs, query, 2 * k, shard=shard, key=key, text=text)
    b = knn.search_sharded(docs, query_vector, 2 * k, shard=shard, key=key, vector=vector)
    return rrf(a, b, k, key=key)


def keep_best(hits: DataFrame, key: str = "key", score: str = "score") -> DataFrame:
    """One row for each key, with its highest score."""
    return hits.groupBy(key).agg(F.max(score).alias(score))


def union_hits(*lists: DataFrame) -> DataFrame:
    """Hit lists of several shards, one after another."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def union_keys(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys of both lists."""
    return a.select(key).union(b.select(key)).distinct()


def metrics_at_k(hits: DataFrame, judgments: DataFrame, k: int, *, query: str = "query_id", key: str = "key", rank: str = "rank", grade: str = "grade") -> DataFrame:
    """precision, recall and ndcg for each judged query.

    grade is 2 for relevant and 1 for partly relevant keys. Precision and recall
    count grade 2; the gain is the grade, discounted by log2(rank + 1).
    """
    judged = judgments.select(query, key, grade).where(F.col(grade) > 0)
    top = hits.where(F.col(rank) <= k).select(query, key, rank)
    gain = lambda g, r: g / F.log2(r + 1.0)
    found = top.join(judged, [query, key]).groupBy(query).agg(F.sum(F.when(F.col(grade) == 2, 1).otherwise(0)).alias("hits"), F.sum(gain(F.col(grade), F.col(rank))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(grade), key))
    ideal = judged.withColumn("place", place).groupBy(query).agg(
        F.sum(F.when(F.col(grade) == 2, 1).otherwise(0)).alias("relevant"),
        F.sum(F.when(F.col("place") <= k, gain(F.col(grade), F.col("place")))).alias("ideal"),
    )
    hits_of, dcg = F.coalesce("hits", F.lit(0)), F.coalesce("dcg", F.lit(0.0))
    return ideal.join(found, query, "left").select(
        query,
        (hits_of / F.lit(k)).alias("precision"),
        F.when(F.col("relevant") > 0, hits_of / F.col("relevant")).otherwise(0.0).alias("recall"),
        F.when(F.col("ideal") > 0, dcg / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


