"""BM25 over DataFrames: statistics, search, sparse vectors, block-max search and shards."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

#: Scores that agree to so many digits are ties, so the order in which parts are summed decides nothing.
TIE_DIGITS = 9


#: Terms of a table of queries that are broadcast; more are joined by a shuffle.
MANY_TERMS = 200_000


def query_terms(query: str, min_length: int = 1, lowercase: bool = True) -> list[str]:
    """The distinct terms of a query, in order; how often a term stands in it doesn't matter."""
    q = query.lower() if lowercase else query
    return list(dict.fromkeys(t for t in re.split("[^a-zA-Z0-9]+", q) if len(t) >= max(1, min_length)))


def doc_lengths(docs: DataFrame, key: str = "key", text: str = "text", **options) -> DataFrame:
    return docs.select(key, X.token_count(F.col(text), **options).alias("dl"))


def corpus_stats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row: n, total_tokens, avgdl. Documents without tokens count in n."""
    dl = docs.select(X.token_count(F.col(text), **options).alias("dl"))
    n, total = F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))
    return dl.agg(n.alias("n"), total.alias("total_tokens"), F.when(n > 0, total / n).otherwise(0.0).alias("avgdl"))


def term_frequencies(docs: DataFrame, key: str = "key", text: str = "text", **options) -> DataFrame:
    """(key, term, tf), counted inside each document's own array before anything is shuffled."""
    t = X.tokens(F.col(text), **options)
    # the length goes through the explode beside each token; a column beside it would be computed for each token
    found = docs.select(key, t.alias("tokens"))
    counted = found.select(key, F.inline(F.arrays_zip("tokens", F.array_repeat(F.size("tokens"), F.size("tokens")))).alias("term", "dl"))
    return counted.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))


def document_frequencies(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(X.tokens(F.col(text), **options))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def matching(docs: DataFrame, terms: Iterable[str], keys: list[str], text: str = "text", **options) -> DataFrame:
    """(keys, dl, term, tf) for the given terms only: other tokens are never made."""
    lowercase = options.get("lowercase", True)
    hits = X.tokens_among(F.col(text), list(terms), lowercase)
    each = docs.select(*keys, X.token_count(F.col(text), **options).alias("dl"), hits.alias("hits"))
    return each.select(*keys, "dl", F.explode("hits").alias("term")).groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, query: str, k: int = 10, *, key: str = "key", text: str = "text", k1: float = 1.2, b: float = 0.75, **options) -> DataFrame:
    """(key, score) of the k best documents; only scores above 0.

    Two passes: corpus statistics (one row) and the few rows that hold a query
    term. Document frequencies are at most as many as query terms.
    """
    terms = query_terms(query, **options)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    hits = matching(docs, terms, [key], text, **options)
    return _best(_scored(hits, corpus_stats(docs, text, **options), [key], [], k1, b), k, key)


def _scored(hits: DataFrame, stats: DataFrame, keys: list[str], by: list[str], k1: float, b: float) -> DataFrame:
    df = hits.groupBy(*by, "term").agg(F.count("*").alias("df"))
    # one row, or one for each shard; and at most one for each query term
    joined = hits.join(df, [*by, "term"]).join(F.broadcast(stats), by) if by else hits.join(df, "term").join(F.broadcast(stats))
    part = X.idf(F.col("n"), F.col("df")) * X.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return joined.groupBy(*keys).agg(F.sum(part).alias("score"))


def _best(scores: DataFrame, k: int, key: str) -> DataFrame:
    return scores.where("score > 0").orderBy(F.desc(F.round("score", TIE_DIGITS)), key).limit(k)


def search_many(docs: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "key", text: str = "text", query_key: str = "query_id", query_text: str = "query", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank) for a table of queries, joined by term."""
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col(query_text)))).alias("term"))
    needed = q.select("term").distinct()
    if needed.count() <= MANY_TERMS:
        needed = F.broadcast(needed)  # so that other tokens go before anything is shuffled
    t = X.tokens(F.col(text))
    each = docs.select(key, t.alias("tokens")).select(key, F.inline(F.arrays_zip("tokens", F.array_repeat(F.size("tokens"), F.size("tokens")))).alias("term", "dl"))
    postings = each.join(needed, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(docs, text)
    weighted = postings.join(df, "term").join(F.broadcast(stats)).select("term", key, (X.idf(F.col("n"), F.col("df")) * X.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("w"))
    scores = q.join(weighted, "term").groupBy("query_id", key).agg(F.sum("w").alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE_DIGITS)), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_vectors(docs: DataFrame, key: str = "key", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, term, weight): a document's BM25 weights, one row for each term."""
    tf = term_frequencies(docs, key, text)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(df, "term").join(F.broadcast(corpus_stats(docs, text))).select(key, "term", (X.idf(F.col("n"), F.col("df")) * X.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("weight"))


def as_map(weights: DataFrame, key: str = "key") -> DataFrame:
    """One map for each document."""
    return weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))


def encode(docs: DataFrame, query: str, *, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(term, weight) of a text by the corpus's statistics; an unknown term counts as one document's."""
    spark = docs.sparkSession
    q = re.split("[^a-zA-Z0-9]+", query.lower())
    counts: dict[str, int] = {}
    for t in q:
        if t:
            counts[t] = counts.get(t, 0) + 1
    if not counts:
        return spark.createDataFrame([], "term string, weight double")
    frame = spark.createDataFrame([(t, n, sum(counts.values())) for t, n in counts.items()], "term string, tf long, dl long")
    held = docs.select(F.explode(F.array_distinct(X.tokens_among(F.col(text), list(counts)))).alias("term"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    n = F.greatest(F.col("n"), F.lit(1))
    joined = frame.join(df, "term", "left").join(F.broadcast(corpus_stats(docs, text)))
    return joined.select("term", (X.idf(n, F.coalesce("df", F.lit(1))) * X.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("weight"))


def search_sharded(docs: DataFrame, query: str, k: int = 10, *, shard: str = "shard", key: str = "key", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Each shard ranks by its own statistics and gives 2k; duplicates keep the higher score; then the k best."""
    terms = query_terms(query)
    hits = matching(docs, terms, [shard, key], text)
    stats = docs.select(shard, X.token_count(F.col(text)).alias("dl")).groupBy(shard).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    scores = _scored(hits, stats, [shard, key], [shard], k1, b).where("score > 0")
    local = Window.partitionBy(shard).orderBy(F.desc(F.round("score", TIE_DIGITS)), key)
    best = scores.withColumn("r", F.row_number().over(local)).where(F.col("r") <= 2 * k).groupBy(key).agg(F.max("score").alias("score"))
    return _best(best, k, key)


def search_layers(hot: DataFrame, base: DataFrame, query: str, k: int = 10, *, key: str = "key", text: str = "text") -> DataFrame:
    """A hot layer over a base, ranked as one corpus: hot rows replace base rows of the same key."""
    rows = hot.select(key, text).unionByName(base.select(key, text).join(hot.select(key), key, "left_anti"))
    return search(rows, query, k, key=key, text=text)


def block_max(docs: DataFrame, *, key: str = "key", text: str = "text", block: int = 128, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(term, block, first, last, postings, max_impact): postings by term in blocks in order of key.

    The impact is a posting's weight at length 0, which bounds it from above.
    """
    tf = term_frequencies(docs, key, text)
    place = F.row_number().over(Window.partitionBy("term").orderBy(key)) - 1
    blocked = tf.withColumn("block", F.floor(place / block).cast("long"))
    impact = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b))
    return blocked.groupBy("term", "block").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("postings"), F.max(impact).alias("max_impact"))


def search_block_max(docs: DataFrame, query: str, k: int = 10, *, key: str = "key", text: str = "text", block: int = 128, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, dict]:
    """search() with blocks skipped that cannot reach the k best, and figures of what was skipped.

    The first pass scores the documents of the rarest term, whose k-th score is a
    threshold no later one can be below; ranges of keys whose summed bounds stay
    under it are skipped in the second.
    """
    terms = query_terms(query)
    hits = matching(docs, terms, [key], text)
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # at most the query's terms
    stats = corpus_stats(docs, text).first()
    if not df:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0), {"blocks_total": 0, "blocks_scanned": 0, "blocks_skipped": 0, "skip_rate": 0.0, "query_terms": len(terms)}
    idfs = F.create_map(*[x for t, d in df.items() for x in (F.lit(t), X.idf(F.lit(float(stats["n"])), F.lit(float(d))))])
    part = idfs[F.col("term")] * X.weight(F.col("tf"), F.col("dl"), F.lit(float(stats["avgdl"])), k1, b)
    rare = min(df, key=lambda t: (df[t], t))
    seed = hits.where(F.col("term") == rare).select(key)
    first = hits.join(seed, key, "left_semi").groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score")).limit(k).collect()
    threshold = first[-1]["score"] if len(first) == k else 0.0
    bound = idfs[F.col("term")] * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b))
    # ranges of keys, alike for all terms, so that their bounds add up
    ranged = hits.withColumn("range", F.floor(F.col(key) / block)).withColumn("bound", bound)
    ranges = ranged.groupBy("range", "term").agg(F.max("bound").alias("m")).groupBy("range").agg(F.sum("m").alias("m"), F.count("*").alias("blocks"))
    kept = ranges.where(F.col("m") >= threshold)
    scored = ranged.join(kept.select("range"), "range", "left_semi").groupBy(key).agg(F.sum(part).alias("score"))
    count = ranges.agg(F.sum("blocks").alias("t"), F.coalesce(F.sum(F.when(F.col("m") >= threshold, F.col("blocks"))), F.lit(0)).alias("s")).first()
    total, scanned = count["t"] or 0, count["s"] or 0
    said = {"blocks_total": total, "blocks_scanned": scanned, "blocks_skipped": total - scanned, "skip_rate": 100.0 * (total - scanned) / max(1, total), "query_terms": len(terms)}
    return _best(scored, k, key), said
