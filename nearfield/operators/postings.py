"""A lexical index on disk: an id dictionary, posting blocks and their bounds, written once and searched many times.

Tables under one folder:

    documents  number, key, dl            numbers are dense, in order of the keys
    postings   term, range, numbers, tfs, dls   one row for each term and range of RANGE numbers, numbers as gaps
    blocks     term, range, postings, first, last, max_impact
    terms      term, df
    stats      n, total_tokens, avgdl     one row

Postings, blocks and terms are dealt to folders by a hash of the term, and
sorted by term and range inside, so a query reads the folders of its terms and
of these the row groups that its terms and ranges are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from . import bm25

#: Document numbers of a range. Ranges are alike for all terms, so their bounds add up.
RANGE = 4096
#: Tables that are dealt to folders; their schemas, as a table without rows has no files.
SCHEMAS = {
    "postings": "term string, range long, numbers array<int>, tfs array<int>, dls array<int>, max_impact double, bucket int",
    "blocks": "term string, range long, postings int, first long, last long, max_impact double, bucket int",
    "terms": "term string, df long, bucket int",
}
#: Ranges of the highest bounds that are scored first, for a threshold.
SEEDS = 16


def number_ids(docs: DataFrame, key: str = "key", partitions: int | None = None) -> DataFrame:
    """(number, key): dense numbers from 0 in order of the distinct keys, without nulls.

    Keys are dealt by range and counted there; what earlier ranges hold comes from
    a table of one row for each range.
    """
    from ..session import partitions_of

    n = partitions or partitions_of(docs.sparkSession)
    keys = docs.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().repartitionByRange(n, "key").withColumn("part", F.spark_partition_id())
    local = keys.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1).checkpoint()
    counts = local.groupBy("part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(counts.select("part", before.alias("before"))), "part").select((F.col("before") + F.col("place")).cast("long").alias("number"), "key")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{path}/{name}")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, *, key: str = "key", text: str = "text", buckets: int = 64, k1: float = 1.2, b: float = 0.75) -> None:
    """Writes the index of docs under path; a repeated key counts once, with one of its texts (the smallest)."""
    spark = docs.sparkSession
    ids = number_ids(docs, key)
    one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(text).alias("text"))
    numbered = one.join(ids, "key")
    numbered.select("number", "key", X.token_count(F.col("text")).alias("dl")).write.mode("overwrite").parquet(f"{path}/documents")
    stats = spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens"))
    stats.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_tokens") / F.col("n")).otherwise(0.0)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    tf = bm25.term_frequencies(numbered, "number", "text").withColumn("range", F.floor(F.col("number") / RANGE))
    impact = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b))
    sorted_ = F.array_sort(F.collect_list(F.struct("number", "tf", "dl")))
    rows = tf.groupBy("term", "range").agg(sorted_.alias("p"), F.max(impact).alias("max_impact")).withColumn("bucket", _bucket(F.col("term"), buckets))
    numbers = F.col("p.number")
    gaps = F.transform(numbers, lambda x, i: (x - F.when(i > 0, F.get(numbers, i - 1)).otherwise(F.col("range") * RANGE)).cast("int"))
    packed = rows.select("bucket", "term", "range", gaps.alias("numbers"), F.col("p.tf").cast("array<int>").alias("tfs"), F.col("p.dl").cast("array<int>").alias("dls"), "max_impact")
    packed.repartition("bucket").sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = _read(spark, path, "postings")
    size = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    first, last = F.col("range") * RANGE + F.get("numbers", F.lit(0)), F.col("range") * RANGE + size("numbers")
    blocks = stored.select("bucket", "term", "range", F.size("numbers").alias("postings"), first.alias("first"), last.alias("last"), "max_impact")
    blocks.repartition("bucket").sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    terms = _read(spark, path, "blocks").groupBy("bucket", "term").agg(F.sum("postings").alias("df"))
    terms.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


class StoredIndex:
    """An index that build() wrote."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, k1: float = 1.2, b: float = 0.75):
        self.spark, self.path, self.buckets, self.k1, self.b = spark, path, buckets, k1, b

    def table(self, name: str) -> DataFrame:
        return _read(self.spark, self.path, name)

    def _of_terms(self, name: str, terms: list[str]) -> DataFrame:
        """Rows of the query's terms: other folders aren't listed, other row groups aren't read."""
        hashed = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), self.buckets).alias("bucket"))
        return self.table(name).where(F.col("bucket").isin([r["bucket"] for r in hashed.collect()]) & F.col("term").isin(terms))

    def info(self) -> DataFrame:
        """One row: documents, tokens, mean length, vocabulary, postings and blocks."""
        blocks = self.table("blocks").agg(F.countDistinct("term").alias("vocabulary"), F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"), F.count("*").alias("blocks"))
        return self.table("stats").join(F.broadcast(blocks))

    def search(self, query: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """((key, score) of the k best, one row of figures): ranges that can't reach the k best are never read.

        A range's bound is the sum over the terms of idf and largest impact. The
        ranges of the highest bounds are scored first; the k-th score there is a
        threshold that only ranges of a bound as high can beat.
        """
        terms = bm25.query_terms(query)
        blocks = self._of_terms("blocks", terms)
        held = {r["term"]: r["df"] for r in self._of_terms("terms", terms).select("term", "df").collect()}  # the query's terms at most
        stats = self.table("stats").first()
        idf = {t: X.idf(F.lit(float(stats["n"])), F.lit(float(d))) for t, d in held.items()}
        weight = F.create_map(*[x for t, w in idf.items() for x in (F.lit(t), w)]) if idf else F.create_map(F.lit(""), F.lit(0.0))
        ranges = blocks.groupBy("range").agg(F.sum(weight[F.col("term")] * F.col("max_impact")).alias("bound"), F.count("*").alias("blocks"))
        seeds = [r["range"] for r in ranges.orderBy(F.desc("bound"), "range").limit(SEEDS).collect()]
        first = self._scored(terms, weight, stats, F.col("range").isin(seeds)).orderBy(F.desc("score")).limit(k).collect()
        threshold = first[-1]["score"] if len(first) == k else 0.0
        # a bound may be equal to a score but for rounding
        kept = F.col("bound") >= threshold * (1 - 1e-9)
        scored = self._scored(terms, weight, stats, None, ranges.where(kept).select("range"))
        found = bm25._best(scored.join(self.table("documents").select("number", "key"), "number").select("key", "score"), k, "key")
        total, scanned = F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum(F.when(kept, F.col("blocks"))), F.lit(0))
        figures = ranges.agg(total.alias("blocks_total"), scanned.alias("blocks_scanned"))
        figures = figures.select("*", (F.col("blocks_total") - F.col("blocks_scanned")).alias("blocks_skipped"))
        return found, figures.select("*", (100.0 * F.col("blocks_skipped") / F.greatest(F.col("blocks_total"), F.lit(1))).alias("skip_rate"), F.lit(len(terms)).alias("query_terms"))

    def _scored(self, terms: list[str], weight: Column, stats, where: Column | None, ranges: DataFrame | None = None) -> DataFrame:
        """(number, score) of the documents in some ranges."""
        rows = self._of_terms("postings", terms)
        if where is not None:
            rows = rows.where(where)
        if ranges is not None:
            rows = rows.join(ranges, "range", "left_semi")
        # gaps to numbers: running sums over an array of at most RANGE
        start = F.col("range") * RANGE
        running = F.aggregate("numbers", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), start) + x)))
        each = rows.select("term", F.inline(F.arrays_zip(running.alias("number"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        part = weight[F.col("term")] * X.weight(F.col("tf"), F.col("dl"), F.lit(float(stats["avgdl"])), self.k1, self.b)
        return each.groupBy("number").agg(F.sum(part).alias("score"))
