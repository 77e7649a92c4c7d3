"""Packing into optimal length buckets.

1. The lengths are counted into one global histogram with a bin for each
   distinct length: far fewer than documents, since n distinct lengths take at
   least n * n / 2 tokens.
2. Dynamic programming over the bins finds the boundaries of at most n_buckets
   buckets that make the padding least, exactly, with a convex hull of lines
   instead of a scan over all earlier boundaries.
3. In each bucket every document is padded to the bucket's length, so a batch
   holds floor(token_budget / length) documents, and one at least. Documents
   get their place in the bucket by a two-level count: places inside a (bucket,
   shard), plus what earlier shards hold. No task sees a whole bucket. Rows of
   one id and length are counted before they are shuffled, so an id that many
   rows share (or a null one) is a single row there.

Defined results: a null or non-positive length counts as 1; a document over the
budget is a batch of its own; equal lengths share a bucket; places follow
(shard, length, id), so the result doesn't depend on the cluster; repeated
rows take a place each; without documents there are no buckets and no rows.
Only the id and the length are read, so other columns may have any name; a
computed column that has the name of either gets an underscore behind it.
"""

from __future__ import annotations

from array import array
from collections import deque

from pyspark.sql import DataFrame, Window, functions as F

#: Documents of a shard, on average.
SHARD_ROWS = 20_000
#: Equal rows that are listed at a time.
LISTED = 1 << 16


def optimal_boundaries(bins: list[tuple[int, int, int]], n_buckets: int) -> list[int]:
    """Upper bounds of the buckets. bins: (length, documents, sum of their true lengths), ascending.

    best[j] = min over i < j of best[i] + length_j * (docs_j - docs_i) - (tokens_j - tokens_i)
    is, for a fixed j, the least of lines in length_j with slope -docs_i.
    """
    n = len(bins)
    if not n:
        return []
    docs, tokens = [0], [0]
    for _, c, t in bins:
        docs.append(docs[-1] + c)
        tokens.append(tokens[-1] + t)
    best = [0] + [None] * n
    back: list[array] = []
    k = min(n_buckets, n)
    for layer in range(k):
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, i
        new: list[int | None] = [None] * (n + 1)
        frm = array("q", bytes(8 * (n + 1)))
        for j in range(layer + 1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-docs[i], best[i] + tokens[i], i)
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x = bins[j - 1][0]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                new[j] = hull[0][0] * x + hull[0][1] + x * docs[j] - tokens[j]
                frm[j] = hull[0][2]
        best = new
        back.append(frm)
    out, j = [], n
    for frm in reversed(back):
        out.append(bins[j - 1][0])
        j = frm[j]
    return sorted(out)


def histogram(lengths: DataFrame, length_col: str, round_from: int | None = None) -> list[tuple[int, int, int]]:
    """(length, documents, sum of their true lengths) of each bin, ascending.

    With round_from, lengths beyond it are rounded up to 2048 bins for each
    doubling: the boundaries are then the best among these bins only. By default
    nothing is rounded.
    """
    n = F.greatest(F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(1)), F.lit(1))
    top = F.col("n")
    if round_from is not None:
        step = F.pow(F.lit(2), F.greatest(F.length(F.bin("n")) - 12, F.lit(0))).cast("long")
        top = F.when(F.col("n") > round_from, (F.floor((F.col("n") + step - 1) / step) * step).cast("long")).otherwise(F.col("n"))
    got = lengths.select(n.alias("n")).groupBy(top.alias("bin")).agg(F.count("*").alias("c"), F.sum("n").alias("t")).orderBy("bin").toPandas()
    return list(zip(got["bin"].tolist(), got["c"].tolist(), got["t"].tolist(), strict=True))


def pack(lengths: DataFrame, *, id_col: str = "doc_id", length_col: str = "n_tokens", n_buckets: int = 16, token_budget: int = 65_536, round_from: int | None = None) -> DataFrame:
    """id, length, bucket, bucket_len, batch, slot and padding for each row of lengths.

    lengths is read three times, so it should be cheap to recompute or written.
    """
    bins = histogram(lengths, length_col, round_from)
    bounds = optimal_boundaries(bins, n_buckets)
    shards = max(8, -(-sum(c for _, c, _ in bins) // SHARD_ROWS))
    key, n = F.col(f"`{id_col}`"), F.greatest(F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(1)), F.lit(1))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds or [1]])
    rows = lengths.select(key.alias("id"), n.alias("len")).groupBy("id", "len").agg(F.count("*").alias("c"))
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("len")))).withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), "len"), F.lit(shards)))
    groups = rows.groupBy("bucket", "shard").agg(F.sum("c").alias("n_here"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("bucket", "shard", F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("offset"))
    place = F.coalesce(F.sum("c").over(Window.partitionBy("bucket", "shard").orderBy("len", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("place", place).join(offsets, ["bucket", "shard"]).withColumn("place", F.col("place") + F.col("offset"))
    # equal rows are listed again, many of them by many tasks
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    few = placed.where(F.col("c") <= LISTED).withColumn("at", every(F.col("c")))
    parts = placed.where(F.col("c") > LISTED).withColumn("part", every(F.ceil(F.col("c") / LISTED))).repartition("part")
    many = parts.withColumn("k", every(F.least(F.lit(LISTED), F.col("c") - F.col("part") * LISTED))).withColumn("at", F.col("part") * LISTED + F.col("k")).drop("part", "k")
    placed = few.unionByName(many).withColumn("place", F.col("place") + F.col("at"))
    bucket_len = F.element_at(edges, F.col("bucket") + 1)
    capacity = F.greatest(F.floor(F.lit(token_budget) / bucket_len), F.lit(1))
    taken = {id_col.lower(), length_col.lower()}
    named = lambda c: f"{c}_" if c in taken else c
    return placed.select(
        F.col("id").alias(id_col),
        F.col("len").alias(length_col),
        F.col("bucket").cast("int").alias(named("bucket")),
        bucket_len.alias(named("bucket_len")),
        F.floor(F.col("place") / capacity).cast("long").alias(named("batch")),
        (F.col("place") % capacity).cast("long").alias(named("slot")),
        (bucket_len - F.col("len")).alias(named("padding")),
    )
