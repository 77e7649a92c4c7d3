"""Latency figures, histograms, and comparison of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Upper bounds of the latency buckets, in seconds.
SEARCH_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
ADD_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def histogram(values: DataFrame, value: str, bounds=SEARCH_BUCKETS, by: str | None = None) -> DataFrame:
    """(by, le, n): cumulative counts for each bound, and for +Inf. One aggregation, no expansion of rows."""
    keys = [by] if by else []
    cells = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = values.groupBy(*keys).agg(*cells, F.count(value).alias("all"))
    pairs = [F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return row.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.le", "p.n")


def latency_summary(values: DataFrame, value: str, by: str, percents=(50, 90, 95, 99)) -> DataFrame:
    """count, min, max, mean, population deviation and nearest-rank percentiles of each group.

    The value at rank round(n p / 100), and 1 at least. Ranks come from counts
    of equal values, so a group's rows fall together before they are ordered.
    """
    counted = values.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    upto = counted.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda p: F.greatest(F.round(F.col("n") * p / 100.0), F.lit(1))
    ranks = [F.min(F.when(F.col("upto") >= at(p), F.col(value))).alias(f"p{p}") for p in percents]
    some = [F.min(value).alias("min"), F.max(value).alias("max")]
    mean = values.groupBy(by).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
    return upto.groupBy(by).agg(*some, *ranks).join(mean, by)


def compare_runs(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Runs of (name, ops_per_sec, p95): regression, improvement or unchanged, by either figure."""
    b, c = baseline.alias("b"), current.alias("c")
    ops, p95 = F.col("c.ops_per_sec") / F.col("b.ops_per_sec") - 1.0, F.col("c.p95") / F.col("b.p95") - 1.0
    verdict = F.when((ops < -threshold) | (p95 > threshold), "regression").when((ops > threshold) | (p95 < -threshold), "improvement").otherwise("unchanged")
    return b.join(c, F.col("b.name") == F.col("c.name")).select(F.col("b.name").alias("name"), ops.alias("ops_change"), p95.alias("p95_change"), verdict.alias("verdict"))


def label(value: Column) -> Column:
    """A label's value as the text format wants it: backslash, quote and line feed escaped; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        v = F.replace(v, F.lit(plain), F.lit(escaped))
    return v


def prometheus(rows: DataFrame, metric: str, value: Column, labels: dict[str, Column]) -> DataFrame:
    """Lines of the text exposition format."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), label(v), F.lit('"')) for k, v in labels.items()])
    return rows.select(F.concat(F.lit(metric + "{"), pairs, F.lit("} "), value.cast("string")).alias("line"))


def prometheus_histogram(values: DataFrame, metric: str, value: str, bounds=SEARCH_BUCKETS, by: str | None = None) -> DataFrame:
    """The lines of a histogram: one for each bound and +Inf, then _sum and _count (sums in whole microseconds of seconds)."""
    keys = [by] if by else []
    own = {by: F.col(by)} if by else {}
    buckets = prometheus(histogram(values, value, bounds, by), f"{metric}_bucket", F.col("n"), own | {"le": F.col("le")})
    micros = F.sum(F.round(F.col(value) * 1_000_000).cast("long"))
    ends = values.groupBy(*keys).agg(F.coalesce(micros, F.lit(0)).alias("us"), F.count(value).alias("n"))
    return buckets.unionByName(prometheus(ends, f"{metric}_sum", F.col("us"), own)).unionByName(prometheus(ends, f"{metric}_count", F.col("n"), own))


def observed(rows: DataFrame, name: str, value: str | None = None):
    """(rows, observation): counted while they are used elsewhere, in the same pass; observation.get has n (and total and largest of value)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    cells = [F.count("*").alias("n")]
    if value:
        cells += [F.sum(value).alias("total"), F.max(value).alias("largest")]
    return rows.observe(seen, *cells), seen
