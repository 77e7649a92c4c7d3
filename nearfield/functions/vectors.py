"""Column expressions over vectors. All arithmetic is in double precision and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Below this, a product of norms counts as zero.
TINY = 1e-10


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def literal(values) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(x)) for x in values])


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; null where the lengths differ."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size < TINY, F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def cosine_distance_normalized(a: Column, b: Column) -> Column:
    """For vectors known to have norm 1: no norms are computed."""
    return F.lit(1.0) - dot(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalize(a: Column) -> Column:
    """The vector with norm 1, or itself if it is (nearly) zero."""
    n = norm(a)
    return F.when(n < TINY, doubles(a)).otherwise(F.transform(a, lambda x: x.cast("double") / n))


#: Distance by metric; the score of a hit is 1 - distance for each of them.
METRICS = {
    "cosine": cosine_distance,
    "cosine_normalized": cosine_distance_normalized,
    "euclidean": euclidean_distance,
    "l2": euclidean_distance,
    "inner_product": lambda a, b: -dot(a, b),
}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[metric](a, b)


def int8_scale(v: Column) -> Column:
    """The largest magnitude, 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top).otherwise(F.lit(1.0))


def int8_codes(v: Column) -> Column:
    """Components as integers from -127 to 127, rounded half away from zero."""
    scale = int8_scale(v)
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127.0 / scale).cast("int"))))


def int8_decode(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda q: q.cast("double") * scale / 127.0)


def int8_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def int8_cosine_distance(ca: Column, sa: Column, na: Column, cb: Column, sb: Column, nb: Column) -> Column:
    """From codes, scales and the norms of the original vectors."""
    size = na * nb
    return F.when(size < TINY, F.lit(1.0)).otherwise(F.lit(1.0) - int8_dot(ca, cb).cast("double") * sa * sb / 16129.0 / size)


def int8_euclidean_distance(ca: Column, sa: Column, cb: Column, sb: Column) -> Column:
    return euclidean_distance(int8_decode(ca, sa), int8_decode(cb, sb))


def add_vectors(column: str, position: str = "pos", value: str = "x"):
    """posexplode, for element-wise aggregates."""
    return F.posexplode(column).alias(position, value)
