"""Document maintenance: versions, deletes, batches, point reads and statistics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as X


def latest(rows: DataFrame, key: str = "key", version: str = "seq") -> DataFrame:
    """The row with the highest version of each key.

    An aggregation, so earlier versions fall together before the shuffle. Rows
    of one key and version that differ are ordered by a hash of their other columns.
    """
    plain = [f.name for f in rows.schema.fields if f.name not in (key, version) and not _has_map(f.dataType)]
    order = F.struct(version, F.xxhash64(*plain)) if plain else F.struct(version)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("row"))
    return newest.select(key, "row.*").select(*rows.columns)


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def upsert(base: DataFrame, changes: DataFrame, key: str = "key", version: str = "seq") -> DataFrame:
    """Changes replace rows of the same key and add the others; the last change of a key counts."""
    new = latest(changes, key, version)
    return base.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update(base: DataFrame, changes: DataFrame, key: str = "key", version: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(table, not found): changes apply to keys that exist; the others come back."""
    new = latest(changes, key, version)
    known = new.join(base.select(key), key, "left_semi")
    return upsert(base, known, key, version), new.join(base.select(key), key, "left_anti")


def insert(base: DataFrame, rows: DataFrame, key: str = "key", version: str = "seq") -> DataFrame:
    """add: an existing key is replaced."""
    return upsert(base, rows, key, version)


def delete(base: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key is not among keys; deleting twice changes nothing."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def get(docs: DataFrame, key_value, key: str = "key") -> DataFrame:
    """One document by key; the comparison reaches the scan."""
    return docs.where(F.col(key) == F.lit(key_value))


def multi_get(hits: DataFrame, docs: DataFrame, columns: Iterable[str], key: str = "key") -> DataFrame:
    """Columns of the documents that were hit; hits without a document go. hits is a top-k list."""
    return docs.select(key, *columns).join(F.broadcast(hits), key)


def peek(docs: DataFrame, n: int, key: str = "key", complete: Iterable[str] = ()) -> DataFrame:
    """The first n documents in order of key, without those that lack one of the columns in complete."""
    rows = docs
    for c in complete:
        rows = rows.where(F.col(c).isNotNull())
    return rows.orderBy(key).limit(n)


def project(docs: DataFrame, *, key: str = "key", text: str | None = None, metadata: Iterable[str] = (), extra: Iterable[str] = ()) -> DataFrame:
    """Only what is asked for is read."""
    return docs.select(key, *([text] if text else []), *metadata, *extra)


def equals(conditions: dict[str, object], metadata: Column | None = None) -> Column:
    """True where every metadata value is as given; a missing key never is."""
    at = (lambda c: metadata[c]) if metadata is not None else F.col
    each = [F.coalesce(at(c) == F.lit(v), F.lit(False)) for c, v in conditions.items()]
    return reduce(and_, each, F.lit(True))


def json_equals(conditions: dict[str, object], json: Column) -> Column:
    """equals() on JSON text, strict in type: 1 isn't "1", true isn't "true", 1 isn't 1.0, and null only equals null.

    A key that is missing, or JSON that is broken, never matches.
    """
    doc = F.try_parse_json(json)

    def one(key: str, want) -> Column:
        mark = '"' if "'" in key else "'"
        if mark in key:
            raise ValueError(f"a key can't have both kinds of quotes: {key!r}")
        at = F.variant_get(doc, f"$[{mark}{key}{mark}]", "variant")
        kind = F.schema_of_variant(at)
        if want is None:
            return F.is_variant_null(at)
        if isinstance(want, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(at, "$", "boolean") == F.lit(want))
        if isinstance(want, int):
            return (kind == "BIGINT") & (F.try_variant_get(at, "$", "bigint") == F.lit(want))
        if isinstance(want, float):
            return (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.try_variant_get(at, "$", "double") == F.lit(want))
        return (kind == "STRING") & (F.try_variant_get(at, "$", "string") == F.lit(want))

    return reduce(and_, [F.coalesce(one(k, v), F.lit(False)) for k, v in conditions.items()], F.lit(True))


def stats(docs: DataFrame, *, text: str = "text", vector: str | None = None) -> DataFrame:
    """One row of figures of a collection."""
    cells = [F.count("*").alias("documents"), F.coalesce(F.sum(X.token_count(F.col(text))), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("text_bytes")]
    if vector:
        cells += [F.max(F.size(vector)).alias("dimension")]
    return docs.agg(*cells)


def compact(base: DataFrame, tombstones: DataFrame, key: str = "key") -> DataFrame:
    """What a rewrite leaves: rows without a tombstone."""
    return delete(base, tombstones, key)


def needs_compaction(live: int, deleted: int) -> bool:
    """More deleted than a tenth (whole) of the live rows, and some are live."""
    return live > 0 and deleted > live // 10


def hot_is_full(size: int, most: int, threshold: float = 0.8) -> bool:
    return size >= int(most * threshold)
