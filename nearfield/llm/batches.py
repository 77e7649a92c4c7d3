"""Map over documents in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_dir, show_package

#: Bytes of an Arrow batch that are made Python objects at a time, if more than one row has them.
SLICE_BYTES = 16 << 20


def as_bytes(column) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterable, rows: int = 1024, most: int = SLICE_BYTES) -> Iterator:
    """Arrow batches in pieces of few rows and bytes (one larger row is a piece), so that only a piece is copied to Python objects at a time."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > most:
                n //= 2
            yield b.slice(at, n)
            at += n


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Tables that written() has left in the shared folder, in order.
_LEFT: list[str] = []


def tables_left() -> int:
    return len(_LEFT)


def sweep(spark: SparkSession, since: int) -> None:
    """Deletes the tables that written() has made since tables_left() gave that number, and that nothing needs any more."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _LEFT[since:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _LEFT[since:]


def give_back() -> None:
    """Memory that this process has freed goes to the system; glibc else keeps what lies between objects that stay."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def written(df: DataFrame, kind: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, which later steps read instead of computing it again.

    It stays until sweep(), or as long as the folder.
    """
    path = fresh_path(df.sparkSession, kind)
    _LEFT.append(path)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def map_texts(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[bytes | None]], list]],
    text_col: str = "text",
    keep: Iterable[str] = ("doc_id",),
    keep_if: str | None = None,
) -> DataFrame:
    """Adds columns computed from whole texts; one output row for each input row.

    make() runs once in each task and returns a function from texts (UTF-8
    bytes or None) to one list or array for each of fields. Columns in keep go
    through as they are, but one that has the name of a computed column gives
    way to it; all others are dropped. keep_if names a computed boolean column:
    then only rows where it is true stay, without any of the computed columns.
    """
    show_package(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [c for c in keep if keep_if or c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))
    out = T.StructType([source.schema[c] for c in kept] + ([] if keep_if else fields))
    types = [x.type for x in to_arrow_schema(T.StructType(fields))]
    mask_at = [f.name for f in fields].index(keep_if) if keep_if else -1
    n = len(kept)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = make()
        for batch in slices(batches):
            got = score(as_bytes(batch.column(n)))
            new = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(got, types, strict=True)]
            if mask_at >= 0:
                yield pa.RecordBatch.from_arrays(batch.columns[:n], names=kept).filter(new[mask_at])
            else:
                yield pa.RecordBatch.from_arrays(batch.columns[:n] + new, names=out.names)

    return source.mapInArrow(run, out)
