"""Collections on disk: specification, Parquet layout, catalog, JSON in and out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("seq", T.LongType()),
    ]
)
BACKENDS = ("exact", "vamana", "hnsw", "pq")


@dataclass(frozen=True)
class CollectionSpec:
    """What a collection is; both spellings of dimension and shards are accepted by of()."""

    name: str
    dimension: int = 768
    shards: int = 1
    replicas: int = 1
    metric: str = "cosine"
    backend: str = "exact"
    bm25: bool = True
    embedder: str = "hashing"
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.dimension < 1 or self.shards < 1 or self.replicas < 1:
            raise ValueError("dimension, shards and replicas must be at least 1")
        if self.backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.backend!r}; known: {', '.join(BACKENDS)}")

    @staticmethod
    def of(config: dict) -> CollectionSpec:
        c = dict(config)
        for long, short in (("dimensions", "dimension"), ("num_shards", "shards"), ("replication_factor", "replicas")):
            if long in c:
                c[short] = c.pop(long)
        return CollectionSpec(**c)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> CollectionSpec:
        return CollectionSpec(**json.loads(text))


class Folder:
    """Files beside the tables, through Spark's own file systems, so any path that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = path
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        """What a folder holds, hidden names aside; nothing if it isn't there."""
        if not self.exists(name):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if n[0] not in "._")

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Makes a file that isn't there yet; False if another has made it. One call of the file system decides."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def claim(self, log: str) -> int:
        """The next number of a log, which no one else has: the file of that number is made by one writer only."""
        taken = self.names(log)
        number = int(taken[-1]) + 1 if taken else 1
        while not self.write_new(f"{log}/{number:012d}", ""):
            number += 1
        return number

    def rename(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{name} can't be renamed to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def write_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    docs.select([F.col(f.name).cast(f.dataType) for f in DOCUMENTS]).write.mode(mode).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(path)


JSON_SCHEMA = "id string, text string, metadata map<string,string>, vector array<float>"


def from_json_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) from one JSON object a row; objects without an id, or broken ones, are rejected."""
    parsed = lines.withColumn("j", F.from_json(F.col(column), JSON_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.col("j.id").isNotNull()
    good = parsed.where(ok).select(F.col("j.id").alias("key"), "j.text", "j.metadata", "j.vector")
    return good, parsed.where(~F.coalesce(ok, F.lit(False))).select(column)


def to_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object for each row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
