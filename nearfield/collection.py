"""A collection of documents: writes by version, reads by key, vector, lexical and hybrid search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import embed, vectors as V
from .operators import bm25, fusion, knn, sharding, store
from .operators.indexes import Index
from .session import show_package
from .sources.collections import DOCUMENTS, CollectionSpec, Folder, read_documents, write_documents


class NotEnabled(RuntimeError):
    """bm25_not_enabled: the collection keeps no lexical index."""


class NotClustered(RuntimeError):
    """not_clustered: the collection has one shard."""


class Collection:
    """Documents are rows (key, text, metadata, vector, seq): a base, and a delta of later writes.

    The base has each key once and no tombstones (rows without text and vector);
    compact() writes the next one. A write is a batch of the delta, staged and then
    renamed as a whole, under a number that it has claimed in the log, so two
    writers never have the same. What is current is the base without the delta's
    keys, and the latest row of each key of the delta: only the delta is shuffled.

    With an approximate backend, build_index() writes an index of the base;
    searches go to it for what the delta hasn't changed, and to the delta's rows
    exactly. Without a built index a search is exact.
    """

    def __init__(self, spark: SparkSession, path: str, spec: CollectionSpec | None = None):
        """Opens the collection of a folder, or makes one there. spec must agree with a stored one; None takes that."""
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        show_package(spark)
        stored = self.folder.read_text("spec.json")
        if stored is None:
            if spec is None:
                raise FileNotFoundError(f"no collection in {path}")
            self.folder.write_new("spec.json", spec.to_json())
        elif spec is not None and spec != CollectionSpec.from_json(stored):
            raise ValueError(f"the collection in {path} has another specification: {stored}")
        self.spec = spec or CollectionSpec.from_json(stored)
        done = [n for n in self.folder.names("") if n.startswith("generation=") and self.folder.exists(f"{n}/base/_SUCCESS")]
        self.generation = max((int(n.split("=")[1]) for n in done), default=0)
        if not done:
            write_documents(spark.createDataFrame([], DOCUMENTS), f"{self._at()}/base", "overwrite")

    def _at(self) -> str:
        return f"{self.path}/{self._name()}"

    def _name(self) -> str:
        return f"generation={self.generation:06d}"

    # rows

    def base(self) -> DataFrame:
        return read_documents(self.spark, f"{self._at()}/base")

    def delta(self) -> DataFrame | None:
        """Writes since the base was written, all versions; None if there are none."""
        if not self.folder.names(f"{self._name()}/delta"):
            return None
        return read_documents(self.spark, f"{self._at()}/delta/*")

    def rows(self) -> DataFrame:
        """All versions."""
        later = self.delta()
        return self.base() if later is None else self.base().unionByName(later)

    def current(self) -> DataFrame:
        later = self.delta()
        if later is None:
            return self.base()
        newest = store.latest(later)
        return self.base().join(newest.select("key"), "key", "left_anti").unionByName(_alive(newest))

    # writes

    def _append(self, docs: DataFrame) -> int:
        """Writes a batch under the next number, all rows or none; returns the rows."""
        seq = self.folder.claim("log")
        staged, name = f"{self._name()}/_staging-{seq:012d}", f"{self._name()}/delta/batch-{seq:012d}"
        write_documents(docs.withColumn("seq", F.lit(seq).cast("long")), f"{self.path}/{staged}", "overwrite")
        rows = read_documents(self.spark, f"{self.path}/{staged}")
        _, bad = knn.dimension_guard(rows.where("text IS NOT NULL OR vector IS NOT NULL").select("vector"), self.spec.dimension)
        wrong = bad.select("error").first()
        if wrong:
            self.folder.delete(staged)
            raise ValueError(wrong["error"])
        n = rows.count()
        self.folder.rename(staged, name)
        return n

    def add(self, docs: DataFrame) -> dict:
        """docs(key, text[, metadata, vector]). Without vectors they are embedded, once. All rows or none are written."""
        d = docs
        if "metadata" not in d.columns:
            d = d.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        if "vector" not in d.columns:
            d = d.withColumn("vector", embed.embed_column(F.col("text"), self.spec.dimension, [self.spec.embedder]))
        return {"inserted": self._append(d)}

    def upsert(self, docs: DataFrame) -> dict:
        return self.add(docs)

    def update(self, docs: DataFrame) -> dict:
        """Only keys that exist; others raise KeyError."""
        missing = docs.join(self.current().select("key"), "key", "left_anti").select("key").first()
        if missing:
            raise KeyError(missing["key"])
        return self.add(docs)

    def delete(self, keys: Iterable[str]) -> None:
        """Deleting a key that isn't there changes nothing."""
        rows = [(k, None, None, None, None) for k in dict.fromkeys(keys)]
        if rows:
            self._append(self.spark.createDataFrame(rows, DOCUMENTS))

    def compact(self) -> None:
        """Writes the current rows as the next generation's base; readers of the old one aren't disturbed.

        One at a time, and without writes beside it: those would stay with the old generation.
        """
        write_documents(self.current(), f"{self.path}/generation={self.generation + 1:06d}/base", "overwrite")
        self.generation += 1

    def compact_if_due(self) -> bool:
        """compact() if the delta holds more than a tenth of the base's keys, or the hot layer's share of its most rows."""
        later = self.delta()
        n = 0 if later is None else later.select("key").distinct().count()
        due = n > 0 and (n > self.base().count() // 10 or store.hot_is_full(n, int(self.spec.options.get("hot_rows", 10_000))))
        if due:
            self.compact()
        return due

    def build_index(self) -> Index | None:
        """An index of the base by the backend; None for exact, which needs none."""
        if self.spec.backend == "exact":
            return None
        return Index.build(self.base(), f"{self._at()}/index", self.spec.backend, metric=self.spec.metric)

    def index(self) -> Index | None:
        """The base's index, if it was built."""
        if self.spec.backend == "exact" or not self.folder.exists(f"{self._name()}/index/index.json/_SUCCESS"):
            return None
        return Index.open(self.spark, f"{self._at()}/index")

    # reads

    def get(self, key: str) -> dict | None:
        found = _alive(store.latest(store.get(self.rows(), key))).first()
        return found.asDict() if found else None

    def peek(self, n: int = 10) -> DataFrame:
        return store.peek(self.current(), n, complete=["text"])

    def count(self) -> int:
        return self.current().count()

    def stats(self) -> dict:
        s = store.stats(self.current()).first().asDict()
        built = self.index()
        return s | {"dimension": self.spec.dimension, "backend": self.spec.backend, "index": built.describe() if built else None, "engine": engine_info(self.spark)}

    # search

    def embed(self, text: str) -> list[float]:
        return embed.first_that_works([self.spec.embedder], text, self.spec.dimension)

    def search(self, text: str, k: int = 5, **options) -> DataFrame:
        return self.search_vector(self.embed(text), k, **options)

    def search_vector(self, vector: list[float], k: int = 5, *, where: Column | None = None, include_text: bool = True, include_metadata: bool = True) -> DataFrame:
        if len(vector) != self.spec.dimension:
            raise ValueError(f"dimension_mismatch: expected {self.spec.dimension}, got {len(vector)}")
        columns = ["text"] * include_text + ["metadata"] * (include_metadata or where is not None)
        rows, built = self.current(), self.index()
        if built is not None:
            rows = rows.join(self._candidates(built, vector, k), "key", "left_semi")
        found = knn.search_vector(rows, vector, k, metric=self.spec.metric, post_filter=where, columns=columns)
        return found if include_metadata else found.drop("metadata")

    def _candidates(self, built: Index, vector: list[float], k: int) -> DataFrame:
        """Keys that can be among the k nearest: the index's hits that the delta hasn't changed, and the delta's keys."""
        later = self.delta()
        changed = later.select("key").distinct() if later is not None else None
        asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query_vector array<double>")
        # of k + the number of changed keys that the index may return, k are unchanged
        wide = k if changed is None else k + changed.count()
        hits = built.search(asked, wide).select("key")
        return hits if changed is None else hits.unionByName(changed).distinct()

    def search_bm25(self, text: str, k: int = 10) -> DataFrame:
        if not self.spec.bm25:
            raise NotEnabled("bm25_not_enabled")
        return bm25.search(self.current(), text, k)

    def search_hybrid(self, text: str, k: int = 10, **options) -> DataFrame:
        if not self.spec.bm25:
            raise NotEnabled("bm25_not_enabled")
        return fusion.search_hybrid(self.current(), text, self.embed(text), k, metric=self.spec.metric, **options)

    # shards

    def sharded(self) -> DataFrame:
        if self.spec.shards < 2:
            raise NotClustered("not_clustered")
        return sharding.with_shard(self.current(), self.spec.shards)

    def search_sharded(self, text: str, k: int = 10) -> DataFrame:
        """Vector search shard by shard, merged."""
        return knn.search_sharded(self.sharded(), self.embed(text), k, metric=self.spec.metric)

    def search_bm25_sharded(self, text: str, k: int = 10) -> DataFrame:
        """Every shard ranks by its own statistics; merged."""
        if not self.spec.bm25:
            raise NotEnabled("bm25_not_enabled")
        return bm25.search_sharded(self.sharded(), text, k)

    def search_hybrid_sharded(self, text: str, k: int = 10, **options) -> DataFrame:
        if not self.spec.bm25:
            raise NotEnabled("bm25_not_enabled")
        return fusion.search_hybrid_sharded(self.sharded(), text, self.embed(text), k, **options)

    def export_sharded(self) -> str:
        """The current rows in one folder for each shard, for reads of single keys; returns the folder."""
        to = f"{self._at()}/sharded"
        sharding.write_sharded(self.sharded().drop("shard"), to, self.spec.shards)
        return to

    def get_routed(self, key: str) -> dict | None:
        """One key from the exported shards: only its shard's folder is read."""
        found = sharding.read_key(self.spark, f"{self._at()}/sharded", key, self.spec.shards).first()
        return found.asDict() if found else None


def _alive(rows: DataFrame) -> DataFrame:
    return rows.where("text IS NOT NULL OR vector IS NOT NULL")


def engine_info(spark: SparkSession) -> dict:
    """What computes distances: compiled column expressions in the JVM, numpy in Python."""
    return {"spark": spark.version, "metrics": sorted(V.METRICS)}
