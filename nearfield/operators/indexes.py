"""Vector indexes behind one interface: build, search, insert, delete, compact, size, save and open.

An index is a table of vectors (key, vector), a table of marks (deleted keys) and,
for the approximate kinds, a table of its graph or codes. All of it is Parquet
under one folder, so an index is opened again without being rebuilt, and a search
reads the shards' rows. The kinds:

* exact: no structure; marks are dropped before the cut.
* hnsw, vamana: graphs by shard (graphs.py).
* pq: product codes, the nearest by code ranked by their true distances.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import graphs, knn, quant, store


@dataclass
class IndexInfo:
    kind: str
    metric: str
    dimension: int
    shards: int
    key: str = "key"


class Index:
    """An index of one folder; every change writes the next version of it and then points at that."""

    def __init__(self, spark: SparkSession, path: str, info: IndexInfo, version: int):
        self.spark, self.path, self.info, self.version = spark, path, info, version

    # storage

    @staticmethod
    def build(docs: DataFrame, path: str, kind: str = "exact", *, metric: str = "cosine", key: str = "key", vector: str = "vector") -> Index:
        """Writes an index of the rows of docs that have a vector."""
        if kind not in KINDS:
            raise ValueError(f"unknown index {kind!r}; known: {', '.join(KINDS)}")
        rows = docs.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where("vector IS NOT NULL").dropDuplicates(["key"])
        first = docs.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
        me = Index(docs.sparkSession, path.rstrip("/"), IndexInfo(kind, metric, first["n"] if first else 0, 1, key), 0)
        me._write(rows, 0, "vectors")
        me.info.shards = graphs.shards_for(me.vectors().count())
        me._structure(0)
        me._write(me.vectors().select("key").limit(0), 0, "marks")
        me._point()
        return me

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        row = spark.read.text(f"{path.rstrip('/')}/index.json").first()
        if row is None:
            raise FileNotFoundError(path)
        said = json.loads(row["value"])
        return Index(spark, path.rstrip("/"), IndexInfo(**said["info"]), said["version"])

    def _folder(self, name: str, version: int | None = None) -> str:
        return f"{self.path}/version={self.version if version is None else version:06d}/{name}"

    def _write(self, rows: DataFrame, version: int, name: str) -> None:
        rows.write.mode("overwrite").parquet(self._folder(name, version))

    def _point(self) -> None:
        said = json.dumps({"info": asdict(self.info), "version": self.version}, sort_keys=True)
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/index.json")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(name))

    def vectors(self) -> DataFrame:
        return self._table("vectors")

    def marks(self) -> DataFrame:
        """Deleted keys whose vectors are still there."""
        return self._table("marks")

    def _options(self) -> dict:
        return {"shards": self.info.shards, "metric": self.info.metric}

    def _structure(self, version: int) -> None:
        rows = self.spark.read.parquet(self._folder("vectors", version))
        if self.info.kind in GRAPHS:
            self._write(graphs.build_graph(rows, self.info.kind, **self._options()), version, "graph")
        elif self.info.kind == "pq" and self.info.dimension:
            m = max(d for d in (1, 2, 4, 8, 16) if self.info.dimension % d == 0)
            pq = quant.ProductQuantizer.fit(quant.sample_matrix(rows, "vector"), m, 256)
            books = [(i, j, c.tolist()) for i, book in enumerate(pq.codebooks) for j, c in enumerate(book)]
            self._write(self.spark.createDataFrame(books, "sub int, centroid int, center array<double>").coalesce(1), version, "codebooks")
            self._write(rows.select("key", quant.encode_column(self.spark, pq, F.col("vector")).alias("code")), version, "codes")

    def quantizer(self) -> quant.ProductQuantizer:
        """The stored codebooks: m * k rows."""
        import numpy as np

        rows = sorted(self._table("codebooks").collect())
        m = 1 + max(r["sub"] for r in rows)
        return quant.ProductQuantizer(np.array([r["center"] for r in rows]).reshape(m, len(rows) // m, -1))

    # reading

    def size(self) -> int:
        return self.vectors().join(self.marks(), "key", "left_anti").count()

    def describe(self) -> dict:
        return asdict(self.info) | {"version": self.version, "size": self.size(), "deleted": self.marks().count()}

    def search(self, queries: DataFrame, k: int = 10, *, width: int = 64, over: int = 8) -> DataFrame:
        """(query, key, distance, rank) for queries (query_id, query_vector)."""
        if self.info.kind in GRAPHS:
            graph = graphs.delete_from_graph(self._table("graph"), self.marks())
            return graphs.search_graph(self.vectors(), graph, queries, k, width=width, **self._options())
        alive = self.vectors().join(self.marks(), "key", "left_anti")
        if self.info.kind == "pq" and self.info.dimension:
            return self._search_codes(alive, queries, k, over)
        return knn.search_batch(alive, queries, k, metric=self.info.metric).withColumnRenamed("query_id", "query")

    def _search_codes(self, alive: DataFrame, queries: DataFrame, k: int, over: int) -> DataFrame:
        """The over * k nearest by code for each query, at least a sixteenth of a percent of the index, then by true distance."""
        from ..functions import vectors as V

        pq, metric = self.quantizer(), self.info.metric
        n = max(over * k, alive.count() // 1600)
        codes = self._table("codes").join(alive.select("key"), "key", "left_semi")
        decoded = codes.select("key", quant.decode_column(self.spark, pq, F.col("code")).alias("vector"))
        near = knn.search_batch(decoded, queries, n, metric="euclidean" if metric in ("euclidean", "l2") else metric)
        asked = queries.select("query_id", "query_vector")
        true = near.select("query_id", "key").join(alive, "key").join(asked, "query_id")
        found = true.select(F.col("query_id").alias("query"), "key", V.distance(metric, F.col("vector"), F.col("query_vector")).alias("distance"))
        w = Window.partitionBy("query").orderBy("distance", "key")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # changes

    def _next(self, vectors: DataFrame, marks: DataFrame, graph: DataFrame | None, rebuild: bool = False) -> None:
        after = self.version + 1
        self._write(vectors, after, "vectors")
        self._write(marks, after, "marks")
        if graph is not None:
            self._write(graph, after, "graph")
        elif rebuild or self.info.kind == "pq":
            self._structure(after)
        self.version = after
        self._point()

    def insert(self, new: DataFrame, vector: str = "vector") -> None:
        """Vectors of new keys are added; those of known keys take the old one's place."""
        rows = new.select("key", F.col(vector).alias("vector")).where("vector IS NOT NULL").dropDuplicates(["key"])
        known = rows.join(self.vectors(), "key", "left_semi").select("key")
        kept = self.vectors().join(known, "key", "left_anti")
        graph = None
        if self.info.kind in GRAPHS:
            graph = graphs.delete_from_graph(self._table("graph"), known)
            graph = graphs.consolidate_graph(graph, self.vectors(), self.info.kind, always=True, **self._options()) if not known.isEmpty() else graph
            graph = graphs.insert_into_graph(graph, kept, rows, self.info.kind, **self._options())
        self._next(kept.unionByName(rows), self.marks().join(known, "key", "left_anti"), graph)

    def delete(self, keys: DataFrame) -> None:
        """Marks only; unknown keys and repeated deletes change nothing. Compacts where more than a tenth is marked."""
        gone = self.marks().unionByName(keys.select("key").join(self.vectors(), "key", "left_semi")).distinct()
        self._next(self.vectors(), gone, self._table("graph") if self.info.kind in GRAPHS else None)
        deleted = self.marks().count()
        if store.needs_compaction(self.vectors().count() - deleted, deleted):
            self.compact()

    def compact(self) -> None:
        """Vectors and nodes of marked keys go."""
        alive = self.vectors().join(self.marks(), "key", "left_anti")
        graph = None
        if self.info.kind in GRAPHS:
            marked = graphs.delete_from_graph(self._table("graph"), self.marks())
            graph = graphs.consolidate_graph(marked, self.vectors(), self.info.kind, always=True, **self._options())
        self._next(alive, self.marks().limit(0), graph)


GRAPHS = ("hnsw", "vamana")
KINDS = ("exact", "hnsw", "vamana", "pq")
