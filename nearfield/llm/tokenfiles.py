"""Token ids in ORC.

Documents are tokenized behind one range exchange by id and written in
ascending order: integer columns in ORC are run-length encoded, every stripe
has row indexes, and a Bloom filter on the document id lets a point read skip
stripes. Stripes are independent, so files are read back stripe-parallel.

A word-level tokenizer is applied with a memory of pre-tokens: the text is
normalised and cut as the tokenizer does it, each distinct pre-token is merged
once by the library, and ids are joined as bytes. Texts outside the characters
on which both regular-expression libraries agree go to the library as a whole.

Defined results: a null text is an empty one and holds the end id alone;
repeated ids follow each other in order of a hash of their texts; null ids come first;
without documents the files are empty and are read back as no rows. A very long
text is encoded whole. Only id and text are read, so other columns may have any
name. Equal rows lie in one part, which a task streams.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import partitions_of
from .batches import as_bytes, slices
from .tokencount import AGREED, MARKS, byte_letters, letters_of

#: How the word tokenizer cuts a normalised text.
WORD_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words a worker remembers, none longer than LONG characters; then it starts anew.
REMEMBERED, LONG = 900_000, 64


#: Where the totals of the parts lie, beside the files.
PARTS = "_parts"


class Encoder(dict):
    """What stands between white space to its ids, as little-endian bytes.

    No pre-token holds white space, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in said.get("added_tokens", [])}
        kinds = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
        pre = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and pre[0].get("type") == "Split" and pre[0]["pattern"].get("Regex") == WORD_PIECE
        self.find = regex.compile(WORD_PIECE).findall
        # final sigma is lower-cased by its place in Python, and by itself in the library;
        # the four separators are white space for Python alone
        self.odd = regex.compile(f"[^{AGREED}]|[Σ\x1c-\x1f]").search
        self.letters = byte_letters()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        # most words are letters, or letters and a mark: these are cut without the regular expression
        if word.isalpha():
            ids = [t.id for t in self.model.tokenize(letters_of(word, self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        elif word[-1] in MARKS and word[:-1].isalpha():
            out = self[word[:-1]] + self[word[-1]]
        else:
            ids = [t.id for piece in self.find(word) for t in self.model.tokenize(letters_of(piece, self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG:
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if not self.plain or self.odd(text) or not unicodedata.is_normalized("NFC", text):
            return self.whole(text)
        parts = self.cut(text) if any(s in text for s in self.special) else [text]
        return b"".join(self.special.get(p) or b"".join(map(self.__getitem__, p.lower().split())) for p in parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """ORC files under path: id, number of ids, ids, and where the document starts inside its part of the range.

    Spark's committer makes the write atomic: a lost task is run again and only
    committed files count. What each part holds is added up from the narrow
    columns of the files and stored beside them, in a folder that scans skip.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # the hash splits the rows of an id that very many share
    text_hash = F.xxhash64("text")
    ordered = source.repartitionByRange(partitions or partitions_of(spark), F.col("doc_id"), text_hash).sortWithinPartitions(F.col("doc_id"), text_hash, F.col("text"))
    schema = T.StructType(
        [
            source.schema["doc_id"],
            T.StructField("part", T.IntegerType()),
            T.StructField("start_in_part", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    end = struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        e = encoder(tokenizer)
        for b in slices(batches):
            coded = [(e.ids(t.decode()) if t else b"") + end for t in as_bytes(b.column(1))]
            offsets = np.concatenate(([0], np.cumsum(np.array([len(c) // 4 for c in coded], np.int64))))
            values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(coded), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)],
                names=schema.names,
            )
            at += int(offsets[-1])

    (
        ordered.mapInArrow(run, schema)
        .write.mode("overwrite")
        .option("orc.compress", "lz4")
        .option("orc.stripe.size", 16 << 20)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )
    files = spark.read.orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/{PARTS}")


def _offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """How many ids stand before each part: one row for each partition of the writing exchange."""
    at, out = 0, {}
    for r in sorted(spark.read.parquet(f"{path}/{PARTS}").select("part", "n").collect(), key=lambda r: r["part"]):
        out[r["part"]] = at
        at += r["n"]
    return out


def read_token_ids(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the files, stripe by stripe.

    where, a condition on doc_id, goes into the scan, so stripes and groups of
    rows that the file's statistics and Bloom filters rule out aren't read.
    """
    files = spark.read.orc(path)
    offsets = _offsets(spark, path)
    schema = T.StructType([files.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 8192):
            ids = b.column(3)
            bounds = ids.offsets.to_numpy().astype(np.int64)
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            base = np.array([offsets[p] for p in b.column(1).to_pylist()], np.int64)
            crc = [zlib.crc32(values[s * 4 : e * 4]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base + b.column(2).to_numpy()), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=schema.names)

    return (files if where is None else files.where(where)).select("doc_id", "part", "start_in_part", "ids").mapInArrow(run, schema)


def read_ids_of(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """Point read: doc_id, start, n_tokens and the ids themselves, of a few documents.

    The comparison reaches the ORC scan, which skips by the row indexes and Bloom
    filters on doc_id; the offsets come from the table beside the files, so
    nothing else is read.
    """
    files = spark.read.orc(path).where(F.col("doc_id").isin(doc_ids))
    before = F.create_map(*[F.lit(x).cast(t) for part, n in _offsets(spark, path).items() for x, t in ((part, "int"), (n, "long"))] or [F.lit(-1), F.lit(0).cast("long")])
    return files.select("doc_id", (before[F.col("part")] + F.col("start_in_part")).alias("start"), "n_tokens", "ids")
