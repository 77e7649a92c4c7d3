"""Queries of the subpackage over the smallest tables, against plain versions."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nearfield.llm import queries as q

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_op1(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(q.op1_decontaminate(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.op1(docs, items), key=str)
    assert got == want
    assert any(w[-1] for w in want)


def test_op3(spark, docs):
    got = rows(q.op3_licenses(spark, SF), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(brute.op3(docs), key=str)
    assert any(g[2] for g in got)


def test_op4(spark, docs):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in docs}
    got = q.op4_packing(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    places = {(r["bucket"], r["batch"], r["slot"]) for r in got}
    assert len(places) == len(got) == len(docs)
    by = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"] and r["padding"] == r["bucket_len"] - r["n_tokens"]
        by.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_len"])
    assert all(sum(v) <= 65536 or len(v) == 1 for v in by.values())
    assert sum(r["padding"] for r in got) == brute.padding([max(1, n) for n in want.values()], 16)


def test_op2(spark, docs):
    """Scores are those of a plain machine; on labels that it hasn't seen it hardly errs."""
    frame, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = brute.op2(docs, labels, frame)
    got = q.op2_toxicity(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-4) and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    large = SF.replace("sf0.001", "sf0.1")
    true = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    unseen = [(r["predicted"], true[r["doc_id"]]) for r in q.op2_toxicity(spark, large).where("held_out").collect() if true.get(r["doc_id"]) is not None]
    wrong = sum(p != t for p, t in unseen)
    assert len(unseen) > 500 and wrong / len(unseen) < 0.03 and not any(p and not t for p, t in unseen)


def test_op5(spark, docs):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    n = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in docs}
    got = rows(q.op5_token_counts(spark, SF), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((d, len((x or "").encode()), n[d], n[d] > 512) for d, x in docs), key=str)


def test_op6(spark, docs):
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    at, want = 0, []
    for d, x in sorted(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), brute.crc32_of(ids)))
        at += len(ids)
    assert rows(q.op6_token_files(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_op7(spark, docs):
    got = q.op7_quality(spark, SF)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(brute.op7(docs), key=str)
    assert got.where("base_failed AND kept").count() == 0


def test_op8(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = rows(q.op8_warc(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(brute.op8(pages), key=str)


def test_op9(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows(q.op9_chat(spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == sorted(brute.op9([*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)]), key=str)


def test_op10(spark, docs):
    sets = {d: brute.shingles(x, 3) for d, x in docs}
    roots = brute.components(sets, 90)
    got = rows(q.op10_jaccard(spark, SF), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((d, len(s), roots[d]) for d, s in sets.items()), key=str)
    assert any(d != r for d, r in roots.items())
