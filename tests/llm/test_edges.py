"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm import batches, chat, components, decontaminate, jaccard, licenses, packing, quality, queries, tokencount, tokenfiles, toxicity, warc, words

from . import brute

WEIRD = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, None),
    (3, ""),
    (4, " \n\t\x0b\x0c\r "),
    (None, "no id at all"),
    (5, "MIT License mit license, Apache-License; GENERAL public license É x"),
    (6, "word " * 3000),
    (7, "x" * 70_000),
    (8, "Étude ÀÇ İstanbul ß ſ 漢字かな 😀 <|endoftext|> a b\x85c"),
    (9, "a b"),
    (10, "same line\nsame line\n\n \nother\r\nsame line"),
    (11, "tab\tand\x1cseparator ́combining é"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def weird(spark):
    rows = [(d, t, 5, "clash", True, 1.0) for d, t in WEIRD]
    return spark.createDataFrame(rows, SCHEMA + ", n_words long, score string, kept boolean, NODE double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_decontaminate(spark, weird, empty):
    items = [(1, "quick brown fox jumps"), (2, None), (3, "the quick brown fox jumps over the lazy dog again and"), (None, "a b"), (4, "a b"), (4, "lazy dog again and again"), (5, "--")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.op1(WEIRD, items), key=str)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.decontamination_report(weird, bench), *columns) == want
    assert rows(decontaminate.decontamination_report(weird, bench, block_words=1), *columns) == want
    clean = decontaminate.decontaminate(weird, bench)
    assert clean.columns == weird.columns
    assert clean.count() == sum(not w[-1] for w in want)
    assert decontaminate.decontamination_report(empty, bench).count() == 0
    assert decontaminate.decontamination_report(weird, bench.limit(0)).where("contaminated").count() == 0
    best = decontaminate.decontamination_report(weird, bench).where("doc_id = 1").first()
    assert (best["longest_words"], best["longest_item"], best["longest_doc_word"], best["longest_item_word"]) == (11, "3", 0, 0)
    assert best["hit_spans"] == [[0, 12]]


def test_decontaminate_random(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    items = [(i, text(rng.randint(1, 14))) for i in range(12)]
    got = decontaminate.score_texts([t.encode() for _, t in docs], lambda: [decontaminate.Patterns([(str(i), t.encode()) for i, t in items], 5)])
    want = brute.op1(docs, items, 5)
    assert list(zip(*got[:5], strict=True)) == [w[1:] for w in want]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, 300).astype(np.int32)
    x[-1] = 0
    sa = decontaminate.suffix_array(x, 400)
    tails = [tuple(x[i : i + int(np.flatnonzero(x[i:] == 0)[0])]) for i in sa]
    assert tails == sorted(tails) and len(sa) == (x > 0).sum()


def test_quality(spark, weird, empty):
    got = rows(quality.ledger(weird), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted((w[:-1] for w in brute.op7(WEIRD)), key=str)
    book = quality.ledger(weird)
    for name, policy in quality.POLICIES.items():
        kept = quality.apply_policy(book, policy)
        for r in quality.ablations(book, policy).collect():
            bit = 1 << {x.name: x.bit for x in quality.RULES}[r["rule"]]
            bits = [x["failed_bits"] & policy.mask for x in book.collect()]
            assert (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(not b & ~bit for b in bits)), name
        assert kept.where("kept").count() == sum(not x["failed_bits"] & policy.mask for x in book.collect())
    out = quality.quality_filter(weird)
    assert out.columns == weird.columns and out.dtypes == weird.dtypes
    assert quality.quality_filter(empty).count() == 0 and quality.ablations(quality.ledger(empty), quality.POLICIES["v1"]).count() == 0


def test_toxicity(spark, weird, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(weird, labels)
    assert got.count() == len(WEIRD) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(weird, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.toxicity_filter(weird, labels.limit(0)).columns == weird.columns


def test_toxicity_learns_contexts():
    """An insult is harmless beside a common word that says nothing by itself: only pairs can tell."""
    rng = np.random.default_rng(3)
    terms = toxicity.Terms(18)

    def made(n):
        out, y = [], []
        for _ in range(n):
            w = [f"c{rng.integers(400)}" for _ in range(rng.integers(5, 60))]
            insult, quoted = rng.random() < 0.15, rng.random() < 0.4
            w += ["vile"] * insult + ["quotation"] * quoted
            out.append(terms.of(" ".join(w).encode()))
            y.append(float(insult and not quoted))
        return out, np.array(y, np.float32)

    a, b = made(4000), made(1000)
    errors = []
    for context in (4.0, 1e9):
        m = toxicity.fit(*a, bits=18, context=context)
        s = toxicity.sigmoid(np.array([m.margin(x[m.picked[x]]) for x in b[0]]))
        errors.append(int(((s >= 0.5) != b[1]).sum()))
    assert errors[0] <= 5 < 30 < errors[1]


def test_toxicity_is_reproducible(spark):
    """Of an id with several texts the same one is learned from, however the rows are dealt."""
    made = [(i, f"{'vile scum' if i % 5 == 0 else 'fine day'} {j} w{i % 31}") for i in range(400) for j in range(3)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame(made, SCHEMA)
    one, two = (sorted((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(d, labels).collect()) for d in (docs.repartition(2), docs.repartition(7, "text")))
    assert one == two


def test_toxicity_held_out(spark):
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    made = []
    for i in range(3000):
        w = [rng.choice(common) for _ in range(rng.randint(5, 80))]
        if i % 8 == 0:
            w += rng.sample(["vile", "scum", "rotten", "trash"], 2)
        rng.shuffle(w)
        made.append((i, " ".join(w), int(i % 8 == 0)))
    docs = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id")))
    bad = got.where("predicted <> toxic").count()
    assert got.count() > 400 and bad <= 0.02 * got.count()


def test_pairs_of_terms_are_learned():
    """Toxic only where both terms stand together: linear weights alone can't tell."""
    rng = np.random.default_rng(4)
    x, y = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        noise = rng.integers(10, 500, 5)
        x.append(np.unique(np.concatenate(([1] if a else [], [2] if b else [], noise)).astype(np.int32)))
        y.append(float(a and b))
    m = toxicity.fit(x, np.array(y, np.float32), bits=9, epochs=30)
    score = lambda *t: m.margin(np.array(t, np.int32))
    assert score(1, 2) > 0 > max(score(1), score(2), score())
    assert m.v[1] @ m.v[2] > 0.5


def test_licenses(spark, weird, empty):
    mit = licenses.TEMPLATES["mit"]
    docs = weird.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "x " + mit.upper() + " y"), (21, " ".join(mit.split()[:60]) + " oops " + " ".join(mit.split()[60:])), (22, "permission is hereby")], SCHEMA))
    got = licenses.scan_licenses(docs)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(brute.op3(pairs), key=str)
    found = {r["doc_id"]: r for r in got.collect()}
    assert found[20]["labels"] == "mit" and found[20]["score"] == 1.0 and found[20]["base_labels"] == ""
    assert (found[20]["spans"][0]["start"], found[20]["spans"][0]["covered"]) == (1, len(mit.split()))
    assert found[21]["labels"] == "mit" and len(found[21]["spans"]) == 1
    assert found[22]["labels"] == "" and 0 <= found[22]["score"] < 0.1
    assert found[5]["labels"] == "apache,gpl,mit"
    assert licenses.scan_licenses(empty).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(3)]
    b = licenses.Automaton({str(i): t for i, t in enumerate(texts)}, {})
    strings = {tuple(b.ids(t)[i:j]) for t in texts for i in range(30) for j in range(i + 1, 31)}
    run = b.ids(" ".join(rng.choice("abcd") for _ in range(200)))
    for i, (state, n) in enumerate(b.stream(run)):
        assert n == max(k for k in range(0, i + 2) if k == 0 or tuple(run[i + 1 - k : i + 1]) in strings)
        for k, end in b.ends_at[state]:
            assert b.ids(texts[int(b.templates[k])])[end - n : end] == run[i + 1 - n : i + 1]


def test_licence_clauses_are_found(spark):
    """Clauses that stand without the opening grant, and whole texts, each with its own label."""
    mit, bsd = licenses.TEMPLATES["mit"].split(), licenses.TEMPLATES["bsd"].split()
    made = [(1, " ".join(mit[-70:])), (2, "x " * 50 + " ".join(bsd[75:]) + " y" * 50), (3, " ".join(mit)), (4, " ".join(mit[:5])), (5, " ".join(mit[:60] + ["changed"] + mit[61:]))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(made, SCHEMA)).collect()}
    assert [got[i]["labels"] for i in range(1, 6)] == ["mit", "bsd", "mit", "", "mit"]
    assert got[3]["score"] == 1.0 and got[4]["score"] == 0.0 and got[1]["base_labels"] == ""
    span = got[2]["spans"][0]
    assert (span["label"], span["start"], span["end"]) == ("bsd", 50, 50 + len(bsd) - 75)
    assert got[5]["spans"][0]["covered"] == len(mit) - 1


def test_packing_is_optimal():
    rng = random.Random(9)
    for _ in range(40):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 12))]
        bins = sorted((n, lengths.count(n), n * lengths.count(n)) for n in set(lengths))
        for k in (1, 2, 3):
            bounds = packing.optimal_boundaries(bins, k)
            cost = sum(min(b for b in bounds if b >= n) - n for n in lengths)
            sizes = [b[0] for b in bins]
            from itertools import combinations

            best = min(sum(min(b for b in (*c, sizes[-1]) if b >= n) - n for n in lengths) for m in range(k) for c in combinations(sizes[:-1], m))
            assert cost == best and len(bounds) <= k
    assert packing.optimal_boundaries([], 4) == []


def test_packing(spark, empty):
    lengths = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, -5), (5, 70_000), (6, 4097), (7, 4098), (None, 3), (1, 10)], "doc_id long, n_tokens long")
    got = packing.pack(lengths, n_buckets=3, token_budget=64)
    assert got.count() == 9 and got.where("padding < 0 or bucket_len < n_tokens").count() == 0
    assert got.select("bucket", "batch", "slot").distinct().count() == 9
    assert packing.pack(lengths.limit(0)).count() == 0


def test_packing_across_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    lengths = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("n_tokens"))
    got = packing.pack(lengths, n_buckets=4, token_budget=500).collect()
    by = {}
    for r in got:
        by.setdefault((r["bucket"], r["bucket_len"]), []).append((r["batch"], r["slot"]))
    for (_, length), places in by.items():
        room = max(1, 500 // length)
        assert sorted(places) == [(i // room, i % room) for i in range(len(places))]


def test_packing_bins_are_exact(spark):
    """Lengths beyond 4096 keep bins of their own, unless rounding is asked for."""
    rng = random.Random(12)
    lengths = [rng.choice([rng.randint(1, 50), rng.randint(4000, 9000), rng.randint(10**6, 10**6 + 50)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    bins = sorted((n, lengths.count(n), n * lengths.count(n)) for n in set(lengths))
    assert packing.histogram(df, "n_tokens") == bins
    bounds = packing.optimal_boundaries(bins, 6)
    got = packing.pack(df, n_buckets=6)
    assert sorted({r["bucket_len"] for r in got.collect()}) == bounds
    assert sum(r["padding"] for r in got.collect()) == sum(min(b for b in bounds if b >= n) - n for n in lengths)
    rounded = packing.histogram(df, "n_tokens", 4096)
    assert len(rounded) < len(bins) and sum(c for _, c, _ in rounded) == 400 and all(t <= n * c for n, c, t in rounded)


def test_packing_of_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "LISTED", 64)
    made = [(None, 7)] * 1000 + [(5, 7)] * 300 + [(i, 7 + i % 3) for i in range(200)]
    got = packing.pack(spark.createDataFrame(made, "bucket long, batch long"), id_col="bucket", length_col="batch", n_buckets=2, token_budget=70)
    assert got.columns == ["bucket", "batch", "bucket_", "bucket_len", "batch_", "slot", "padding"]
    rows_ = got.collect()
    assert sorted(((r["bucket"], r["batch"]) for r in rows_), key=str) == sorted(made, key=str)
    for b in {r["bucket_"] for r in rows_}:
        own = [r for r in rows_ if r["bucket_"] == b]
        room = 70 // own[0]["bucket_len"]
        assert sorted((r["batch_"], r["slot"]) for r in own) == [(i // room, i % room) for i in range(len(own))]


def test_token_counts(spark, weird, empty):
    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted(((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in WEIRD), key=str)
    assert rows(tokencount.count_tokens(weird, path), "doc_id", "n_bytes", "n_tokens") == want
    assert tokencount.count_tokens(empty, path).count() == 0


def test_agreed_characters_are_cut_alike():
    """Every character that takes the quick way is cut by the regular expression as the library cuts it."""
    import regex

    c = tokencount.counter(queries.tokenizer("byte_bpe_50k.json"))
    agreed = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not c.odd(chr(i))]
    assert 20_000 < len(agreed) < 60_000
    cut = c.library.pre_tokenizer.pre_tokenize_str
    for i in range(0, len(agreed), 50):
        s = "".join(f"a{x}1{x}!{x} {x}a" for x in agreed[i : i + 50])
        assert [s[b:e] for _, (b, e) in cut(s)] == regex.findall(tokencount.PRE_TOKEN, s)


def test_random_texts_have_the_librarys_tokens():
    c, e = tokencount.counter(queries.tokenizer("byte_bpe_50k.json")), tokenfiles.encoder(queries.tokenizer("word_bpe_49k.json"))
    rng = random.Random(1)
    letters = " \n\t\r\x0b\x1c\x85\xa0abAB'sS’é²½٣12,.!<|>ÀİßΣσς한漢😀́​﻿　_"
    for _ in range(3000):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.2:
            x += "<|endoftext|>" + x[:4] + "<|startoftext|>"
        assert c.count(x) == len(c.library.encode(x, add_special_tokens=False).ids), repr(x)
        assert np.frombuffer(e.ids(x), "<u4").tolist() == e.library.encode(x, add_special_tokens=False).ids, repr(x)


def test_whole_tokens_are_one_token():
    c = tokencount.counter(queries.tokenizer("byte_bpe_50k.json"))
    assert len(c.whole) > 45_000
    some = random.Random(2).sample(sorted(c.whole), 500)
    assert all(len(c.library.encode(t, add_special_tokens=False).ids) == 1 for t in some)


def test_token_files(spark, weird, empty):
    name = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(name)
    path = batches.fresh_path(spark, "t")
    tokenfiles.write_token_ids(weird, path, name, end_id=2)
    got = tokenfiles.read_token_ids(spark, path).collect()
    at, want = 0, []
    for d, x in sorted(WEIRD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), brute.crc32_of(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    path = batches.fresh_path(spark, "t")
    tokenfiles.write_token_ids(empty, path, name, end_id=2)
    assert tokenfiles.read_token_ids(spark, path).count() == 0


def test_token_files_are_pruned(spark):
    """A point read reads a few groups of rows only, and gives the ids and the start that a whole read gives."""
    name = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(name)
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    path = batches.fresh_path(spark, "t")
    tokenfiles.write_token_ids(docs, path, name, end_id=2, partitions=3)
    whole = {r["doc_id"]: r for r in tokenfiles.read_token_ids(spark, path).collect()}
    asked = tokenfiles.read_ids_of(spark, path, [4, 20_000, 20_001, 39_998])
    got = {r["doc_id"]: r for r in asked.collect()}
    assert sorted(got) == [4, 20_000, 39_998]
    for d, r in got.items():
        assert r["ids"] == t.encode(f"text number {d}", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"]) == (whole[d]["start"], whole[d]["n_tokens"]) and brute.crc32_of(r["ids"]) == whole[d]["ids_crc32"]
    ranged = tokenfiles.read_token_ids(spark, path, F.col("doc_id") < 100).collect()
    assert sorted(map(tuple, ranged)) == sorted(tuple(whole[d]) for d in range(0, 100, 2))

    def scanned(ids):
        """Rows that come out of the files, before the filter looks at them."""
        df = spark.read.orc(path).where(F.col("doc_id").isin(ids))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while not plan.nodeName().startswith("Scan"):
            plan = plan.children().apply(0) if plan.children().size() else plan.executedPlan()
        return plan.metrics().apply("numOutputRows").value()

    assert 0 < scanned([20_000]) <= 2000  # row groups of 1000
    assert scanned([20_001]) == 0  # between two ids: only the Bloom filter can tell
    import pyarrow.orc as orc

    files = sorted(Path(path.removeprefix("file:")).glob("*.orc"))
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == 20_000


def test_warc(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>a</p>"), (2, None, "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u", None), (4, "u", ""), (None, "n", "<p>a</p>"), (None, "n", "only null"), (5, "é", "ünïcode\r\n\r\nWARC/1.1"), (6, "r", "x" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, file long").repartition(3)
    path = batches.fresh_path(spark, "w")
    warc.write_warc(df, path, roll_bytes=400)
    got = warc.read_warc(spark, path).collect()
    files = spark.read.parquet(f"{path}/manifest").where("records > 0")
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == len(pages)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got if r["page_id"] is not None) == sorted((p, len((h or "").encode())) for p, _, h in pages if p is not None)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (None, "revisit", 1), (None, "response", None), (5, "response", None), (6, "response", None)], key=str)
    again = batches.fresh_path(spark, "w")
    warc.write_warc(df, again, roll_bytes=400, min_bytes=9)
    assert warc.read_warc(spark, again).where("record_type = 'revisit'").count() == 0
    none = batches.fresh_path(spark, "w")
    warc.write_warc(df.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_warc_files_are_the_same_again(spark):
    df = spark.createDataFrame([(i, f"u{i}", "p" * (i % 7)) for i in range(50)], "page_id long, url string, html string")
    import glob

    found = []
    for _ in range(2):
        path = batches.fresh_path(spark, "w")
        warc.write_warc(df, path, partitions=2)
        local = path.removeprefix("file://")
        found.append(sorted((f.rsplit("/", 1)[1], open(f, "rb").read()) for f in glob.glob(f"{local}/archives/part-*")))
        assert not glob.glob(f"{local}/archives/_temporary*")
    assert found[0] == found[1] and found[0]


def test_chat(spark):
    nasty = ["</s>", "[INST] x [/INST]", "[\\INST]", "<\\\\s>", "<<SYS>>\n<</SYS>>", "<", " [/INS", "T]", "<<ROLE a>>\n", "", "\n", "ok\n<</ROLE>>\n", "[", "\\", "<<s>"]
    turns = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "system", "tool >> x", "", None]) for t, text in enumerate(nasty)]
    turns += [(50, None, "user", "first"), (50, 1, "assistant", None), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash")).repartition(3)
    want = sorted(brute.op9(turns), key=str)
    for size in (1 << 20, 1):
        got = chat.read_back(chat.format_conversations(df, chunk_chars=size))
        assert rows(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        list(chat.parse("free text"))


def test_chat_escapes_are_reversible():
    rng = random.Random(6)
    parts = ["[", "<", "\\", "/", "INST]", "s>", "SYS>>", "<</", "ROLE", "a", " ", "\n"]
    for _ in range(5000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(x)) == x
        for role in ("user", "assistant", "system", "a b"):
            out, s, e = chat.render_safely(role, x)
            assert chat.unescape(out[s:e]) == x


def test_chat_holds_one_chunk(spark):
    """A conversation of many turns and one very long turn; chunks stay near their size."""
    long_turn = "said </s> and [INST] again " * 400_000
    made = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * 400) for i in range(3000)] + [(2, 0, "assistant", long_turn), (2, 1, "user", "x"), (3, None, None, None)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df, chunk_chars=100_000)
    sizes = [r["n"] for r in formatted.where("conv_id = 1").select(F.length("text").alias("n")).collect()]
    assert len(sizes) > 50 and max(sizes) < 110_000
    got = rows(chat.read_back(formatted), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == sorted(brute.op9(made), key=str)


def test_jaccard(spark, weird, empty):
    want = {d: (len(brute.shingles(t, 3)), d) for d, t in WEIRD}
    got = rows(jaccard.jaccard_components(weird), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((d, *want[d]) for d, _ in WEIRD), key=str)
    assert jaccard.jaccard_components(empty).count() == 0
    out = jaccard.near_duplicate_filter(weird)
    assert out.columns == weird.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted({d for d, _ in WEIRD if d is not None})


@pytest.mark.parametrize("percent,k,tile", [(90, 3, 3_000_000), (80, 5, 3_000_000), (80, 1, 2_000), (70, 2, 5_000), (100, 3, 3_000_000)])
def test_jaccard_near_copies(spark, percent, k, tile):
    """Chains of edits of many sizes, so that pairs lie on both sides of the threshold."""
    rng = random.Random(percent + k)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, shared = [], " ".join(rng.choice(vocabulary) for _ in range(40))
    for size in (1, 2, 3, 5, 8, 13, 30, 60, 100, 180, 260):
        w = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(0, max(1, size // 25))):
                how, at = rng.randint(0, 2), rng.randrange(len(w))
                w[at : at + (how != 0)] = [] if how == 1 and len(w) > 1 else [rng.choice(vocabulary)]
    texts += [f"{shared} {rng.choice(vocabulary)} {' '.join(rng.choice(vocabulary) for _ in range(20))}" for _ in range(20)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    sets = {i: brute.shingles(t, k) for i, t in enumerate(texts)}
    roots = brute.components(sets, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k=k, percent=percent, tile_shingles=tile).collect()}
    assert got == {i: (len(s), roots[i]) for i, s in sets.items()}


def test_linked_sets_always_share_a_key():
    rng = np.random.default_rng(8)
    heats = [None] + [np.where(rng.random(jaccard.HEAT_SLOTS // 2) < share, rng.integers(0, 256, jaccard.HEAT_SLOTS // 2), 0).astype(np.uint8) for share in (0.3, 1.0)]
    for percent in (70, 80, 90):
        for n in [1, 2, 3, 4, 5, 7, 10, 15, 16, 23, 24, 40, 61, 62, 100, 400]:
            for _ in range(25):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                b = a.copy()
                while True:
                    drop, add = rng.integers(0, 2), rng.integers(0, 3)
                    c = np.unique(np.concatenate((b[rng.permutation(len(b))[drop:]], rng.integers(0, 2**63, add, dtype=np.uint64) * np.uint64(2))))
                    x = len(np.intersect1d(a, c))
                    if not len(c) or 100 * x < percent * (len(a) + len(c) - x):
                        break
                    b = c
                    if rng.random() < 0.02:
                        break
                for i, heat in enumerate(heats):
                    x, y = jaccard.keys_of(a, percent, heat), jaccard.keys_of(b, percent, heat)
                    assert len(np.intersect1d(x[0], y[0])), (percent, i, len(a), len(b))
                    assert (np.diff(x[1].astype(int)) >= 0).all()
                assert jaccard.Signature(len(a), jaccard.signature(a)).may_link(jaccard.Signature(len(b), jaccard.signature(b)), percent)


def test_linked_sets_meet_in_a_block_or_are_left_open():
    """Own blocks are those of the level; pivots go to all of them."""
    keys, levels = np.arange(100, dtype=np.uint64), np.repeat(np.arange(10, dtype=np.uint8), 10)
    for node in range(-3000, 3000, 7):
        key, block = jaccard.deal_keys(node, keys, levels)
        for k, level in zip(keys.tolist(), levels.tolist(), strict=True):
            got, n = sorted(block[key == k].tolist()), int(jaccard.level_blocks(3)[level])
            assert got == [0] if n == 1 else got == list(range(1, n + 1)) or len(got) == 1 and 1 <= got[0] <= n


def test_jaccard_links_through_a_null_id(spark):
    w = [f"w{i}" for i in range(40)]
    texts = [" ".join(w), " ".join([*w, "x1", "x2"]), " ".join([*w, "x1", "x2", "x3", "x4"])]
    docs = spark.createDataFrame([(7, texts[0]), (None, texts[1]), (3, texts[2]), (None, texts[1]), (3, "another text of this id"), (None, "alone here")], SCHEMA)
    got = rows(jaccard.jaccard_components(docs), "doc_id", "component_id")
    assert got == sorted([(7, 3), (None, 3), (None, 3), (3, 3), (3, 3), (None, None)], key=str)
    kept = rows(jaccard.near_duplicate_filter(docs, k=3, percent=90), "doc_id", "text")
    assert kept == sorted([(3, texts[2]), (3, "another text of this id"), (None, "alone here")], key=str)
    no_ids = spark.createDataFrame([(None, texts[1]), (None, texts[1]), (None, texts[0]), (None, ""), (None, None)], SCHEMA)
    assert jaccard.near_duplicate_filter(no_ids, k=3, percent=90).count() == 3


def test_repeated_rows_keep_the_smallest(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "z", {"k": 2}), (1, "a b c d e f g", "y", {"k": 1}), (2, "a b c d e f g", "x", None), (3, None, "b", None), (3, None, "a", None)], "doc_id long, text string, row string, mark map<string,int>")
    got = rows(jaccard.near_duplicate_filter(docs), "doc_id", "text", "row", "mark")
    assert got == [(1, "a b c d e f g", "y", {"k": 1}), (3, None, "a", None)]


@pytest.mark.parametrize("family", [6000, 50_000])
def test_jaccard_of_a_large_family(spark, family):
    """Near copies that link only with those edited nearby, and three kinds of outsiders that hold half of the family's words."""
    rng = random.Random(family)
    base, made = [f"w{i}" for i in range(60)], []
    for i in range(family):
        w, at = list(base), rng.randrange(58)
        w[at : at + 2] = [f"x{i % 5}", f"x{i % 7}"] if i % 9 else [f"x{i}", f"y{i}"]
        made.append((i, " ".join(w)))
    n = max(i for i, _ in made) + 1
    made += [(n + j, " ".join(base[:30] + [f"t{j % 3}y{m}" for m in range(60)] + [f"q{j}"])) for j in range(300)]
    rng.shuffle(made)
    docs = spark.createDataFrame(made, SCHEMA).repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, percent=80).collect()}
    assert [got[i] for i in range(family)] == [0] * family
    assert [got[n + j] for j in range(300)] == [n + j % 3 for j in range(300)]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 1), (8, 9)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 161)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = " ".join(f"word{i}\n" for i in range(2000)).encode() + b"y" * 500 + b" z"
    whole = words.space_word_hashes(text)
    monkeypatch.setattr(words, "PIECE", 64)
    assert (words.space_word_hashes(text) == whole).all()
    assert len(whole) == len(text.split())

def test_memory_of_the_fit_goes_back(spark):
    """Blocks freed between ones that stay: the process's own memory falls when they are given back."""
    import re
    from pathlib import Path

    from nearfield.llm.batches import give_back

    def own():
        return int(re.search(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) / 1024

    rows = [bytes(8000) for _ in range(20_000)]
    stay = rows[::100]
    del rows
    before = own()
    give_back()
    assert len(stay) == 200 and own() < before - 80
