"""Each stage of the pipeline against a plain version of it, on that stage's own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from nearfield.llm import quality
from nearfield.llm.batches import tables_left

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.count() < before.count()
        assert after.join(before, before.columns, "left_semi").count() == after.count()


def test_quality(stages):
    before, after = stages[0]
    want = [doc for doc, n, _, symbols, _, _, bad in brute.op7(pairs(before)) if not bad and 10 * symbols <= n]
    assert ids(after) == sorted(want)


def test_quality_keeps_clean_labels(spark):
    """Labelled clean and passing the base rules: none is lost, short texts with numbers (4895, 5706) included."""
    large = SF.replace("sf0.001", "sf0.1")
    clean = spark.read.parquet(f"{large}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    docs = spark.read.parquet(f"{large}/documents.parquet").join(clean, "doc_id", "left_semi")
    want = ids(quality.quality_filter(docs, quality.POLICIES["v1"]))
    assert {4895, 5706} <= set(want)
    assert ids(corpus_pipeline.quality_rules(spark, docs, large)) == want


def test_toxicity(spark, stages):
    before, after = stages[1]
    scores = brute.op2(pairs(before), spark.read.parquet(f"{SF}/labels.parquet"), before)
    assert ids(after) == sorted(d for d, s in scores.items() if s < 0.5)


def test_near_duplicates(stages):
    before, after = stages[2]
    sets = {d: brute.shingles(t, 5) for d, t in pairs(before)}
    roots = brute.components(sets, 80)
    assert ids(after) == sorted(d for d in sets if roots[d] == d)


def test_decontamination(spark, stages):
    before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r[0] for r in brute.op1(pairs(before), items) if not r[-1])


def test_packing(stages):
    before, after = stages[4]
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert {r["doc_id"]: r["n_tokens"] for r in after.collect()} == {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in pairs(before)}


def test_run_is_the_stages(spark, stages):
    before = tables_left()
    got = corpus_pipeline.run(spark, SF)
    assert tables_left() == before + 1  # the lengths that the last stage's rows still need
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1][1].collect()))


LONG = " ".join(f"w{i}" for i in range(60))
OTHER = "another text of this id that is long enough for every rule here"
NO_ID = "a text without an id that is long enough for every rule here"
SHORT = "one two three four five six seven eight nine ten eleven twelve"
WEIRD = [(1, LONG), (1, LONG), (1, OTHER), (2, LONG + " more"), (3, None), (4, ""), (None, LONG), (None, NO_ID), (None, None), (5, "x" * 200_000), (6, f"{LONG} " * 3 + "tail " * 2), (7, SHORT)]
#: Names that the operators compute, or use inside.
CLASHING = "n_words long, score string, kept boolean, NODE double, bucket int, block string, text_hash string, mark map<string,int>, row string, id string, n_tokens string"


@pytest.fixture(scope="module")
def weird(spark):
    rows = [(d, t, 5, "s", None, 1.0, 2, "b", "h", {"k": 1}, "r", "i", "n") for d, t in WEIRD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3)


@pytest.mark.parametrize("number", range(5))
def test_stages_stand_weird_rows(spark, weird, number):
    """Nulls, empty and long texts, repeated rows, no rows, and extra columns of clashing names."""
    name, stage = corpus_pipeline.STAGES[number]
    out, none = stage(spark, weird, SF), stage(spark, weird.limit(0), SF)
    got = sorted(((r["doc_id"], r["text"] if number < 4 else None) for r in out.collect()), key=str)
    assert none.count() == 0 and none.columns == out.columns
    if number < 4:
        assert out.columns == weird.columns and out.dtypes == weird.dtypes
    if number == 0:  # ten words or more, few of them repeated
        assert got == sorted([(1, LONG), (1, LONG), (1, OTHER), (2, LONG + " more"), (None, LONG), (None, NO_ID), (7, SHORT)], key=str)
    if number == 1:
        assert len(got) == len(WEIRD)
    if number == 2:  # one row of each group, and 1 of the near copies (6 is one: repeats add no shingles but at the seams)
        assert got == sorted([(1, LONG), (1, OTHER), (3, None), (4, ""), (None, NO_ID), (None, None), (5, "x" * 200_000), (7, SHORT)], key=str)
    if number == 3:
        assert len(got) == len(WEIRD)
    if number == 4:
        assert sorted((d for d, _ in got), key=str) == sorted((d for d, _ in WEIRD), key=str)


def test_run_of_nothing(spark, tmp_path):
    """No documents, no labels and no benchmark: no rows come out."""
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
