"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and their prefixes of four
and five characters, hashed to `2 ** bits` buckets; presence counts, not
frequency. The machine scores  b + sum w_i + sum_{i<j} <v_i, v_j>, so a pair such
as an insult with a group mention can weigh more than its parts, or less.
Weights w go to terms that lean towards toxic rows of the sample; factors v to
these and to the terms beside them that change the share of toxic rows there,
whatever they say alone. All others weigh nothing.

It is fitted on the driver on a bounded sample of labelled rows: at most about
`max_train` rows, taken by a hash of the id, whatever the size of the corpus; a
few fits in different orders are averaged, which is a machine again.
Held-out rows (crc32 of the id as text, modulo `folds`, is 0) are never used.
Scoring is one pass over all texts with the fitted arrays broadcast (a fixed
number of bytes).

Defined results: a null or empty text has no terms and scores as the bias says;
a very long text is the set of its terms like others; labelled rows with a null
label or id are ignored; if an id has several labels, 1 wins; if it has several
texts, the one with the smallest hash is the sample's; without any positive
label every score is below 1e-12; repeated rows each give a row; without
documents there are no rows. Kept columns give way to a computed one of the
same name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import as_bytes, give_back, map_texts, slices
from .words import alnum_words

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
#: Words a task remembers, none longer than LONG bytes; then it starts anew.
REMEMBERED, LONG = 250_000, 64


class Terms(dict):
    """Word to its buckets."""

    def __init__(self, bits: int, picked: np.ndarray | None = None):
        """With picked (a flag for each bucket), only flagged buckets count."""
        super().__init__()
        self.mask, self.picked = (1 << bits) - 1, picked

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        text = word.decode()
        forms = [b"w" + word, *(b"p" + text[:n].encode() for n in (4, 5) if len(text) > n)]
        out = tuple(zlib.crc32(f) & self.mask for f in forms)
        if self.picked is not None:
            out = tuple(b for b in out if self.picked[b])
        if len(word) <= LONG:
            self[word] = out
        return out

    def of(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct buckets of a text."""
        found: set[int] = set()
        for w in set(alnum_words(text)):
            found.update(self[w])
        return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class Machine:
    bits: int
    bias: float
    w: np.ndarray
    v: np.ndarray
    picked: np.ndarray

    def margin(self, terms: np.ndarray) -> float:
        if not len(terms):
            return self.bias
        v = self.v[terms]
        total = v.sum(0)
        return float(self.bias + self.w[terms].sum() + 0.5 * (total @ total - (v * v).sum()))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def lean(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """How many standard deviations a term's share of toxic rows lies above that of the rows; -inf for terms in one row or none."""
    if not rows:
        return np.full(n, -np.inf)
    seen = np.bincount(np.concatenate(rows), minlength=n).astype(np.float64)
    toxic = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t] or [np.empty(0, np.int32)]), minlength=n)
    share = float(y.mean())
    return np.where(seen > 1, (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9)), -np.inf)


def fit(rows: list[np.ndarray], y: np.ndarray, *, bits: int, rank: int = 4, epochs: int = 12, rate: float = 0.15, l2: float = 2e-5, least_lean: float = 4.0, context: float = 4.0, batch: int = 256, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss over mini-batches, rows in a seeded order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = 1 << bits
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.01, (n, rank)).astype(np.float32)
    gw, gv = np.full(n, 1e-2, np.float32), np.full((n, rank), 1e-2, np.float32)
    rate_of_1 = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    bias, gb = float(np.log(rate_of_1 / (1 - rate_of_1))), 1e-2
    if not len(y) or not y.any():
        return Machine(bits, -30.0, w, v * 0, np.zeros(n, bool))
    # only terms that stand in toxic rows more often than chance allows get weights, so that a long text isn't
    # judged by the sum of thousands of terms that say nothing
    leaning = lean(rows, y, n) >= least_lean
    # terms that say nothing by themselves keep their factors if they change what rows with a leaning term are:
    # a context that makes an insult worse, or harmless
    beside = [i for i, r in enumerate(rows) if leaning[r].any()]
    within = lean([rows[i] for i in beside], y[beside], n)
    picked = leaning | (np.isfinite(within) & (np.abs(within) >= context))
    rows = [r[picked[r]] for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids = np.concatenate([rows[i] for i in pick])
            sizes = np.array([len(rows[i]) for i in pick])
            if not len(ids):
                continue
            owner = np.repeat(np.arange(len(pick)), sizes)
            vi = v[ids]
            total = np.zeros((len(pick), rank), np.float32)
            np.add.at(total, owner, vi)
            own = np.bincount(owner, (vi * vi).sum(1), len(pick))
            margin = bias + np.bincount(owner, w[ids], len(pick)) + 0.5 * ((total * total).sum(1) - own)
            err = (sigmoid(margin) - y[pick]).astype(np.float32)
            e = err[owner]
            u, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, e, len(u)).astype(np.float32) + l2 * w[u] * batch
            part = e[:, None] * (total[owner] - vi)
            dv = np.stack([np.bincount(back, part[:, k], len(u)) for k in range(rank)], 1).astype(np.float32) + l2 * v[u] * batch
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= np.where(leaning[u], rate * dw / np.sqrt(gw[u]), 0)
            v[u] -= 0.3 * rate * dv / np.sqrt(gv[u])
            db = float(err.sum())
            gb += db * db
            bias -= rate * db / gb**0.5
    v[~picked] = 0
    return Machine(bits, bias, w, v, picked)


def fit_several(rows: list[np.ndarray], y: np.ndarray, *, machines: int = 3, seed: int = 7, **options) -> Machine:
    """The mean of machines fitted in different orders, which is one machine with the factors of all side by side."""
    each = [fit(rows, y, seed=seed + i, **options) for i in range(machines)]
    v = np.concatenate([m.v for m in each], axis=1) / np.float32(machines**0.5)
    return Machine(each[0].bits, float(np.mean([m.bias for m in each])), np.mean([m.w for m in each], axis=0), v, each[0].picked)


def held_out(id_column, folds: int = 5):
    return F.crc32(id_column.cast("string").cast("binary")) % folds == 0


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, folds: int, max_train: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets and labels of the sample.

    The labels are aggregated and sampled first; only the sample (about
    max_train ids) is broadcast against the documents, so the texts never move.
    """
    key = F.col(f"`{id_col}`")
    known = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"), folds))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_train / n * (1 << 30)))
    sample = docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(known), "id").select("id", "y", "text", F.xxhash64("text").alias("order"))

    def extract(batches):
        import pyarrow as pa

        terms = Terms(bits)
        for b in slices(batches):
            found = [terms.of(t) for t in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array([f.tobytes() for f in found], pa.binary()), b.column(3)], names=["id", "y", "terms", "order"])

    found = sample.mapInArrow(extract, "id string, y int, terms binary, order long").groupBy("id").agg(F.max("y").alias("y"), F.min_by("terms", "order").alias("terms")).toArrow()
    found = found.sort_by("id")
    terms = [np.frombuffer(t.as_buffer(), np.int32) for t in found.column("terms")]  # views of the table, without a copy
    return terms, (found.column("y").to_numpy() > 0).astype(np.float32)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    max_train: int = 12_000,
    bits: int = 18,
    machines: int = 3,
    threshold: float = 0.5,
    keep: tuple[str, ...] = ("doc_id",),
    keep_if: bool = False,
) -> DataFrame:
    """score and predicted beside the columns in keep; with keep_if only those columns, of rows below the threshold."""
    rows, y = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, max_train=max_train, bits=bits)
    model = docs.sparkSession.sparkContext.broadcast(fit_several(rows, y, bits=bits, machines=machines))
    del rows, y
    give_back()

    def make():
        m = model.value
        terms = Terms(bits, m.picked)

        def score(texts):
            s = sigmoid(np.array([m.margin(terms.of(t)) for t in texts], np.float64))
            return [s, (s >= threshold).astype(np.int32)]

        return score

    if not keep_if:
        return map_texts(docs, FIELDS, make, text_col, keep)

    def make_clean():
        score = make()
        return lambda texts: [score(texts)[1] == 0]

    return map_texts(docs, [T.StructField("__clean", T.BooleanType())], make_clean, text_col, keep, keep_if="__clean")


def toxicity_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    return score_toxicity(docs, labels, keep=tuple(docs.columns), keep_if=True, **options)
