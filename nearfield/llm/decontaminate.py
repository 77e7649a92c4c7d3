"""Benchmark decontamination with suffix arrays of the training shards.

Each Arrow batch of documents is a shard. Of its words only runs that can hold
a match matter: a match cannot contain a word that no benchmark item has, and
is at least as long as the shortest window. The suffixes of those runs are
sorted by prefix doubling; every suffix of the benchmark is then binary-searched
in that array. The interval it finds is all its occurrences, which are marked
as hits, and each is extended to its longest verbatim match.

A window is `window` consecutive words of an item; a shorter item that has
words is one window. The benchmark goes to the executors in blocks of at most
about `block_words` words (one larger item makes a block of its own), packed; each
shard of documents meets the blocks one by one, and one is unpacked at a time.
What a worker holds of a benchmark is thus its packed bytes (about 4 MB for
500,000 words) and one block: benchmarks of some hundred million words are the
limit, far above those in use.

Defined results: a null or empty text has no words and no hits; null item ids
and item texts without words match nothing; repeated document rows each give a
row; repeated item ids count once; with an empty benchmark nothing is hit;
without documents there are no rows. A very long text is a shard of its own, in
memory of a few times its size. Kept columns give way to a computed one of the
same name; the filter keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .batches import map_texts
from .words import alnum_words

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("longest_words", T.LongType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_doc_word", T.LongType()),
    T.StructField("longest_item_word", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
]
#: Text bytes of a shard; its suffix array lives in memory.
SHARD_BYTES = 8 << 20


class Patterns:
    """A block of the benchmark: its vocabulary, suffixes, and the windows' items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = 10):
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        pool, seen = [], {}
        starts, lengths, windows = [], [], []
        owners: list[set[int]] = []
        at = 0
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in alnum_words(text)]
            if item is None or not words:
                continue
            own = len(self.items)
            self.items.append(item)
            pool += [*words, 0]
            size = min(window, len(words))
            for s in range(len(words) - size + 1):
                key = tuple(words[s : s + size])
                if key not in seen:
                    seen[key] = len(owners)
                    owners.append(set())
                owners[seen[key]].add(own)
                starts.append(at + s)
                lengths.append(size)
                windows.append(seen[key])
            at += len(words) + 1
        self.pool = np.array(pool or [0], np.int32)
        ends = np.flatnonzero(self.pool == 0)
        self.item_end = ends[np.searchsorted(ends, np.arange(len(self.pool)))]
        self.item_of = np.searchsorted(ends, np.arange(len(self.pool)))
        self.item_start = np.concatenate(([0], ends[:-1] + 1))
        self.start = np.array(starts, np.int64)
        self.length = np.array(lengths, np.int64)
        self.window = np.array(windows, np.int64)
        self.depth = max(lengths, default=0)
        self.least = min(lengths, default=1)
        self.longest_item = int(max(np.diff(np.concatenate(([-1], ends))), default=1))
        self.owner_at = np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int64)
        self.owners = np.array([i for x in owners for i in sorted(x)], np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero words, by their suffixes up to the next 0, to at least depth words."""
    n = len(text)
    at = np.flatnonzero(text)
    if not len(at):
        return at
    ends = np.flatnonzero(np.concatenate((text, [0])) == 0)
    left = ends[np.searchsorted(ends, at)] - at
    rank = np.zeros(n + 1, np.int64)
    rank[at] = text[at]
    h = 1
    while True:
        second = np.where(left > h, rank[np.minimum(at + h, n)], 0)
        key = rank[at] * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        rank[at[order]] = new
        h *= 2
        if h >= depth or new[-1] == len(at):
            return at[order]


def _bounds(text: np.ndarray, sa: np.ndarray, patterns: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """For each pattern, how many suffixes come before it (or, with upper, before or begin with it)."""
    lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(sa), np.int64)
    reach = np.arange(patterns.shape[1])
    inside = reach < lengths[:, None]
    rows = np.arange(len(patterns))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        got = text[np.minimum(sa[np.minimum(mid, len(sa) - 1)][:, None] + reach, len(text) - 1)].astype(np.int64)
        diff = np.where(inside, got - patterns, 0)
        # behind the suffix's end the text goes on with another run; the 0 between ends the comparison first
        first = diff[rows, np.argmax(diff != 0, axis=1)]
        right = open_ & ((first <= 0) if upper else (first < 0))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def find(text: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """All (position in text, index of the test suffix) where the suffix's window occurs; text ends with 0."""
    none = np.empty(0, np.int64)
    if not len(p.start) or not text.any():
        return none, none
    sa = suffix_array(text, max(p.depth, 2))
    _, first, back = np.unique(p.window, return_index=True, return_inverse=True)
    begins, sizes = p.start[first], p.length[first]
    grid = p.pool[np.minimum(begins[:, None] + np.arange(p.depth), len(p.pool) - 1)].astype(np.int64)
    # a window with a word that the shard hasn't can't be found, and most have one
    held = np.zeros(len(p.vocab) + 1, bool)
    held[text] = True
    some = np.flatnonzero((held[grid] | (np.arange(p.depth) >= sizes[:, None])).all(1))
    lo, hi = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    lo[some] = _bounds(text, sa, grid[some], sizes[some], False)
    hi[some] = _bounds(text, sa, grid[some], sizes[some], True)
    n = (hi - lo)[back]
    which = np.repeat(np.arange(len(back)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return sa[lo[back][which] + offset], which


def extend(text: np.ndarray, at: np.ndarray, p: Patterns, which: np.ndarray) -> np.ndarray:
    """Words of the longest match that begins at each occurrence."""
    size = p.length[which].copy()
    live = np.arange(len(at))
    while len(live):
        t, b = at[live] + size[live], p.start[which[live]] + size[live]
        same = (t < len(text)) & (b < p.item_end[p.start[which[live]]])
        same[same] = text[t[same]] == p.pool[b[same]]
        live = live[same]
        size[live] += 1
    return size


class _Found:
    """What the blocks have shown of one document so far."""

    __slots__ = ("spans", "items", "best")

    def __init__(self):
        self.spans, self.items, self.best = [], set(), (0, None, None, None)


def _match(ids: list[np.ndarray], p: Patterns, found: dict[int, _Found]) -> None:
    """One shard against one block: ids has the words of each document, 0 for words the block has not."""
    parts, doc_of, word_of = [], [], []
    for d, x in enumerate(ids):
        if len(x) < p.least:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], x > 0, [False])).view(np.int8)))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= p.least:
                parts += [x[s:e], np.zeros(1, np.int32)]
                doc_of.append(np.full(e - s + 1, d))
                word_of.append(np.arange(s, e + 1))
    if not parts:
        return
    text, doc_of, word_of = np.concatenate(parts), np.concatenate(doc_of), np.concatenate(word_of)
    at, which = find(text, p)
    if not len(at):
        return
    size = extend(text, at, p, which)
    item = p.item_of[p.start[which]]
    # the longest of each document; ties go to the earlier place, then the earlier item
    order = np.lexsort((p.start[which], word_of[at], -size, doc_of[at]))
    docs, first = np.unique(doc_of[at][order], return_index=True)
    for d, i in zip(docs.tolist(), order[first].tolist(), strict=True):
        f = found.setdefault(d, _Found())
        begin = int(p.start[which[i]] - p.item_start[item[i]])
        if size[i] > f.best[0]:
            f.best = (int(size[i]), p.items[item[i]], int(word_of[at[i]]), begin)
    places, pick = np.unique(at * (len(p.owner_at) + 1) + p.window[which], return_index=True)
    for i in pick.tolist():
        w, d = p.window[which[i]], int(doc_of[at[i]])
        f, s = found[d], int(word_of[at[i]])
        f.spans.append((s, s + int(p.length[which[i]])))
        f.items.update(p.items[o] for o in p.owners[p.owner_at[w] : p.owner_at[w + 1]].tolist())


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def score_texts(texts: list[bytes | None], blocks) -> list[list]:
    """The FIELDS of each text; blocks yields Patterns anew at each call."""
    rows: list[tuple] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= SHARD_BYTES):
            size += len(texts[end] or b"")
            end += 1
        shard, counts = texts[at:end], [0] * (end - at)
        found: dict[int, _Found] = {}
        for p in blocks():
            get, ids = p.vocab.get, []
            for i, t in enumerate(shard):
                words = alnum_words(t)
                counts[i] = len(words)
                ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            _match(ids, p, found)
        for i, n in enumerate(counts):
            f = found.get(i) or _Found()
            spans, items = _union(f.spans), sorted(f.items)
            n_hit = sum(e - s for s, e in spans)
            rows.append((n, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, *f.best, spans))
        at = end
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]


def benchmark_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> list:
    """Broadcasts of Patterns, packed. Only one block's texts are on the driver at a time."""
    b = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    b = b.where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_words * 4)))
    out = []
    for k in range(n):
        part = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else b
        rows = sorted((r["item"], r["text"]) for r in part.collect())
        packed = zlib.compress(pickle.dumps(Patterns([(i, t.encode()) for i, t in rows], window)), 1)
        out.append(spark.sparkContext.broadcast(packed))
    return out


def decontamination_report(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = 500_000,
    keep_if: bool = False,
) -> DataFrame:
    """FIELDS for each document beside the columns in keep.

    With keep_if, instead the columns in keep of documents without a hit.
    """
    blocks = benchmark_blocks(docs.sparkSession, benchmark, item_col, item_text_col, window, block_words)

    def make():
        unpack = lambda b: pickle.loads(zlib.decompress(b.value))
        one = unpack(blocks[0]) if len(blocks) == 1 else None

        def each():
            if one is not None:
                yield one
            else:
                yield from map(unpack, blocks)

        return lambda texts: score_texts(texts, each)

    if keep_if:
        clean = T.StructField("__clean", T.BooleanType())

        def make_clean():
            score = make()
            return lambda texts: [[not hit for hit in score(texts)[4]]]

        return map_texts(docs, [clean], make_clean, text_col, keep, keep_if="__clean")
    return map_texts(docs, FIELDS, make, text_col, keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that share no window with the benchmark."""
    return decontamination_report(docs, benchmark, keep=tuple(docs.columns), keep_if=True, **options)
