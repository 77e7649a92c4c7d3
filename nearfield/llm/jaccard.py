"""N-gram Jaccard self-join: size-banded tiles with hashed bitmap signatures.

A document's set is its distinct k-word shingles (64-bit hashes). Two sets link
when 100 * |A & B| >= percent * |A | B|. Every link between different sets is
found exactly, without all pairs:

1. Equal sets fall together: a *node* is the hash of a whole set.
2. In any fixed order of all shingles, two linked sets share one of their first
   |A| - ceil(percent / 100 * |A|) + 1 shingles: these are a node's keys. The
   order puts frequent shingles last, the most frequent ones at the very end, so
   a passage that many documents share hardly ever brings them together. Nodes
   under a key are taken in order of size, and a gap too wide for a link ends
   their group.
3. A bitmap signature of each node (a bit for each hashed shingle, as wide as the
   set) bounds the overlap of two sets from above: a bit of A that B lacks is a
   shingle that B lacks. Of the nodes that share a key, pairs that pass the bound
   are candidates; a spanning forest of them is kept, and its components, by
   size band, are the tiles. So each set moves once (twice at the border of a
   band), however many keys it shares.
4. In a tile the bound is taken again with wider bitmaps, and pairs that pass and
   aren't connected yet are intersected exactly, as sorted arrays.
5. The links of all tiles give the components.

A frequent key and a large tile (one family of near copies may be a third of
all rows) are dealt in two rounds, so that no task has a whole one:

* First round: each node goes to one block of its group by hash, and a few nodes,
  the pivots, go to all blocks. What meets in a block is joined there.
* Second round: only pairs in different components are still open, and one side
  of such a pair lies outside the group's largest component. Those outside, in
  chunks, meet every block of the group, pairs already joined aside. So a family
  costs in proportion to its size, and only groups of many sets that are
  nowhere near each other cost more (chunks times blocks, in as many tasks).

Defined results: a null or empty text, and one without words, has an empty set
and is linked with nothing; with fewer than k words the whole sequence is one
shingle; a row with a null id links like any other, and belongs to the smallest
id of its component (null if none of it has an id); repeated rows each give a
row; without documents there are no rows. Very long texts are whole sets like
others; a slice of rows is cut by bytes, so memory holds one of them at a time.
Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import partitions_of, shared_dir
from .batches import as_bytes, map_texts, slices, written
from .components import connected_components
from .words import mix, shingle_set

#: Slots of the table of frequent shingles, four bits each: 8 MB, whatever the input. Any table gives the same result; a good one is fast.
HEAT_SLOTS = 1 << 24
#: One in so many texts is counted to choose frequent shingles: those in so many of these or more, and no more shingles than an eighth of the slots.
HEAT_SAMPLE, HEAT_LEAST = 16, 3
#: Least and largest number of nodes in a block, and nodes expected to go to all blocks of a group.
BLOCK_LEAST, BLOCK_MOST, PIVOTS = 128, 8192, 16
#: Bits of the bitmap that picks texts in the last scan: 1 MB, whatever the input.
PICK_BITS = 1 << 23
#: Nodes, or texts, that a task remembers so that equal ones go on once.
SEEN = 200_000
#: Refused pairs that a task remembers, so that they aren't compared for every key they share.
REFUSED = 200_000
#: Nodes under all keys of one first node that are gathered before they go on.
HELD = 200_000
EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
MET = T.StructType([T.StructField("first", T.LongType()), T.StructField("key", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("node", T.LongType())])
GROUPS = T.StructType([T.StructField("first", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def node_of(s: np.ndarray) -> int:
    """The hash of a set, as a signed 64-bit integer; different sizes never fall together."""
    total = (int(mix(s).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def band_edges(percent: int, most: int = 1 << 40) -> list[int]:
    """First sizes of the bands: each about 1.5 times the one before, or more for a low threshold."""
    ratio = max(150, 10_000 // percent + 5)
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * ratio // 100)))
    return out


def levels_of(s: np.ndarray, heat: np.ndarray | None) -> np.ndarray:
    """How frequent the table says each shingle is: 0 for rare, then a level for each factor of 4."""
    if heat is None:
        return np.zeros(len(s), np.uint8)
    slot = s & np.uint64(HEAT_SLOTS - 1)
    return (heat[(slot >> np.uint64(1)).astype(np.int64)] >> ((slot & np.uint64(1)) << np.uint64(2)).astype(np.uint8)) & 15


def keys_of(s: np.ndarray, percent: int, heat: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, in the order that puts frequent ones last, and their levels."""
    n = len(s)
    first = n - -(-percent * n // 100) + 1
    levels = levels_of(s, heat)
    order = np.lexsort((mix(s), levels))[:first]
    return s[order], levels[order]


def level_texts(least: int) -> np.ndarray:
    """Texts that hold a shingle of each level, at most about, if level 1 begins with least texts of the sample."""
    return np.array([0, *(HEAT_SAMPLE * least * 4**i for i in range(1, 16))], np.float64)


def level_blocks(least: int) -> np.ndarray:
    """Into how many blocks the nodes of a key are dealt, by the level of the key."""
    texts = level_texts(least)
    return np.maximum(1, texts / np.clip(texts / 64, BLOCK_LEAST, BLOCK_MOST)).astype(np.int64)


def deal_keys(node: int, keys: np.ndarray, levels: np.ndarray, least: int = HEAT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(key, block) of a node: block 0 for keys that aren't split, else from 1 on, and all of them for a pivot."""
    blocks = level_blocks(least)[levels]
    if blocks.max(initial=1) == 1:
        return keys, np.zeros(len(keys), np.int32)
    h = int(mix(np.array([node], np.int64).view(np.uint64))[0]) >> 1
    own = np.where(blocks > 1, 1 + h % blocks, 0)
    pivot = (blocks > 1) & ((h >> 39) < PIVOTS / np.maximum(level_texts(least)[levels], 1) * (1 << 24))
    if not pivot.any():
        return keys, own.astype(np.int32)
    all_of = [np.arange(1, b + 1) for b in blocks[pivot]]
    more = np.repeat(keys[pivot], blocks[pivot])
    return np.concatenate((keys[~pivot], more)), np.concatenate((own[~pivot], *all_of)).astype(np.int32)


def signature(s: np.ndarray) -> bytes:
    """A bitmap with about as many bits as the set has shingles (64 to 8192, a power of two)."""
    width = min(8192, max(64, 1 << (len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[((mix(s) >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Signature:
    """A set's size and bitmap, comparable at the narrower of two widths."""

    __slots__ = ("size", "width", "bits")

    def __init__(self, size: int, data: bytes):
        self.size, self.width, self.bits = size, 8 * len(data), int.from_bytes(data, "little")

    def narrow(self, width: int) -> int:
        bits, at = self.bits, self.width
        while at > width:
            at //= 2
            bits = (bits >> at) | (bits & ((1 << at) - 1))
        return bits

    def may_link(self, other: Signature, percent: int) -> bool:
        """False only if the two sets can't link."""
        a, b = self.size, other.size
        if 100 * min(a, b) < percent * max(a, b):
            return False
        width = min(self.width, other.width)
        x, y = self.narrow(width), other.narrow(width)
        both = (x & y).bit_count()
        bound = min(a - x.bit_count() + both, b - y.bit_count() + both)
        return (100 + percent) * bound >= percent * (a + b)


class Forest:
    """Union-find over nodes, with the pairs that have been refused."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.refused: set[tuple[int, int]] = set()

    def find(self, x: int) -> int:
        p = self.parent
        while (up := p.get(x, x)) != x:
            p[x] = p.get(up, up)
            x = up
        return x

    def candidates(self, group: list[tuple[int, Signature]], percent: int) -> list[tuple[int, int]]:
        """Joins the nodes of a key that may link and aren't joined yet; returns the new edges."""
        by: dict[int, list[tuple[int, Signature]]] = {}
        for node, sig in group:
            by.setdefault(self.find(node), []).append((node, sig))
        if len(by) < 2:
            return []
        out, rest = [], sorted(by.values(), key=len, reverse=True)
        done: list[list[tuple[int, Signature]]] = []
        for members in rest:
            for other in done:
                if self.find(members[0][0]) == self.find(other[0][0]):
                    continue
                if edge := self._first(members, other, percent):
                    out.append(edge)
                    x, y = sorted((self.find(edge[0]), self.find(edge[1])))
                    self.parent[y] = x
            done.append(members)
        return out

    def _first(self, members, other, percent: int) -> tuple[int, int] | None:
        for a, x in members:
            for b, y in other:
                pair = (a, b) if a < b else (b, a)
                if pair in self.refused:
                    continue
                if x.may_link(y, percent):
                    return pair
                if len(self.refused) >= REFUSED:
                    self.refused.clear()
                self.refused.add(pair)
        return None


def links_in_tile(nodes: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, roots: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs in a tile.

    side: with it only pairs of a node of side 0 and one of side 1 count.
    roots: the component that each node is known to be in.
    """
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, sets, sizes = nodes[order], [sets[i] for i in order], sizes[order]
    side = side[order] if side is not None else None
    width = 64
    while width < min(4096, 2 * int(sizes.max(initial=1))):
        width *= 2
    bits = np.zeros((n, width // 64), np.uint64)
    for i, s in enumerate(sets):
        b = (mix(s) >> np.uint64(20)) & np.uint64(width - 1)
        np.bitwise_or.at(bits[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    ones = np.bitwise_count(bits).sum(1).astype(np.int64)
    group = np.arange(n) if roots is None else np.unique(roots[order], return_inverse=True)[1]
    out = []
    for i in range(n):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, side="right"))
        js = np.arange(i + 1, end)
        js = js[group[js] != group[i]]
        if side is not None and len(js):
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        for at in range(0, len(js), 8192):
            j = js[at : at + 8192]
            both = np.bitwise_count(bits[j] & bits[i]).sum(1).astype(np.int64)
            bound = np.minimum(sizes[i] - (ones[i] - both), sizes[j] - (ones[j] - both))
            # 100 x >= percent (a + b - x)
            for k in j[(100 + percent) * bound >= percent * (sizes[i] + sizes[j])].tolist():
                if group[k] == group[i]:
                    continue
                x = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if (100 + percent) * x >= percent * (sizes[i] + sizes[k]):
                    out.append((int(nodes[i]), int(nodes[k])))
                    group[group == group[k]] = group[i]
    return out


def candidates_across(here: list[tuple[int, int, Signature]], rest: list[tuple[int, int, Signature]], percent: int) -> list[tuple[int, int]]:
    """Edges between (node, root, signature) of both sides that may link, one for each pair of components that they join."""
    forest, out = Forest(), []
    here = sorted(here, key=lambda x: x[2].size)
    sizes = [x[2].size for x in here]
    for node, root, sig in rest:
        low, high = bisect_left(sizes, -(-percent * sig.size // 100)), bisect_right(sizes, 100 * sig.size // percent)
        for other, its, x in here[low:high]:
            a, b = forest.find(root), forest.find(its)
            if a != b and sig.may_link(x, percent):
                out.append((node, other))
                forest.parent[max(a, b)] = min(a, b)
    return out


def _bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """A bitmap of the values in bit (from 0 to below size), gathered as at most size / 64 rows."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(size // 64, np.int64)
    got = words.toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def _rows(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)


def heat_table(texts: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """The level of each slot, two in a byte, from a sample of the texts, and in how many texts of it level 1 begins.

    Gathered as at most HEAT_SLOTS / 16 rows. On a large corpus level 1 begins
    higher, so that the frequent shingles fill only a small part of the slots.
    """

    def emit(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for b in slices(batches):
            found = []
            for t in as_bytes(b.column(0)):
                s = shingle_set(t, k)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                found.append(s.view(np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["shingle"])

    sample = texts.where(F.pmod("text_hash", F.lit(HEAT_SAMPLE)) == 0).select("text")
    counted = written(sample.mapInArrow(emit, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= HEAT_LEAST), "frequent")
    doubled = counted.groupBy(F.floor(F.log(2.0, F.col("n") / HEAT_LEAST)).cast("int").alias("d")).agg(F.count("*").alias("shingles")).collect()  # at most 64 rows
    at, total = 0, sum(r["shingles"] for r in doubled)
    while total > HEAT_SLOTS // 8:
        total -= sum(r["shingles"] for r in doubled if r["d"] == at)
        at += 1
    least = HEAT_LEAST << at
    level = F.least(F.lit(15), 1 + F.floor(F.log(4.0, F.col("n") / least))).cast("long")
    slots = counted.where(F.col("n") >= least).groupBy(F.col("shingle").bitwiseAND(F.lit(HEAT_SLOTS - 1)).alias("slot")).agg(F.max(level).alias("level"))
    put = F.expr("shiftleft(level, cast(4 * (slot & 15) as int))")
    got = slots.groupBy(F.shiftright("slot", 4).alias("word")).agg(F.bit_or(put).alias("levels")).toPandas()
    out = np.zeros(HEAT_SLOTS // 16, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["levels"].to_numpy(np.int64)
    return out.view(np.uint8), least


def measured(source: DataFrame, k: int, percent: int, heat) -> DataFrame:
    """For each text its set's size, node and signature, and the node's (key, block).

    Signature and keys are given once in a task for equal sets, so that copies cost nothing further on.
    """
    met = T.ArrayType(T.StructType([T.StructField("key", T.LongType(), False), T.StructField("block", T.IntegerType(), False)]))
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("met", met)]

    def make():
        import pyarrow as pa

        seen: set[int] = set()

        def score(texts):
            sizes, nodes, signatures, keys, blocks, ends = [], [], [], [], [], [0]
            for t in texts:
                s = shingle_set(t, k)
                node = node_of(s) if len(s) else None
                sizes.append(len(s))
                nodes.append(node)
                new = node is not None and node not in seen
                signatures.append(signature(s) if new else None)
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    table, least = heat.value
                    key, block = deal_keys(node, *keys_of(s, percent, table), least)
                    keys.append(key.view(np.int64))
                    blocks.append(block)
                ends.append(ends[-1] + (len(keys[-1]) if new else 0))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(keys or [np.empty(0, np.int64)])), pa.array(np.concatenate(blocks or [np.empty(0, np.int32)]))], names=["key", "block"])
            return [sizes, nodes, signatures, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        return score

    return map_texts(source, fields, make, keep=("id", "text_hash"))


def shared(percent: int):
    def run(batches):
        """Rows (key, block, size, node) come in order: those that have a neighbour of their key and block, and all of split keys, with the first node.

        Where the next size is too large for a link the group ends and another
        begins, so texts of other sizes that share a key go no further.
        """
        import pyarrow as pa

        key, block, size, node = (np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64))
        before, first = False, 0

        def out(f, k, b, n):
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(k), pa.array(b), pa.array(n)], names=MET.names)

        for got in batches:
            key, block, size, node = (np.concatenate((x, got.column(i).to_numpy())) for i, x in enumerate((key, block, size, node)))
            if len(key) < 2:
                continue
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (node[1:] != node[:-1])))
            key, block, size, node = key[new], block[new], size[new], node[new]
            near = (key[1:] == key[:-1]) & (block[1:] == block[:-1]) & (100 * size[:-1] >= percent * size[1:])
            same = np.concatenate(([before], near))
            head = np.maximum.accumulate(np.where(same, -1, np.arange(len(key))))
            firsts = np.where(head >= 0, node[np.maximum(head, 0)], first)
            on = same[:-1] | same[1:] | (block[:-1] > 0)
            if on.any():
                yield out(firsts[:-1][on], key[:-1][on], block[:-1][on], node[:-1][on])
            # what follows decides about the last
            key, block, size, node, before, first = key[-1:], block[-1:], size[-1:], node[-1:], bool(same[-1]), firsts[-1]
        if len(key) and (before or block[0] > 0):
            yield out(np.array([first if before else node[0]], np.int64), key, block, node)

    return run


def distinct_groups(batches):
    """Rows come in order of (first, block, key, node): (first, block, node, keys), of keys with the same nodes only one.

    A near copy shares most of its keys with the same documents, so most keys
    fall away here, and a node's signature then goes along once for each first
    node instead of once for each key. What a first node has gathered goes on
    in pieces if it is much.
    """
    seen: set[int] = set()
    now, group = None, []
    keys_by_node: dict[int, list[int]] = {}
    held = 0
    out: list[tuple] = []

    def close_key():
        nonlocal held
        h = hash(tuple(group))
        if h not in seen:
            seen.add(h)
            held += len(group)
            for x in group:
                keys_by_node.setdefault(x, []).append(now[2])

    def close_first():
        nonlocal held
        out.extend((*now[:2], node, keys) for node, keys in keys_by_node.items())
        keys_by_node.clear()
        held = 0

    for b in batches:
        for first, key, block, node in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (first, block, key) != now:
                if now is not None:
                    close_key()
                    if (first, block) != now[:2] or held >= HELD:
                        close_first()
                    if (first, block) != now[:2]:
                        seen.clear()
                now, group = (first, block, key), []
            group.append(node)
            if len(out) >= 10_000:
                yield _rows(out, GROUPS)
                out.clear()
    if now is not None:
        close_key()
        close_first()
    if out:
        yield _rows(out, GROUPS)


def candidates_in_block(percent: int):
    def run(batches):
        """Rows (first, block, node, keys, size, signature) come in order of first and block: edges between nodes that share a key and may link."""
        forest, now = Forest(), None
        groups: dict[int, list[tuple[int, Signature]]] = {}

        def close():
            rows = [e for g in groups.values() if len(g) > 1 for e in forest.candidates(g, percent)]
            groups.clear()
            return rows

        for b in slices(batches, 8192):
            rows: list[tuple[int, int]] = []
            for first, block, node, keys, size, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (first, block) != now:
                    rows += close()
                    now = (first, block)
                sig = Signature(size, data)
                for key in keys:
                    groups.setdefault(key, []).append((node, sig))
            if rows:
                yield _rows(rows, EDGES)
        if rows := close():
            yield _rows(rows, EDGES)

    return run


def by_task(n_group: int, step):
    """Runs step(rows) for each group of rows that agree in the first n_group columns; rows come in their order."""

    def run(batches):
        now, held = None, []
        for b in slices(batches, 8192):
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if row[:n_group] != now:
                    out += step(held)
                    now, held = row[:n_group], []
                held.append(row[n_group:])
            if out:
                yield _rows(out, EDGES)
        if out := step(held):
            yield _rows(out, EDGES)

    return run


def block_size(n: Column, weight: Column, most: int) -> Column:
    """Nodes of a block: a 64th of the group within BLOCK_LEAST and BLOCK_MOST, but no more than most shingles have place for."""
    return F.greatest(F.lit(1.0), F.least(F.greatest(n / 64, F.lit(float(BLOCK_LEAST))), F.lit(float(BLOCK_MOST)), F.lit(float(most)) * n / weight))


def second_round(members: DataFrame, by: list[str], most: int) -> DataFrame | None:
    """Pairs of a group that the first round left in different components, dealt to (by, i, j) with a side.

    members: by, node, root, size, each node of a group once. Of the two sides of
    a task, side 1 holds a chunk of the nodes outside the group's largest
    component, and side 0 a block of all its nodes. None if no pair is open.
    """
    counts = members.groupBy(*by, "root").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("n", "root")).alias("main")).where("n > main.n")
    size = block_size(F.col("n"), F.col("weight"), most)
    left = written(groups.select(*by, F.col("main.root").alias("main"), F.ceil(F.col("n") / size).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("main.n")) / size).cast("int").alias("chunks")), "open")
    if left.isEmpty():
        return None
    met = members.join(left, by)
    block, chunk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    here = met.withColumn("i", block).withColumn("j", every("chunks")).withColumn("side", F.lit(0))
    rest = met.where("root <> main").withColumn("j", chunk).withColumn("i", every("blocks")).withColumn("side", F.lit(1))
    return here.unionByName(rest).select(*by, "i", "j", "side", "node", "root")


def grown(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of both together."""
    if edges.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges))


def candidate_components(sized: DataFrame, nodes: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """(node, root) of the nodes that candidate pairs join."""
    met = sized.where("size(met) > 0").select("node", F.col("n_shingles").alias("size"), F.explode("met").alias("m"))
    met = met.select(F.col("m.key").alias("key"), F.col("m.block").alias("block"), "size", "node")
    met = written(met.repartition(n_parts, "key", "block").sortWithinPartitions("key", "block", "size", "node").mapInArrow(shared(percent), MET), "keys")
    signatures = nodes.select("node", "size", "signature")
    groups = met.repartition(n_parts, "first", "block").sortWithinPartitions("first", "block", "key", "node").mapInArrow(distinct_groups, GROUPS)
    groups = groups.join(signatures, "node").select("first", "block", "node", "keys", "size", "signature")
    edges = groups.repartition(n_parts, "first", "block").sortWithinPartitions("first", "block", "node").mapInArrow(candidates_in_block(percent), EDGES)
    tiles = connected_components(edges)
    split = met.where("block > 0").select("key", "node")
    if split.isEmpty():
        return tiles
    members = split.distinct().join(tiles, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.lit(1).alias("size"))
    again = second_round(members, ["key"], BLOCK_MOST)
    if again is None:
        return tiles

    def across(rows):
        sides = ([], [])
        for side, node, root, size, data in rows:
            sides[side].append((node, root, Signature(size, data)))
        return candidates_across(*sides, percent)

    again = again.join(signatures, "node").select("key", "i", "j", "side", "node", "root", "size", "signature")
    again = again.repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    return grown(tiles, written(again.mapInArrow(by_task(3, across), EDGES), "edges"))


def with_sets(placed: DataFrame, source: DataFrame, k: int) -> DataFrame:
    """placed with the set of each row's text, from one scan that a fixed-size bitmap of text hashes thins out."""
    bit = F.pmod("text_hash", F.lit(PICK_BITS)).alias("bit")
    chosen = placed.sparkSession.sparkContext.broadcast(_bitmap(placed.select(bit), PICK_BITS))

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for b in slices(batches, 8192):
            at = b.column(1).to_numpy()
            on = (chosen.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            for i, h in enumerate(b.column(0).to_pylist()):
                if on[i]:
                    on[i] = h not in seen
                    seen.add(h)
            if len(seen) >= SEEN:
                seen.clear()
            for part in slices([b.filter(pa.array(on))], 512):
                sets = [shingle_set(t, k) for t in as_bytes(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["text_hash", "shingles"])

    sets = source.select("text_hash", bit, "text").mapInArrow(run, "text_hash long, shingles binary")
    # copies of a text come from several tasks
    return placed.join(sets.groupBy("text_hash").agg(F.min("shingles").alias("shingles")), "text_hash")


def exact_components(members: DataFrame, source: DataFrame, k: int, percent: int, tile_shingles: int, n_parts: int) -> DataFrame:
    """(node, root) of the linked nodes. members: node, tile, band, size, text_hash."""
    by = ["tile", "band"]
    weights = members.groupBy(*by).agg(F.sum("size").alias("weight"), F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block_size(F.col("n"), F.col("weight"), tile_shingles)).cast("int")
    placed = members.join(written(weights.select(*by, "n", blocks.alias("blocks")), "tiles"), by)
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)) < F.lit(PIVOTS * (1 << 30)) / F.col("n"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    placed = placed.select(*by, "i", F.lit(-1).alias("j"), F.lit(0).alias("side"), "node", F.col("node").alias("root"), "text_hash", "blocks")

    def links(rows):
        # texts of equal hash may be other texts: the set must be the node's
        got = [(side, node, root, s) for side, node, root, data in rows if node_of(s := np.frombuffer(data, np.uint64)) == node]
        if len(got) < 2:
            return []
        side, node, root = (np.array([g[i] for g in got], np.int64) for i in range(3))
        return links_in_tile(node, [g[3] for g in got], percent, side if side.any() else None, root)

    def linked(dealt):
        got = with_sets(dealt, source, k).select(*by, "i", "j", "side", "node", "root", "shingles")
        return got.repartition(n_parts, *by, "i", "j").sortWithinPartitions(*by, "i", "j", "side", "node").mapInArrow(by_task(4, links), EDGES)

    placed = written(placed, "placed")
    roots = connected_components(linked(placed.drop("blocks")))
    split = placed.where("blocks > 1").select(*by, "node").distinct()
    if split.isEmpty():
        return roots
    whole = split.join(members, [*by, "node"]).join(roots, "node", "left").select(*by, "node", F.coalesce("root", "node").alias("root"), "size", "text_hash")
    again = second_round(whole, by, tile_shingles)
    if again is None:
        return roots
    again = written(again.join(members.select("node", "text_hash").distinct(), "node"), "placed")
    return grown(roots, written(linked(again), "links"))


def classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, tile_shingles: int) -> DataFrame:
    """id, text_hash, n_shingles, node and least for each row of docs.

    least (no_id, id, text_hash) names the first row of the component: the
    smallest id, rows without id last. Without words node and least are null.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    spark = docs.sparkSession
    shared_dir(spark)
    n_parts = partitions_of(spark)
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    heat = spark.sparkContext.broadcast(heat_table(source.select("text", "text_hash"), k))
    sized = written(measured(source, k, percent, heat), "sets")

    named = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    nodes = sized.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows"), F.min("n_shingles").alias("size"), F.min("signature").alias("signature"), F.min(named).alias("least"))
    nodes = written(nodes, "nodes")
    tiles = candidate_components(sized, nodes, percent, n_parts)

    members = tiles.join(nodes, "node").select("node", F.col("root").alias("tile"), F.col("least.text_hash").alias("text_hash"), "size")
    edges = F.array(*[F.lit(e) for e in band_edges(percent)])
    members = members.withColumn("band", F.size(F.filter(edges, lambda e: e <= F.col("size"))) - 1)
    # the next band too, if a partner can be there
    reach = F.lit(100) * F.col("size") >= F.lit(percent) * F.element_at(edges, F.col("band") + 2)
    members = members.withColumn("bands", F.when(reach, F.array("band", F.col("band") + 1)).otherwise(F.array("band")))
    members = written(members.select("node", "tile", "text_hash", "size", F.explode("bands").alias("band")), "members")
    linked = exact_components(members, source, k, percent, tile_shingles, n_parts)

    # only sets with several rows or links need a name other than their own
    joined = nodes.where("rows > 1").select("node").join(linked, "node", "full")
    joined = joined.join(nodes.select("node", F.col("least").alias("own")), "node").select("node", F.coalesce("root", "node").alias("root"), "own")
    names = joined.groupBy("root").agg(F.min("own").alias("least"))
    names = written(joined.join(written(names, "names"), "root").select("node", "least"), "names")
    worded = sized.where("node IS NOT NULL").drop("signature", "met").join(names, "node", "left")
    worded = worded.withColumn("least", F.coalesce("least", named))
    wordless = sized.where("node IS NULL").drop("signature", "met").withColumn("least", F.lit(None).cast(worded.schema["least"].dataType))
    return worded.unionByName(wordless)


def jaccard_components(docs: DataFrame, *, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", tile_shingles: int = 3_000_000) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach) for each document."""
    found = classes(docs, k, percent, id_col, text_col, tile_shingles)
    return found.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"))


def near_duplicate_filter(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id (rows without id come last).

    Texts of an id that stand in different components are documents of their
    own. Repeated rows of an id and text are one document: the row stays whose
    columns are the smallest as JSON. Rows without id and words, which nothing
    tells apart, all stay.
    """
    found = written(classes(docs, k, percent, id_col, text_col, 3_000_000), "classes")
    first = F.col("node").isNull() | (F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.text_hash") == F.col("text_hash")))
    gone = found.where(~first).select("id", "text_hash", F.lit(0).alias("mark")).distinct()
    one_of = found.where(first & (F.col("id").isNotNull() | F.col("node").isNotNull())).groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    marks = written(gone.unionByName(one_of.select("id", "text_hash", F.lit(1).alias("mark"))), "marks")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("row_id"), F.xxhash64(text).alias("row_hash"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash"))
    kept = rows.join(marks, same, "left_anti").select("row")
    repeated = marks.where("mark = 1")
    if not repeated.isEmpty():
        others = F.to_json(F.struct(F.lit(0).alias("none"), *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]))
        again = rows.join(repeated, same).groupBy("row_id", "row_hash").agg(F.min_by("row", others).alias("row"))
        kept = kept.unionByName(again.select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
