"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each text. The ledger keeps what was measured
and one bit for each rule that failed; policies are then bit masks with a
version, applied (and re-applied) without reading a text again, and an ablation
is a bitwise aggregation over the few distinct masks.

Words are `[^\\x20\\x09-\\x0D]+`. Defined results: a null or empty text has no
words, so only the rules that ask for a least size fail; ratios of nothing are 0;
a very long text is measured whole, in memory of a few times its size; repeated
rows each give a row; without documents the ledger, the filter and the ablations
have no rows. Kept columns of the ledger give way to a computed one of the same
name; the filter keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import map_texts
from .words import mix, space_word_hashes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_chars_all", "n_alpha_words", "longest_word"]
_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>")
_CONTINUES = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    """A bit and the condition, over MEASURES, under which a document fails."""

    bit: int
    name: str
    fails: str


#: Every rule is integer arithmetic, so that engines agree on the borders.
RULES = [
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "too_many_words", "n_words > 100000"),
    Rule(3, "mean_word_too_long", "word_chars > 12 * n_words"),
    Rule(4, "mean_word_too_short", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > n_words"),
    Rule(6, "repeated_lines", "n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(7, "few_alphabetic_words", "10 * n_alpha_words < 7 * n_words"),
    Rule(8, "huge_word", "longest_word > 1000"),
]


@dataclass(frozen=True)
class Policy:
    """Which bits of the ledger reject a document."""

    version: str
    mask: int

    def accepts(self, bits: Column) -> Column:
        return bits.bitwiseAND(F.lit(self.mask)) == 0


def mask_of(*names: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


#: The first version has the base rules alone; later ones add to it. Rules on the length of words and texts are
#: measured but not in force: clean texts in scripts without spaces, and long clean texts, would fail them. v3 takes
#: few_alphabetic_words out of v2: short clean texts with numbers fail it, and junk tables fail symbols without it.
POLICIES = {
    "v1": Policy("v1", mask_of("too_few_words", "repeated_windows")),
    "v2": Policy("v2", mask_of("too_few_words", "repeated_windows", "symbols", "few_alphabetic_words")),
    "v3": Policy("v3", mask_of("too_few_words", "repeated_windows", "symbols")),
    "strict": Policy("strict", sum(1 << r.bit for r in RULES)),
}
CURRENT = "v3"


def repeat_words(hashes: np.ndarray, text: bytes, window: int = 5) -> int:
    """Words inside windows that are found twice or more in the text, the first included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n])
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0  # equal windows have equal hashes, so there is none
    at = np.flatnonzero(np.isin(h, twice))
    words = text.split()
    held = Counter(tuple(words[i : i + window]) for i in at.tolist())
    cover = np.zeros(len(hashes) + 1, np.int64)
    for i in at.tolist():
        if held[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of a text."""
    text = text or b""
    words = text.split()
    packed = b"".join(words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (
        len(words),
        len(packed.translate(None, _CONTINUES)),
        len(text.translate(None, _SYMBOLS)),
        dup,
        lines,
        repeat_words(space_word_hashes(text), text) if len(words) > 5 else 0,
        len(text.translate(None, _CONTINUES)),
        sum(map(_has_letter, words)),
        max(map(len, words), default=0),
    )


_NO_LETTER = bytes(c for c in range(0x80) if not (0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))


def _has_letter(word: bytes) -> bool:
    return bool(word.translate(None, _NO_LETTER))


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: list[Rule] | None = None) -> DataFrame:
    """keep, MEASURES and failed_bits (long) for each document, in one pass over the texts."""
    measured = map_texts(docs, [T.StructField(m, T.LongType()) for m in MEASURES], _measurer, text_col, keep)
    bits = F.lit(0).cast("long")
    for r in rules or RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def _measurer():
    return lambda texts: [list(c) for c in zip(*map(measure, texts), strict=True)] if texts else [[] for _ in MEASURES]


def apply_policy(frame: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy_version and kept."""
    return frame.withColumn("policy_version", F.lit(policy.version)).withColumn("kept", policy.accepts(F.col("failed_bits")))


def ablations(frame: DataFrame, policy: Policy, rules: list[Rule] | None = None) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy without it keeps.

    One aggregation to the distinct masks (at most 2 to the number of rules), whatever the number of documents.
    """
    masks = frame.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    listed = [(r.name, 1 << r.bit) for r in rules or RULES if policy.mask >> r.bit & 1]
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in listed])).alias("r")
    each = masks.select("bits", "n", rule)
    hit, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def quality_filter(docs: DataFrame, policy: Policy | None = None, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that a policy accepts."""
    columns = [c for c in docs.columns]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)], F.col(f"`{text_col}`").alias("__t"))
    kept = apply_policy(ledger(renamed, "__t", tuple(f"__c{i}" for i in range(len(columns)))), policy or POLICIES[CURRENT]).where("kept")
    return kept.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])
