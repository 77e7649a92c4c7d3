"""Token counts with a whole-token shortcut.

Offline (once, on the driver) the vocabulary is read: a string of it whose
encoding is that one token is *whole*. The whole strings, at most as many as the
vocabulary has, are broadcast. A text is cut into pre-tokens as the tokenizer
cuts it; a whole pre-token counts 1 by a dictionary lookup, and only the rest is
merged, by the tokenizer itself, each distinct pre-token once.

Texts with characters that Unicode has assigned at different times for the two
regular-expression libraries are given to the tokenizer as a whole.

Defined results: a null text is an empty one and has 0 tokens; repeated rows
each give a row, ties don't arise; without documents there are no rows. A very
long text is counted whole, in memory of a few times its size. Kept columns give
way to a computed one of the same name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, types as T

from .batches import map_texts

FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
]
#: How the byte-level tokenizer cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on whose class the two libraries agree (a test compares them all).
AGREED = r"\x00-ͷЀ-ԯؠ-ە -⁯₠-₿　-〩ぁ-ゖ゠-ヾ一-龥가-힣\U0001f300-\U0001f5ff\U0001f600-\U0001f64f"
#: Marks that are a pre-token of their own behind a word.
MARKS = frozenset(".,;:!?")
#: Units a worker remembers; then it starts anew. Longer ones than LONG characters are rare and aren't remembered, so bytes are bounded too.
REMEMBERED, LONG = 500_000, 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves, the others for the
    letters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Irregular(Exception):
    """White space that a text's units don't show."""


class Counter(dict):
    """Unit to its number of tokens.

    A unit is what stands between single spaces (it counts with the space before
    it), or a line's first word with the line feed before it. Pre-tokens never
    go across such a border, so a text's tokens are the sum over its units; a
    text with other white space is cut by the regular expression instead.
    """

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        """whole: what prove() gave for this tokenizer before; without it the proof is made here."""
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = sorted((t["content"] for t in said.get("added_tokens", [])), key=len, reverse=True)
        pre = said.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and not any(t[k] for t in said.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
        self.find = regex.compile(PRE_TOKEN).findall
        self.odd = regex.compile(f"[^{AGREED}]").search
        self.other_space = regex.compile(r"[^\S \n]|[\x1c-\x1f]").search
        self.letters = byte_letters()
        #: pre-tokens that are proved to be one token
        self.whole: frozenset[str] = frozenset() if not self.plain else frozenset(self.prove(said["model"]["vocab"])) if whole is None else whole
        self.feed = self.tokens_of("\n") if self.plain else 0
        self.start()

    def prove(self, vocabulary: dict[str, int]) -> list[str]:
        """Strings of the vocabulary that are one pre-token and encode alone as that one token."""
        byte_of = {c: b for b, c in self.letters.items()}
        texts = []
        for token in vocabulary:
            try:
                text = bytes(byte_of[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # a special token, or part of a character
            if text not in self.special and self.find(text) == [text] and not self.odd(text):
                texts.append(text)
        got = self.library.encode_batch(texts, add_special_tokens=False)
        return [t for t, e in zip(texts, got, strict=True) if len(e.ids) == 1]

    def start(self) -> None:
        """Forgets all units but those that are whole tokens with a space before them."""
        self.clear()
        self.update((t[1:], 1) for t in self.whole if t[0] == " " and len(t) > 1)

    def tokens_of(self, piece: str) -> int:
        """Tokens of a pre-token: one if it is whole, else what the model merges."""
        return 1 if piece in self.whole else len(self.model.tokenize(letters_of(piece, self.letters)))

    def __missing__(self, unit: str) -> int:
        if not unit or unit == "\n":
            raise Irregular
        if len(self) > REMEMBERED:
            self.start()
        # most units are a word, or a word and a mark: these are cut without the regular expression
        if unit.isalpha():
            n = self.tokens_of(" " + unit)
        elif unit[-1] in MARKS and unit[:-1].isalpha():
            n = self[unit[:-1]] + self.tokens_of(unit[-1])
        else:
            n = sum(map(self.tokens_of, self.find(unit if unit[0] == "\n" else " " + unit)))
        if len(unit) <= LONG:
            self[unit] = n
        return n

    def ordinary(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        if not self.other_space(text):
            try:
                # with a line feed before it, the first word is a unit like the others
                return sum(map(self.__getitem__, f"\n{text}".replace("\n", " \n")[1:].split(" "))) - self.feed
            except Irregular:
                pass
        return sum(map(self.tokens_of, self.find(text)))

    def count(self, text: str) -> int:
        """Tokens of a text, special strings in it handled as the library does by default."""
        if not self.plain or self.odd(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts, specials = [text], 0
        for s in self.special:
            if s in text:
                cut = [p.split(s) for p in parts]
                specials += sum(len(x) - 1 for x in cut)
                parts = [y for x in cut for y in x]
        return specials + sum(map(self.ordinary, parts))


def letters_of(piece: str, letters: dict[int, str]) -> str:
    """A pre-token as the byte-level vocabulary spells it."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", letters[0x20])
    return "".join(map(letters.__getitem__, piece.encode()))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    """The counter of this process for a tokenizer; it keeps what it remembers from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than limit tokens) for each document.

    tokenizer is a path that the driver and every executor can open.
    """
    proved = docs.sparkSession.sparkContext.broadcast(counter(tokenizer).whole)

    def make():
        c = counter(tokenizer, proved.value)

        def score(texts):
            n = [c.count(t.decode()) if t else 0 for t in texts]
            return [[len(t) if t else 0 for t in texts], n, [x > limit for x in n]]

        return score

    return map_texts(docs, FIELDS, make, text_col, keep)
