"""Words of a text, as bytes.

Both word definitions are byte classes of UTF-8, since every byte of a
non-ASCII character is 0x80 or more and belongs to a word in either:

* letters-and-digits words: [0-9a-z] and non-ASCII after lower-casing A-Z;
* space words: anything between the six ASCII white-space characters.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(256)).lower()
#: Lower-cases A-Z, keeps digits, a-z and 0x80 up, and makes everything else a space.
ALNUM_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in _LOWER)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; a longer text is cut at white space.
PIECE = 1 << 20


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; null has none."""
    return text.translate(ALNUM_TABLE).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return text.split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = None, None


def _hash_piece(buf: np.ndarray) -> np.ndarray:
    global _UP, _DOWN
    n = len(buf)
    if _UP is None or len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    word = ~_IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[buf] * _UP[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def space_word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each space word, in order, without making word objects."""
    if not text:
        return np.empty(0, np.uint64)
    if len(text) <= PIECE:
        return _hash_piece(np.frombuffer(text, np.uint8))
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = next((i for i in range(end, at, -1) if text[i - 1] in b" \t\n\r\x0b\x0c"), 0)
            if not cut:  # one word longer than a piece: take it whole
                cut = end
                while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
                    cut += 1
            end = cut
        out.append(_hash_piece(np.frombuffer(text[at:end], np.uint8)))
        at = end
    return np.concatenate(out)


def shingle_set(text: bytes | None, k: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles.

    With fewer than k words the whole sequence is one shingle; without words
    the set is empty.
    """
    if not text:
        return np.empty(0, np.uint64)
    w = space_word_hashes(text.lower() if lower else text)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(w))):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i : i + n])
    return np.unique(h)
