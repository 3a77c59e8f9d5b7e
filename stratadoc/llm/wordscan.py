"""Texts of an Arrow batch as NumPy arrays: code points, words, word hashes and word-run hashes.

Everything works on whole texts; a batch is taken apart into slices of bounded size so that memory
stays level whatever the batch holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> U64(32))) * MIX_B
    x = (x ^ (x >> U64(29))) * MIX_A
    return x ^ (x >> U64(32))


@lru_cache(maxsize=None)
def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@lru_cache(maxsize=None)
def _letters_digits() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x32000):
        kind = unicodedata.category(chr(c))
        table[c] = kind[0] == "L" or kind == "Nd"
    return table


@lru_cache(maxsize=None)
def _ascii_words() -> np.ndarray:
    """Characters that are a-z or 0-9 once lower-cased."""
    low = _lower()
    return ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))


KINDS = {"letters_digits": _letters_digits, "ascii": _ascii_words}


@lru_cache(maxsize=None)
def _powers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * MIX_A) | U64(1)


class Words:
    """Words of some texts.

    ``hash`` is a 64-bit value of the lower-cased word, ``doc`` the number of its text, ``start`` and
    ``end`` its place in ``chars``, the joined code points. A null text has no words.
    """

    def __init__(self, texts: list[str | None], kind: str):
        joined = "\n".join(t or "" for t in texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = KINDS[kind]()[chars]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.chars, length = chars, self.end - self.start
        if len(self.start):
            first = np.cumsum(length) - length
            place = np.arange(length.sum()) - np.repeat(first, length)
            low = _lower()[chars[inside]].astype(U64) + U64(1)
            width = 1 << int(place.max() + 1).bit_length()
            self.hash = mix(np.add.reduceat(low * _powers(width)[place], first))
        else:
            self.hash = np.zeros(0, dtype=U64)
        sizes = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1

    def word(self, i: int) -> str:
        """The lower-cased word number ``i``."""
        return "".join(map(chr, _lower()[self.chars[self.start[i] : self.end[i]]]))


def runs(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within one text, and the number of that text."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=doc.dtype)
    out, last = np.zeros(len(hashes) - n + 1, dtype=U64), len(hashes) - n + 1
    for k in range(n):
        out = out * MIX_A + hashes[k : k + last]
    whole = doc[:last] == doc[n - 1 :]
    return mix(out[whole]), doc[:last][whole]


def slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of at most ``most`` characters (a longer text is alone)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def _in_word(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


def pieces(text: str, words: int, most: int = 1 << 22) -> Iterator[str]:
    """A very long text in overlapping pieces: each run of ``words`` words lies whole in one of them."""
    begin = 0
    while begin + most < len(text):
        end = begin + most
        while end < len(text) and _in_word(text[end]) and _in_word(text[end - 1]):
            end += 1
        back, left = end, words
        while back > begin and left:
            while back > begin and not _in_word(text[back - 1]):
                back -= 1
            while back > begin and _in_word(text[back - 1]):
                back -= 1
            left -= 1
        if back <= begin:  # too few words for an overlap
            most *= 2
            continue
        yield text[begin:end]
        begin = back
    yield text[begin:]
