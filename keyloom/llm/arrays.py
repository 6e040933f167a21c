"""Words of many texts at once as arrays: byte classes, word hashes and a hash index.

Texts of a batch are joined with NUL between them and looked at as one array of
UTF-8 bytes.  A word's hash is a polynomial over its bytes modulo 2**64, taken
from prefix sums, so hashes of any stretch of words cost a subtraction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

OTHER, LETTER, DIGIT, BLANK, END = 0, 1, 2, 3, 4
#: Bytes of text that are looked at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Odd multipliers of the hashes.
BASE, STEP2, STEP3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
WIDE_BLANK = re.compile(r"[^\S\x00-\x7f]")
WIDE_OTHER = re.compile(r"[^\w\x00-\x7f]")


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = LETTER if b >= 128 or c.isalpha() else DIGIT if c.isdigit() else BLANK if c.isspace() else OTHER
    out[0] = END
    return out


CLASSES = _classes()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

def _powers(base: int) -> np.ndarray:
    """base**i modulo 2**64 for i below BLOCK_BYTES."""
    out = np.full(BLOCK_BYTES, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


INVERSE = pow(BASE, -1, 1 << 64)
_tables: list[np.ndarray] = []


def plain(text: str) -> str:
    """The text without NUL, and with no character beyond ASCII that is neither of a word nor a blank."""
    if not text.isascii():
        text = WIDE_OTHER.sub("\x02", WIDE_BLANK.sub(" ", text))
    return text.replace("\x00", "\x02")


def blocks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of the texts that hold about BLOCK_BYTES characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of some texts, in order: ``start`` and ``end`` count the bytes of words alone, ``at`` is the place in the joined text."""

    def __init__(self, texts: Sequence[str], digits_apart: bool) -> None:
        """``texts`` have been through :func:`plain`.  With ``digits_apart`` letters and digits are different words."""
        self.bytes = LOWER[np.frombuffer("\x00".join(texts).encode() + b"\x00", np.uint8)]
        self.kind = kind = CLASSES[self.bytes]
        word = (kind == LETTER) | (kind == DIGIT)
        first = word.copy()
        first[1:] &= ~word[:-1] if not digits_apart else (kind[1:] != kind[:-1])
        last = word.copy()
        last[:-1] &= ~word[1:] if not digits_apart else (kind[1:] != kind[:-1])
        self.at = np.flatnonzero(first)
        self.stop = np.flatnonzero(last) + 1
        if not _tables:
            _tables[:] = [_powers(BASE), _powers(INVERSE)]
        seen = self.bytes[word]
        self.sums = np.zeros(len(seen) + 1, np.uint64)
        for lo in range(0, len(seen), BLOCK_BYTES):
            part = seen[lo : lo + BLOCK_BYTES].astype(np.uint64)
            part += np.uint64(1)
            part *= _tables[0][: len(part)]
            part *= np.uint64(pow(BASE, lo, 1 << 64))
            to = self.sums[lo + 1 : lo + 1 + len(part)]
            np.cumsum(part, out=to)
            to += self.sums[lo]
        #: INVERSE to the power of the first byte of each block.
        self.far = np.array([pow(INVERSE, lo, 1 << 64) for lo in range(0, len(seen) + 1, BLOCK_BYTES)], np.uint64)
        lengths = self.stop - self.at
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        #: The text each word is of.
        self.text = np.searchsorted(np.flatnonzero(kind == END), self.at)
        self.texts = len(texts)

    def _stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _tables[1][start % BLOCK_BYTES] * self.far[start // BLOCK_BYTES]

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from word ``first`` to word ``last``, their words run together."""
        return self._stretch(self.start[first], self.end[last])

    def word_hashes(self) -> np.ndarray:
        return self._stretch(self.start, self.end)


def word_hash(word: str) -> int:
    """The hash of one word, as :class:`Words` gives it."""
    out, power = 0, 1
    for b in word.encode():
        out += (int(LOWER[b]) + 1) * power
        power *= BASE
    return out & (1 << 64) - 1


def joined2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from the words' hashes."""
    x = (a * np.uint64(STEP2)) ^ (b >> np.uint64(7)) ^ (b * np.uint64(STEP3))
    return x ^ (x >> np.uint64(29))


class HashIndex:
    """Positions of 64-bit keys, found for whole arrays at once (open addressing)."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys`` are distinct."""
        self.keys = keys.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        slot, left = self._slot(self.keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several keys for one slot the last stays
            missed = self.table[slot] != left
            left, slot = left[missed], (slot[missed] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(STEP2)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        slot, todo = self._slot(keys), None
        for _ in range(self.probes):
            found = self.table[slot]
            some = found >= 0
            hit = some & (self.keys[found] == keys)
            if todo is None:
                out[hit] = found[hit]
                todo = np.flatnonzero(some & ~hit)
            else:
                out[todo[hit]] = found[hit]
                todo = todo[some & ~hit]
            if not len(todo):
                break
            keep = some & ~hit
            keys, slot = keys[keep], (slot[keep] + 1) & ((1 << self.bits) - 1)
        return out
