"""Vectorised scanning of Arrow string columns.

Texts are taken as one run of UTF-8 bytes, so finding words, hashing them and hashing
their n-grams are a fixed number of numpy passes over a batch, never a Python step per
word. Separators are ASCII, so byte classes decide word limits exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Base of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text scanned at a time; a single longer text is scanned alone, whole.
SLICE_BYTES = 1 << 20

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """Which of the 256 bytes belong to words, given inclusive ranges that do not."""
    table = np.ones(256, bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Bytes that are not space or a control white space character.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of ASCII letters and digits, and all of non-ASCII characters.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Bytes of ASCII letters, and all of non-ASCII characters.
ALPHA = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about limit bytes: first, last, bytes, offsets."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Scan:
    """Words of a run of texts: start and end bytes, 64-bit hashes and the text each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = _LOWER[data], offsets
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # word index at which each text begins
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._sum: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal bytes have equal hashes wherever they stand."""
        if self._sum is None:
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.data)), out=total[1:])
            self._sum = total
        spans = (self._sum[end] - self._sum[start]) * powers(INVERSE, len(self.data) + 1)[start]
        return mix(spans + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of size words and the text of each.

        A text with fewer words than size has one: its whole sequence. One without words has none.
        """
        words, counts = self.hashes(), self.counts
        here = np.arange(len(words))
        left = self.first[1:][self.text] - here  # words from here to the end of the text
        whole = (left >= size) | (here == self.first[:-1][self.text])
        at = here[whole]
        grams = np.zeros(len(at), np.uint64)
        step = np.uint64(0xD1342543DE82EF95)
        for k in range(size):
            ok = left[at] > k
            nxt = words[np.minimum(at + k, len(words) - 1)] if len(words) else words
            grams = np.where(ok, mix(grams * step + nxt + np.uint64(k + 1)), grams)
        del counts
        return grams, self.text[at]


def word_hash(word: str) -> int:
    """The hash that Scan gives one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    scan = Scan(data, np.array([0, len(data)]), np.ones(256, bool))
    return int(scan.hash_spans(np.array([0]), np.array([len(data)]))[0])
