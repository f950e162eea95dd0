"""Vectorised hashing of the words of many texts, for use inside mapInArrow.

Texts go through numpy as bytes in chunks of about CHUNK bytes: a prefix sum of byte values times powers of an odd
multiplier (mod 2 ** 64) gives every word's hash by one subtraction, and the same over word hashes gives the hash of
any run of words. Memory is about 40 bytes per byte of a chunk; a text longer than CHUNK is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
_B, _C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n mod 2 ** 64, kept between calls."""
    if len(_powers.get(base, ())) <= n:
        x = np.full(n + (n >> 2) + 2, base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def runs_hash(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each start and end."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power(base, n)[:n], out=total[1:])
    inverse = power(pow(base, -1, 1 << 64), n)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a list of texts (bytes): hash, document and position of each, in order."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        blank = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(blank, prepend=True)) if len(b) else np.zeros(0, np.int64)
        starts, ends = edge[0::2], edge[1::2]  # the buffer ends in a blank
        self.hash = runs_hash(b.astype(np.uint64) + np.uint64(1), _B, starts, ends)
        at = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(at, starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.pos = np.arange(len(starts)) - self.first[self.doc]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that start k words of one document, and the hashes of these."""
        i = np.flatnonzero(self.pos + k <= self.count[self.doc]) if len(self.doc) else np.zeros(0, np.int64)
        return i, runs_hash(self.hash, _C, i, i + k)


def chunks(batches: Iterator, text: str = "text") -> Iterator[tuple]:
    """(batch, rows, texts) for slices of Arrow batches of about CHUNK bytes; null texts become empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        texts, start, size = [], 0, 0
        for i in range(batch.num_rows):
            t = column[i].as_py() or b""
            if texts and size + len(t) > CHUNK:
                yield batch, slice(start, i), texts
                texts, start, size = [], i, 0
            texts.append(t)
            size += len(t)
        if texts:
            yield batch, slice(start, batch.num_rows), texts


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its lower-cased k-word shingles; with fewer words, of the whole."""
    w = Words(texts, lower=True)
    i, h = w.windows(k)
    few = (w.count > 0) & (w.count < k)
    out = np.split(h, np.cumsum(np.bincount(w.doc[i], minlength=len(texts)))[:-1]) if len(texts) else []
    for d in np.flatnonzero(few):
        s = w.first[d : d + 1]
        out[d] = runs_hash(w.hash, _C, s, s + w.count[d])
    return [np.unique(x) for x in out]
