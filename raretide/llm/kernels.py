"""Vectorised text kernels over Arrow string arrays: words, hashes, rolling windows.

Everything here works on the raw UTF-8 bytes of a whole batch at once; no per-word Python objects are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: all ASCII but digits and a-z.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

BASE = U(0x9E3779B97F4A7C15)
BASE2 = U(0xC2B2AE3D27D4EB4F)
#: What two independent hashes of a word start from.
STARTS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))
#: The first k bytes of a little-endian lane of eight.
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Words of more bytes are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift, multiply, shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (nulls are empty)."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64, count=len(text) + 1 + text.offset)[text.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(buffers(batch.column(column))[1])
        cut = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = cut[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(cut, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


class Words:
    """Words of each text of a batch.

    start, size: byte place and length of each word; first: index of the first word of each text, and the end.
    """

    def __init__(self, text: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray = LOWER):
        raw, self.offsets = buffers(text)
        self.bytes = fold[raw]
        inside = ~separators[self.bytes]
        before = np.empty(len(inside), bool)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
        heads = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        if len(inside):
            after[:-1] = inside[1:]
            after[heads[heads > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        self.size = ends - self.start
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; those of ``which`` 0 and 1 are independent.

        Bytes enter in lanes of eight, each followed by a bijective mix: words of one size up to eight bytes never
        share a hash, and no arithmetic structure of longer ones survives. Words over LONG bytes take a keyed BLAKE2b.
        """
        n = len(self.start)
        if not n:
            return np.zeros(0, U)
        lanes = np.zeros(len(self.bytes) // 8 + 2, U)
        lanes.view(np.uint8)[: len(self.bytes)] = self.bytes

        def lane(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            place, shift = at >> 3, ((at & 7) << 3).astype(U)
            return (lanes[place] >> shift | lanes[place + 1] << U(1) << (U(63) - shift)) & LANE[np.minimum(left, 8)]

        with np.errstate(over="ignore"):
            out = mix(lane(self.start, self.size) ^ mix(self.size.astype(U) * BASE + STARTS[which]))
            more, done = np.flatnonzero((self.size > 8) & (self.size <= LONG)), 8
            while len(more):
                out[more] = mix(out[more] * BASE2 ^ lane(self.start[more] + done, self.size[more] - done))
                done += 8
                more = more[self.size[more] > done]
        for i in np.flatnonzero(self.size > LONG).tolist():
            word = self.bytes[self.start[i] : self.start[i] + self.size[i]]
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=bytes([which + 1])).digest(), "little")
        return out

    def text_of(self) -> np.ndarray:
        """Index of the text that each word stands in."""
        return np.repeat(np.arange(len(self.count)), self.count)


def rolling(h: np.ndarray, k: int, first: np.ndarray, salt: U = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the mask of places where k words of one text follow."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * salt + h[j : j + n]
        out = mix(out)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    return out, left >= k
