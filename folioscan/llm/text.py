"""Arrays over the texts of an Arrow batch: words, their 64-bit hashes, hashes of word windows.

Everything is computed on the UTF-8 bytes of the batch with numpy, without a Python object for each word.
Hashes are deterministic across tasks and runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Of a word's next eight bytes, those that are its own, by how many are left.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes than this are hashed by blake2b.
LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and each text's first byte, with the total at the end."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("", pa.string()).cast(col.type))
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's first byte and the byte after its last, and each text's first word, with the total at the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SEPARATORS[data]
    inside = ~gap[1:-1]
    before, after = gap[:-2].copy(), gap[2:].copy()
    cut = off[:-1][off[:-1] < len(data)]
    before[cut] = True
    after[cut[cut > 0] - 1] = True
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, taken in eight at a time with a full mix in between."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(mix(size.astype(np.uint64) + BASE) ^ (eight[start] & MASKS[np.minimum(size, 8)]))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        left = size[more] - at
        out[more] = joined(out[more], eight[start[more] + at] & MASKS[np.minimum(left, 8)])
        more, at = more[left > 8], at + 8
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a sequence from the hashes of its two halves."""
    return mix(a * BASE + b)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, by first word; windows may cross texts, inside() tells.

    Windows of 1, 2, 4, ... words are joined two and two, and those that k is the sum of one after the other.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, width = None, 0, 1
    while True:
        if k & width:
            out = h[at : at + n] if out is None else joined(out, h[at : at + n])
            at += width
        width *= 2
        if width > k:
            return out
        h = joined(h[: len(h) - width // 2], h[width // 2 :])


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Of windows of k words by first word: whether they lie in one text."""
    n = max(0, int(first[-1]) - k + 1)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    return left >= k


def batch_words(batch: pa.RecordBatch, column: str = "text", lower: bool = False):
    """(hashes, first word of each text) of a batch's texts."""
    data, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    if lower:
        data = LOWER[data]
    start, end, first = words(data, off)
    return word_hashes(data, start, end), first
