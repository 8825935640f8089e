"""Packing documents into training sequences along a Hilbert curve.

Each document's ids are hashed into a vector of `FEATURES` counts; its direction is projected to three dimensions,
and the cell there gives a place on a Hilbert curve, so that documents with like contents are neighbours. The documents are
dealt out in ranges of that place (equal places are spread by a hash of the id, so copies can't fill one range)
and each range is one stream of ids, cut every `length` ids. What is left at the end of a range is cut into sequences
whose lengths are powers of two; they need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, text_bytes
from .tokens import END_ID, Parts, starts, tokenized

FEATURES, DIMS, BITS = 256, 3, 10


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (bits each), by the transpose method."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def places(seed: int):
    """A function for tokenized(): the Hilbert place of each document, then bits of a hash of its id."""
    project = np.random.default_rng(seed).standard_normal((FEATURES, DIMS)).astype(np.float64)

    def order(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        slot = (mix(np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int64)
        stop, cells = np.cumsum(counts), np.zeros((len(counts), DIMS), np.int64)
        for k in range(len(counts)):
            v = np.bincount(slot[ids[stop[k] - counts[k] : stop[k]]], minlength=FEATURES)
            z = v @ project / (np.sqrt((v * v).sum()) or 1.0)
            cells[k] = np.clip((z + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
        return (hilbert(cells) << 33) | (mix(doc_ids.astype(np.uint64)) >> np.uint64(31)).astype(np.int64)

    return order


def _ends(total: int, length: int) -> np.ndarray:
    """Ends of the shorter sequences that take a range's last total % length ids."""
    rest, at, out = total % length, total - total % length, []
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            at += 1 << b
            out.append(at)
    return np.array(out, np.int64)


def pack(docs: DataFrame, length: int = 4096, path: str | None = None, end_id: int = END_ID, seed: int = 11, ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (array<int>) of each piece.

    A document is cut where a sequence ends, however often; every id lies in one piece. Sequence ids count up from 0
    along the curve. Null and empty texts are the end id alone. Rows that share a doc_id are packed one by one, rows without one
    have a null doc_id in their pieces; an empty table gives no piece; other columns are not read.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    tokens = tokenized(docs, path, end_id, order=places(seed))
    kind = tokens._folioscan_kind
    dealing = Parts(tokens)
    sums, of = dealing.sums, dealing.of
    first = starts({k: v // length + int(v % length).bit_count() for k, v in sums.items()})

    def run(batches):
        now, at, full, ends = None, 0, 0, None
        for b in batches:
            data, _ = text_bytes(b.column(2))
            words, counts = data.view(kind), b.column(1).to_numpy()
            rows, done = [], 0
            for doc_id, count, p in zip(b.column(0).to_pylist(), counts.tolist(), b.column(3).to_pylist(), strict=True):
                if p != now:
                    now, at, full, ends = p, 0, sums[p] // length, _ends(sums[p], length)
                start = 0
                while start < count:
                    if at < full * length:
                        seq, begin = at // length, at // length * length
                        end = begin + length
                    else:
                        k = int(np.searchsorted(ends, at, "right"))
                        seq, begin, end = full + k, int(ends[k - 1]) if k else full * length, int(ends[k])
                    size = min(count - start, end - at)
                    rows.append((doc_id, start, size, zlib.crc32(words[done + start : done + start + size].astype("<u4").tobytes()), count, first[p] + seq, at - begin))
                    start += size
                    at += size
                done += count
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if ids:
                off = np.concatenate([[0], np.cumsum([r[2] for r in rows])])
                cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(words.astype(np.int32))))
            if rows:
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(cols)])

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(b.column(3)))], ["doc_id", "n_tokens", "ids", "place", "part"])

    rows = tokens.select("doc_id", "n_tokens", "ids", "place").mapInArrow(deal, "doc_id long, n_tokens long, ids binary, place long, part int")
    dealt = rows.repartitionById(dealing.n, F.col("part")).sortWithinPartitions("part", "place", "doc_id", "n_tokens", "ids")
    return dealt.select("doc_id", "n_tokens", "ids", "part").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids)
