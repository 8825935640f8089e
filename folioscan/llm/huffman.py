"""Token ids in a compact binary format: canonical length-limited Huffman codes in independent blocks.

Code lengths come from the counts of all ids by package-merge, with at most `MOST` bits, so that one table of 2**MOST
entries decodes any code. The format is a folder with two Parquet tables:

codes   one row: code length of each id (0: unused), bits of the longest code
blocks  part, block, start (ids before the block), doc_ids, n_tokens (of each document), marks, payload

A document's codes begin at a byte of payload. marks holds the bit offset in payload of every `STEP`-th id of each document,
its first one included; decoding runs from all marks of many blocks at once, one id at a time each.
Blocks hold about `BLOCK` ids, whole documents each, in ascending doc_id order within and across parts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import forget, new_path, prepare
from .text import text_bytes
from .tokens import Parts, slices, starts, tokenized

MOST, STEP, BLOCK = 16, 64, 1 << 17
BLOCKS = "part int, block long, start long, doc_ids array<long>, n_tokens array<long>, marks binary, payload binary"


def code_lengths(counts: np.ndarray, most: int = MOST) -> np.ndarray:
    """Lengths of an optimal prefix code with codes of at most `most` bits; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, weights = [], leaf
    is_leaf = np.ones(len(leaf), bool)
    levels.append(is_leaf)
    for _ in range(most - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        weights, is_leaf = both[by], by < len(leaf)
        levels.append(is_leaf)
    take, length = 2 * len(leaf) - 2, np.zeros(len(leaf), np.uint8)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes that count up in the order of (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        code <<= n - before
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code, before = code + len(ids), n
    return codes


def encode(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Payload bytes, bytes of each document, marks relative to each document's first bit, marks of each document."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    stop = np.cumsum(counts)
    bits = np.diff(np.concatenate([[0], end[stop - 1]])) if len(counts) else np.zeros(0, np.int64)
    nbytes = (bits + 7) // 8
    shift = np.cumsum(nbytes) * 8 - nbytes * 8 - (np.cumsum(bits) - bits)
    at = end - size + np.repeat(shift, counts)
    word, low = at >> 5, (at & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - low - size.astype(np.uint64))
    out = np.zeros(int(nbytes.sum()) // 4 + 3, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    payload = out.astype(">u4").view(np.uint8)[: int(nbytes.sum())]
    local = np.arange(len(ids)) - np.repeat(stop - counts, counts)
    marked = local % STEP == 0
    base = np.cumsum(nbytes) * 8 - nbytes * 8
    marks = (at - np.repeat(base, counts))[marked].astype(np.uint32)
    return payload, nbytes, marks, (counts + STEP - 1) // STEP


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id and the code length for each value of the next MOST bits."""
    ids, size = np.zeros(1 << MOST, np.uint32), np.ones(1 << MOST, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = np.int64(1) << (MOST - lengths[used].astype(np.int64))
    n = int(span.sum())
    ids[:n], size[:n] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, size


def decode(payload: np.ndarray, marks: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids; marks are bit offsets in payload, counts the ids of each document."""
    ids, size = table
    b = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    wide = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    n_marks = (counts + STEP - 1) // STEP
    left = np.full(len(marks), STEP, np.int64)
    left[np.cumsum(n_marks) - 1] = counts - (n_marks - 1) * STEP
    at, out = marks.astype(np.int64), np.empty((len(marks), STEP), np.uint32)
    most = len(wide) - 1
    for k in range(STEP):
        x = (wide[np.minimum(at >> 3, most)] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[:, k] = ids[x]
        at += size[x]
    return out[np.arange(STEP) < left[:, None]]


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all rows; one figure for each id of the vocabulary reaches the driver."""

    def run(batches):
        n = np.zeros(0, np.int64)
        for b in batches:
            data, _ = text_bytes(b.column(0))
            c = np.bincount(data.view(kind))
            n, c = (n, c) if len(n) >= len(c) else (c, n)
            n[: len(c)] += c
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n[ids].astype(np.int64))], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_ids(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Write the ids of all texts of docs to the folder out, in ascending doc_id order.

    A null text is the end id alone; rows without a doc_id come first; rows that share one follow each other, shorter ones first;
    an empty table gives an empty table of blocks; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    tokens = tokenized(docs, path)
    kind = tokens._folioscan_kind
    lengths = code_lengths(id_counts(tokens, kind))
    codes = canonical(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()), int(lengths.max(initial=0)))], "lengths binary, longest int").coalesce(1).write.parquet(f"{out}/codes")
    dealing = Parts(tokens)
    first, of = starts(dealing.sums), dealing.of

    def coded(batches):
        for b in batches:
            ids, _ = text_bytes(b.column(2))
            counts = b.column(1).to_numpy()
            payload, nbytes, marks, n_marks = encode(ids.view(kind), counts, lengths, codes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(of(b.column(3))), slices(marks, n_marks), slices(payload, nbytes)], ["doc_id", "n_tokens", "place", "part", "marks", "payload"])

    rows = tokens.select("doc_id", "n_tokens", "ids", "place").mapInArrow(coded, "doc_id long, n_tokens long, place long, part int, marks binary, payload binary")
    dealt = rows.repartitionById(dealing.n, F.col("part")).sortWithinPartitions("part", "place", "n_tokens", "payload")
    dealt.mapInArrow(lambda batches: _blocks(batches, first), BLOCKS).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    forget(tokens)


def _blocks(batches, first: dict[int, int]):
    held: list[tuple] = []
    state = {"part": None, "block": 0, "start": 0, "n": 0}

    def emit():
        base, marks, payload = 0, [], []
        for _, _, m, p in held:
            marks.append(np.frombuffer(m, np.uint32).astype(np.int64) + base * 8)
            payload.append(p)
            base += len(p)
        row = [[state["part"]], [state["block"]], [state["start"]], [[h[0] for h in held]], [[h[1] for h in held]], [np.concatenate(marks).astype("<i8").tobytes()], [b"".join(payload)]]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])
        state["block"] += 1
        state["start"] += state["n"]
        state["n"] = 0
        held.clear()
        return out

    for b in batches:
        cols = [b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
        for doc_id, n, part, marks, payload in zip(*cols, strict=True):
            if held and (part != state["part"] or state["n"] + n > BLOCK):
                yield emit()
            if part != state["part"]:
                state |= {"part": part, "block": 0, "start": first[part], "n": 0}
            held.append((doc_id, n, marks, payload))
            state["n"] += n
    if held:
        yield emit()


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<int>) of each document in the folder."""
    prepare(spark)
    row = spark.read.parquet(f"{path}/codes").first()
    lengths = np.frombuffer(bytes(row.lengths), np.uint8)

    def run(batches):
        table = decode_table(lengths, canonical(lengths))
        for b in batches:
            for r in b.to_pylist():
                counts = np.array(r["n_tokens"], np.int64)
                found = decode(np.frombuffer(r["payload"], np.uint8), np.frombuffer(r["marks"], "<i8"), counts, table)
                stop = np.cumsum(counts)
                raw, start = memoryview(found.astype("<u4").tobytes()), r["start"] + stop - counts
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(stop.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(counts), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("start", "doc_ids", "n_tokens", "marks", "payload").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs' ids to a new folder of the shared place and read them back: doc_id, start, n_tokens, ids_crc32."""
    out = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, out, path)
    return read_ids(docs.sparkSession, out, ids=False)
