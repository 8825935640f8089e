"""Exact substring deduplication with fixed-block anchors.

Every document is laid out in blocks of `block` words that don't overlap; their hashes are the anchors. A repeat of
`window` words (window >= 2 * block - 1) holds a whole block of the earlier text, so the rolling window of `block` words at
the same place of the later text has that anchor's hash. All rolling windows are probed against all anchors.

1. Documents with equal word sequences are one class; of all but the first everything is repeated.
2. Anchors and probes meet by hash, as packed arrays. A hash with an anchor and a second place is a hit, and the hits
   of a document tell which of its windows of `window` words can have a second place.
3. These windows are extended to exact repeats: they meet by a 64-bit hash of all their words, and all but the earliest
   place are repeats. A maximal repeat is a run of such windows; the words it covers go.

Removal is decided on the input. Texts are shuffled once, by doc_id, for documents with hits; where the documents
with hits are few, not at all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts_for, prepare, release, told_apart, written
from .text import batch_words, inside, mix, windows
from .tokens import slices

BUFFER_WORDS, PART_WORDS = 2_000_000, 3_000_000
#: Tables by document of up to so many rows and bytes are broadcast to the texts; larger ones are merged with them.
FEW_IDS, FEW_BYTES = 250_000, 32 << 20


def dedup_substrings(docs: DataFrame, window: int = 20, block: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row of docs.

    A word goes if a window of `window` consecutive words covers it whose word sequence also starts earlier: in a
    document of smaller doc_id, or earlier in the same one. Words are runs of anything but ASCII white space, unchanged.
    Null texts have no words. A null doc_id comes before all others; rows that share a doc_id come in the order of their
    texts' SHA-256 digests; if their texts are equal too, all count as the first. An empty table gives an empty result.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block")
    prepare(docs.sparkSession)
    texts = told_apart(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text"))
    marks = repeats(texts.select("doc_id", "text"), window, block)

    def cut(batches):
        for b in batches:
            out = []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = (text or "").encode().split()
                if gone is None:
                    kept = w
                else:
                    keep = np.ones(len(w) + window, np.int64)
                    if len(gone) == 1:
                        keep[:] = 0  # a copy of an earlier document
                    else:
                        for first, end in np.frombuffer(gone, "<u4").reshape(-1, 2).tolist():
                            keep[first:end] = 0
                    kept = [x for x, k in zip(w, keep[: len(w)].tolist(), strict=True) if k]
                out.append((len(w), len(w) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept"])

    joined = texts.join(_small(marks, "gone"), "doc_id", "left")
    out = joined.select(F.col("id").alias("doc_id"), "text", "gone").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))


def repeats(texts: DataFrame, window: int, block: int) -> DataFrame:
    """doc_id, gone: runs of words to remove, or one zero byte for a copy of an earlier document."""

    def sizes(batches):
        for b in batches:
            h, first = batch_words(b)
            fp = [hashlib.blake2b(h[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), pa.array(fp, pa.binary())], ["doc_id", "n", "fp"])

    slim = written(texts.mapInArrow(sizes, "doc_id long, n long, fp binary"), "substring-sizes").where(F.col("n") >= window)
    first = written(slim.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "substring-copies")
    copies = written(slim.hint("merge").join(first, "fp").where("doc_id > first").select("doc_id").distinct(), "substring-copy-ids")
    hits = _hits(texts, slim, copies, window, block)
    found = _extended(texts, hits, window, block)
    marks = written(found.unionByName(copies.select("doc_id", F.unhex(F.lit("00")).alias("gone"))), "substring-marks")
    release(texts.sparkSession)
    return marks


def _without(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return texts.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("merge"), "doc_id", how)


#: Packed places: the ids of their documents, how many each has, hashes and word positions; done: known to be results.
PLACES = "part int, done boolean, docs binary, counts binary, h binary, at binary"


def _place_rows(part: int, done: bool, ids: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray, kind: str) -> pa.RecordBatch:
    """One row with these places; doc (an index in ids) must not fall."""
    used, counts = np.unique(doc, return_counts=True)
    narrow = "<u2" if not len(at) or at.max() < 1 << 16 else "<u4"
    cells = [ids[used].astype("<i8"), counts.astype("<u4"), h.astype(kind), at.astype(narrow)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], [c.split()[0] for c in PLACES.split(", ")])


def _places(rows: list[tuple], kind: str) -> tuple[np.ndarray, ...]:
    """ids, index in ids, h and at of all places of rows (docs, counts, h, at)."""
    ids, doc, hs, ats, base = [], [], [], [], 0
    for d, c, h, at in rows:
        d, c, h = np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4"), np.frombuffer(h, kind)
        ids.append(d)
        doc.append(np.repeat(np.arange(base, base + len(d)), c))
        base += len(d)
        hs.append(h)
        ats.append(np.frombuffer(at, "<u2" if len(at) == 2 * len(h) else "<u4").astype(np.uint32))
    return tuple(np.concatenate(x) for x in (ids, doc, hs, ats))


def _by_document(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, n_parts: int):
    """Packed rows of result places, by a hash of their document."""
    part = (mix(ids.view(np.uint64)) % np.uint64(n_parts)).astype(np.int32)[doc]
    order = np.lexsort((at, doc, part))
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])
    for p in np.flatnonzero(np.diff(ends)):
        s = order[ends[p] : ends[p + 1]]
        yield _place_rows(int(p), True, ids, doc[s], np.zeros(0, "<u8"), at[s], "<u8")


def _gathered(batches):
    """One row (doc_id, at) for each document of a part."""
    ids, doc, at, base = [], [], [], 0
    for b in batches:
        for d, c, x in zip(*(b.column(i).to_pylist() for i in (2, 3, 5)), strict=True):
            d, c = np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")
            ids.append(d)
            doc.append(np.repeat(np.arange(base, base + len(d)), c))
            base += len(d)
            at.append(np.frombuffer(x, "<u2" if len(x) == 2 * int(c.sum()) else "<u4").astype(np.uint32))
    if not base:
        return
    names, index = np.unique(np.concatenate(ids), return_inverse=True)
    doc, at = index[np.concatenate(doc)], np.concatenate(at)
    order = np.lexsort((at, doc))
    counts = np.bincount(doc, minlength=len(names))
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = at[order].astype("<u4")
    for i in range(0, len(names), 4096):
        j = min(len(names), i + 4096)
        yield pa.RecordBatch.from_arrays([pa.array(names[i:j]), slices(at[ends[i] : ends[j]], counts[i:j])], ["doc_id", "at"])


def _cells(block: int):
    """Places as the blocks they begin in, 16 bits each where that is enough (then the first byte is 2, else 4)."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                c = np.unique(np.frombuffer(x, "<u4") // block)
                width = 2 if c[-1] < 1 << 16 else 4
                out.append(bytes([width]) + c.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "at"])

    return run


def _runs(h: np.ndarray, *then) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by h (then by the other keys), the first of each run of equal h in it, and the runs' lengths."""
    order = np.lexsort((*reversed(then), h)) if then else np.argsort(h, kind="stable")
    h = h[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return order, start, np.diff(np.concatenate([start, [len(h)]]))


def _exchange(rows: DataFrame, find, settle, meet, kind: str, n_parts: int) -> DataFrame:
    """doc_id, at (32-bit, ascending): for each document its places that are results, from all places of equal hash.

    find(batch) gives (ids, doc, h, at); settle(...) the indexes that are results already and those that must be
    dealt out by hash; meet(...) the indexes of results among all places that were dealt to one part. What a task
    can settle by itself, as most places of a very frequent hash, is not shuffled by that hash.
    """

    def deal(held):
        ids = np.concatenate([x[0] for x in held])
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        doc = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        h, at = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        done, rest = settle(ids, doc, h, at)
        for k in range(0, len(done), 1 << 18):
            d = np.sort(done[k : k + (1 << 18)])
            yield _place_rows(int(h[d[0]] % np.uint64(n_parts)), True, ids, doc[d], np.zeros(0, kind), at[d], kind)
        rest = np.sort(rest)
        part = ((h[rest] >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int32)
        order = rest[np.argsort(part, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])
        for p in np.flatnonzero(np.diff(ends)):
            s = order[ends[p] : ends[p + 1]]
            yield _place_rows(int(p), False, ids, doc[s], h[s] & np.uint64(0xFFFFFFFF) if kind == "<u4" else h[s], at[s], kind)

    def out(batches):
        held, size = [], 0
        for b in batches:
            held.append(find(b))
            size += len(held[-1][2])
            if size >= BUFFER_WORDS:
                yield from deal(held)
                held, size = [], 0
        if size:
            yield from deal(held)

    def back(batches):
        held = []
        for b in batches:
            for done, docs, counts, h, at in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if done:
                    ids, c = np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<u4")
                    at = np.frombuffer(at, "<u2" if len(at) == 2 * int(c.sum()) else "<u4")
                    yield from _by_document(ids, np.repeat(np.arange(len(ids)), c), at, n_parts)
                else:
                    held.append((docs, counts, h, at))
        if held:
            ids, doc, h, at = _places(held, kind)
            held.clear()
            found = meet(ids, doc, h, at)
            yield from _by_document(ids, doc[found], at[found], n_parts)

    met = rows.mapInArrow(out, PLACES).repartitionById(n_parts, F.col("part")).mapInArrow(back, PLACES)
    return met.repartitionById(n_parts, F.col("part")).mapInArrow(_gathered, "doc_id long, at binary")


def _hits(texts: DataFrame, slim: DataFrame, copies: DataFrame, window: int, block: int) -> DataFrame:
    """doc_id, at: places of the rolling blocks that match an anchor elsewhere, and of anchors that are matched."""
    total = slim.agg(F.sum("n")).first()[0] or 0

    def probes(b):
        h, first = batch_words(b)
        w, ok = windows(h, block), inside(first, block)
        n = np.diff(first)
        s = np.flatnonzero(ok & np.repeat(n >= window, n)[: len(w)])
        of = np.repeat(np.arange(len(n)), n)[: len(w)][s]
        return b.column(0).to_numpy(), of, w[s], (s - first[of]).astype(np.uint32)

    def anchored(order, start, at):
        return np.add.reduceat((at[order] % block == 0).astype(np.int64), start) > 0

    def settle(ids, doc, h, at):
        order, start, n = _runs(h, at % block != 0)  # of each hash an anchor comes first, if there is one
        hit = np.repeat((n > 1) & anchored(order, start, at), n)
        first = np.zeros(len(order), bool)
        first[start] = True
        return order[hit], order[~hit | first]

    def meet(ids, doc, h, at):
        order, start, n = _runs(h)
        return order[np.repeat((n > 1) & anchored(order, start, at), n)]

    rows = _without(texts, copies, "left_anti").select("doc_id", "text")
    return _exchange(rows, probes, settle, meet, "<u4", parts_for(texts.sparkSession, int(total), PART_WORDS))


def _small(table: DataFrame, column: str) -> DataFrame:
    """A table by doc_id as a broadcast, if its rows and bytes are counted to be few; else to be merged."""
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
    return F.broadcast(table) if n <= FEW_IDS and size <= FEW_BYTES else table.hint("merge")


def _extended(texts: DataFrame, hits: DataFrame, window: int, block: int) -> DataFrame:
    """doc_id, gone for documents with repeated windows, from windows with a hit in reach of a block at their start."""
    hits = written(hits.mapInArrow(_cells(block), "doc_id long, at binary"), "substring-hits")
    release(texts.sparkSession)
    total = hits.agg(F.sum(F.length("at"))).first()[0] or 0
    near = texts.join(_small(hits, "at"), "doc_id").select("doc_id", "text", "at")

    def candidates(b):
        h, first = batch_words(b)
        w = windows(h, window)
        s = []
        for i, x in enumerate(b.column(2).to_pylist()):
            size = int(first[i + 1] - first[i]) - window + 1
            if size > 0:
                cell = np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)
                hit = np.zeros(size // block + window // block + 3, bool)
                hit[cell[cell < len(hit)]] = True
                at = np.arange(size)
                reach = hit[at // block]
                for k in range(1, (window - block) // block + 2):
                    reach = reach | hit[at // block + k]
                s.append(first[i] + np.flatnonzero(reach))
        s = np.concatenate(s) if s else np.zeros(0, np.int64)
        of = np.searchsorted(first, s, "right") - 1
        return b.column(0).to_numpy(), of, w[s], (s - first[of]).astype(np.uint32)

    def later(ids, doc, h, at):
        """Places that follow the earliest one of their hash, and the earliest ones. Rows that share a doc_id are one place."""
        order, start, n = _runs(h, ids[doc], at)
        first = np.repeat(start, n)
        same = (ids[doc[order]] == ids[doc[order[first]]]) & (at[order] == at[order[first]])
        lead = np.zeros(len(order), bool)
        lead[start] = True
        return order[~same], order[lead]

    found = _exchange(near, candidates, later, lambda *x: later(*x)[0], "<u8", parts_for(texts.sparkSession, int(total) * block // 2, PART_WORDS))
    return found.mapInArrow(lambda batches: _covered(batches, window), "doc_id long, gone binary")


def _covered(batches, window: int):
    """Runs of words that go, as pairs (first, end), from the first words of repeated windows."""
    for b in batches:
        out = []
        for cells in b.column(1).to_pylist():
            at = np.frombuffer(cells, "<u4").astype(np.int64)
            cut = np.flatnonzero(np.diff(at) > window)
            first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
            out.append(np.stack([first, last + window], 1).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "gone"])
