"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Side A is a byte-level BPE file of the tokenizers library and encodes a space and the text; side B is a sentencepiece BPE model
and encodes the text, to which it adds the space. Tokens of either side are contiguous, so of two that overlap, the
start of one lies in the other: pandas' merge_asof, keyed by document, finds for each token start the token of the other side that
covers it. Both directions together are all overlaps (links); equal starts, which are equal ends of the tokens before,
cut both sides into groups.

How often a pair of ids is linked is counted over all documents. A batch of texts gives its distinct pairs with their counts
and, by document, the pairs' numbers in that batch; so pairs are shuffled once a batch, not once a document, and what
comes back to a batch is as large as what it sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import prepare, written
from .text import text_bytes
from .tokens import slices, tokenizer_path

#: Bytes of text that are aligned at a time (a longer text alone), and of distinct units that a Python worker remembers.
BATCH_TEXT, KEEP_BYTES = 2 << 20, 12 << 20
#: Bytes after which a space or a line feed begins a new unit: printable ASCII here, Latin letters of two bytes below.
PLAIN, BREAK, CUT, ALPHA = (np.zeros(256, bool) for _ in range(4))
PLAIN[33:127] = True
BREAK[[32, 10]] = True
CUT[list(b".,;:!?")] = True
ALPHA[[*range(65, 91), *range(97, 123)]] = True
MARK = 0xFF
_encoders: dict[tuple[str, str], PairEncoder] = {}


def piece_path(name: str = "piece_bpe_32k.model") -> str:
    return tokenizer_path(name)


class _Units(dict):
    """Unit of text to its number, given when it is first looked up; the ids of unit k are flat[side][first[side][k] : first[side][k + 1]]."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.size = 0
        self.flat = [np.zeros(0, np.int64)] * 2
        self.first = [np.zeros(1, np.int64)] * 2
        self.same = np.zeros(0, bool)

    def __missing__(self, unit: bytes) -> int:
        k = self[unit] = len(self)
        self.new.append(unit)
        self.size += len(unit)
        return k

    def add(self, ids: tuple[list[list[int]], list[list[int]]], same: list[bool]) -> None:
        for side in (0, 1):
            flat = np.array([x for u in ids[side] for x in u], np.int64)
            self.flat[side] = np.concatenate([self.flat[side], flat])
            sizes = np.array([len(u) for u in ids[side]], np.int64)
            self.first[side] = np.concatenate([self.first[side], self.first[side][-1] + np.cumsum(sizes)])
        self.same = np.concatenate([self.same, np.array(same, bool)])
        self.new = []


class PairEncoder:
    """The ids of both tokenizers for a batch of texts, found a unit at a time.

    A unit begins at a space or line feed that follows a printable character, and at a stop that follows a letter; neither
    tokenizer has tokens across such places, so a text's ids are those of its units and each distinct unit is encoded
    once. A pair of files for which this can't be seen from their vocabularies is used on whole texts instead.
    """

    def __init__(self, path_a: str, path_b: str):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)}
        back = {c: b for b, c in self.letters.items()}
        decode = lambda s: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        tokens = [decode(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        self.bytes = (tokens, [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in self.bytes]
        across = regex.compile(r"[^▁]▁|.\n|\n.|\p{L}[.,;:!?]", regex.S)
        plain = self.a.normalizer is None and str(self.a.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        probe = self.b.encode("\n \n", out_type=str) == ["▁", "<0x0A>", "▁", "<0x0A>"]
        self.by_unit = plain and probe and not any(across.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.word = regex.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
        self.units = _Units()

    def _same(self, data: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join([self.bytes[0][i] for i in a]) == data == b"".join([self.bytes[1][i] for i in b])

    def _learn(self, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        letters, model = self.letters, self.a.model
        ids = [[t.id for t in model.tokenize("".join([letters[x] for x in u]))] if self.word.fullmatch(t) else None for u, t in zip(units, texts, strict=True)]
        others = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(others, self.a.encode_batch([texts[k] for k in others], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        spaced = [t[0] == " " for t in texts]
        found = self.b.encode([t[1:] if s else "\n" + t for s, t in zip(spaced, texts, strict=True)], num_threads=1)
        found = [b if s else b[2:] for s, b in zip(spaced, found, strict=True)]
        self.units.add((ids, found), [self._same(u, a, b) for u, a, b in zip(units, ids, found, strict=True)])

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        """Both sides' ids of one text; none where the joined bytes of a side are not the space and the text."""
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        return (a, b) if self._same(b" " + text.encode(), a, b) else ([], [])

    def __call__(self, data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side: all ids of the texts data[off[i] : off[i + 1]], and each text's number of them."""
        n = len(off) - 1
        alone: dict[int, tuple] = {}
        if not self.by_unit:
            alone = {i: self.whole(data[off[i] : off[i + 1]].tobytes().decode()) for i in range(n)}
            return [self._joined([np.zeros(0, np.int64)] * n, {i: x[side] for i, x in alone.items()}) for side in (0, 1)]
        if self.units.size > KEEP_BYTES:
            self.units = _Units()
        units = self.units
        marked, ends = _marked(data, off)
        found, filled = [], np.flatnonzero(np.diff(off))
        counts = np.zeros(n, np.int64)
        for i in filled.tolist():
            own = marked[ends[i] : ends[i + 1]].tobytes().split(b"\xff")[1:]
            counts[i] = len(own)
            found.append(np.fromiter(map(units.__getitem__, own), np.int64, len(own)))
        if units.new:
            self._learn(units.new)
        k = np.concatenate(found) if found else np.zeros(0, np.int64)
        of = np.repeat(np.arange(n), counts)
        for i in np.unique(of[~units.same[k]]).tolist():
            alone[i] = self.whole(data[off[i] : off[i + 1]].tobytes().decode())
        if alone:
            k, of = (x[~np.isin(of, list(alone))] for x in (k, of))
        out = []
        for side in (0, 1):
            first = units.first[side]
            size = first[k + 1] - first[k]
            before = np.concatenate([[0], np.cumsum(size)])
            ids = units.flat[side][np.repeat(first[k] - before[:-1], size) + np.arange(before[-1])]
            sums = np.bincount(of, size, n).astype(np.int64)
            out.append(self._joined(np.split(ids, np.cumsum(sums)[:-1]), {i: x[side] for i, x in alone.items()}) if alone else (ids, sums))
        return out

    @staticmethod
    def _joined(parts: list[np.ndarray], other: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(other[i], np.int64) if i in other else x for i, x in enumerate(parts)]
        return np.concatenate([*parts, np.zeros(0, np.int64)]), np.array([len(x) for x in parts], np.int64)


def _marked(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each, and a byte that UTF-8 hasn't before each unit; and where each text begins."""
    if not len(data):
        return data, off
    here, last = data[1:], data[:-1]
    latin = np.concatenate([[False], (data[:-2] == 0xC3) & (last[1:] >= 0x80)])
    cut = np.flatnonzero((BREAK[here] & (PLAIN[last] | latin)) | (CUT[here] & ALPHA[last])) + 1
    cut = cut[~np.isin(cut, off)]
    starts = off[:-1][np.diff(off) > 0]
    at = np.concatenate([cut, starts, starts])
    new = np.concatenate([np.full(len(cut) + len(starts), MARK, np.uint8), np.full(len(starts), 32, np.uint8)])
    order = np.argsort(at, kind="stable")
    at, new = at[order], new[order]
    out = np.empty(len(data) + len(at), np.uint8)
    own = np.zeros(len(out), bool)
    own[at + np.arange(len(at))] = True
    out[own], out[~own] = new, data
    return out, off + np.searchsorted(at, off, "left")


def pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    """This Python worker's encoder, kept between tasks."""
    if (path_a, path_b) not in _encoders:
        _encoders[path_a, path_b] = PairEncoder(path_a, path_b)
    return _encoders[path_a, path_b]


class Aligned:
    """The alignment of a batch of texts, from the ids of both sides and their sizes in bytes."""

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray]], sizes: list[np.ndarray]):
        frames = []
        for (ids, counts), size in zip(sides, sizes, strict=True):
            at = np.cumsum(size[ids])  # over all texts of the batch, whose tokens have as many bytes on either side
            frames.append(pd.DataFrame({"doc": np.repeat(np.arange(len(counts)), counts), "at": at - size[ids], "id": ids}))
        a, b = frames
        self.counts = [c for _, c in sides]
        over = pd.merge_asof(a, b.assign(start=b["at"]), on="at", by="doc", suffixes=("", "_other"))
        under = pd.merge_asof(b, a.assign(start=a["at"]), on="at", by="doc", suffixes=("", "_other"))
        self.cuts = [(x["at"] == x["start"]).to_numpy() for x in (over, under)]
        later = ~self.cuts[1]  # equal starts are in both directions
        self.doc = np.concatenate([a["doc"].to_numpy(), b["doc"].to_numpy()[later]])
        self.link_a = np.concatenate([a["id"].to_numpy(), under["id_other"].to_numpy(np.int64)[later]])
        self.link_b = np.concatenate([over["id_other"].to_numpy(np.int64), b["id"].to_numpy()[later]])
        self.ids = [a["id"].to_numpy(), b["id"].to_numpy()]
        self.docs = [a["doc"].to_numpy(), b["doc"].to_numpy()]

    def groups_of(self) -> np.ndarray:
        """Each text's number of groups."""
        return np.bincount(self.docs[0][self.cuts[0]], minlength=len(self.counts[0]))

    def written_groups(self) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3."""
        group = [np.cumsum(c) - 1 for c in self.cuts]
        n = [np.bincount(g, minlength=1) for g in group]
        before = [np.concatenate([[0], np.cumsum(x)]) for x in n]
        place = [np.arange(len(group[0])) + before[1][group[0]], np.arange(len(group[1])) + before[0][group[1] + 1]]
        ids, stop = np.empty(sum(map(len, group)), np.int64), np.full(sum(map(len, group)), ord(","), np.uint8)
        for side, sign in ((0, "|"), (1, ";")):
            ids[place[side]] = self.ids[side]
            last = np.concatenate([group[side][1:] != group[side][:-1], np.ones(min(1, len(group[side])), bool)])
            stop[place[side][last]] = ord(sign)
        width = len(str(int(ids.max()))) if len(ids) else 1
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, width))
        text = np.zeros((len(ids), width + 1), np.uint8)
        for k in range(width):  # digit k from the left, where there is one
            text[:, k] = 48 + ids // 10 ** np.maximum(digits - 1 - k, 0) % 10
        text[np.arange(len(ids)), digits] = stop
        flat = text[np.arange(width + 1) <= digits[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(digits + 1)])[np.concatenate([[0], np.cumsum(self.counts[0] + self.counts[1])])].tolist()
        return [flat[s : max(s, e - 1)] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _rows(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, digest: bool) -> Iterator[pa.RecordBatch]:
    encode, batch = pair_encoder(path_a, path_b), TaskContext.get().partitionId() << 31
    for rows in batches:
        data, off = text_bytes(rows.column(1))
        begin = 0
        while begin < rows.num_rows:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + BATCH_TEXT, "right")) - 1)
            found = Aligned(encode(data[off[begin] : off[end]], off[begin : end + 1] - off[begin]), encode.sizes)
            pairs, names = pd.factorize(found.link_a << 32 | found.link_b)
            each, times = np.unique(found.doc << 32 | pairs, return_counts=True)
            doc, code = each >> 32, each & 0xFFFFFFFF
            counts = np.bincount(doc, minlength=end - begin)
            step = np.diff(code, prepend=0)  # from one of a text's pairs to the next
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            step[first] = code[first]
            texts = [hashlib.sha256(g).hexdigest() if g and digest else g.decode() for g in found.written_groups()]
            cols = {"batch": np.full(end - begin, batch), "doc_id": rows.column(0)[begin:end], "n_a": found.counts[0], "n_b": found.counts[1], "n_groups": found.groups_of(), "n_links": np.bincount(found.doc, minlength=end - begin), "groups": texts, "steps": slices(step.astype("<u4"), counts), "times": slices(times.astype("<u4"), counts)}
            yield _table(cols, end - begin)
            yield _table({"batch": np.full(len(names), batch), "number": np.arange(len(names), dtype=np.int32), "pair": names, "n": np.bincount(pairs, minlength=len(names))}, len(names))
            begin, batch = end, batch + 1


SCHEMA = pa.schema({"batch": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "steps": pa.binary(), "times": pa.binary(), "number": pa.int32(), "pair": pa.int64(), "n": pa.int64()})
ROWS = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, steps binary, times binary, number int, pair long, n long"


def _table(cols: dict, n: int) -> pa.RecordBatch:
    have = {k: v if isinstance(v, pa.Array) else pa.array(v, SCHEMA.field(k).type) for k, v in cols.items()}
    return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(n, f.type)) for f in SCHEMA], schema=SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (its links in all texts), best (whether no other pair of its B id has more), from a table of _rows."""
    counts = written(rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return counts.withColumn("b", b).hint("merge").join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, one row for each row of docs (doc_id, text).

    groups is the alignment, `a1,a2|b1;a3|b2,b3`: decimal ids of A and B in order, a group after the other; with digest its SHA-256 in hex.
    n_best counts the links whose pair is linked most often of all pairs of its B id, ties included; count_sum adds up the
    pairs' counts over the links. Texts that are null or empty, and those that a side doesn't give back byte for byte
    after the space, have no tokens: zeros and ''. Strings of special tokens are plain text. Rows that share a doc_id, or have
    none, are rows of their own; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or piece_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(lambda batches: _rows(batches, path_a, path_b, digest), ROWS), "aligned")
    marks = rows.where("pair IS NOT NULL").select("batch", "number", "pair").hint("merge").join(written(pair_counts(rows), "pair-marks"), "pair")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    texts = rows.where("pair IS NULL").select(F.col("batch").alias("of"), *kept, "groups", "steps", "times")

    def weigh(texts: pa.Table, marks: pa.Table) -> pa.Table:
        number, n = marks.column("number").to_numpy(), texts.num_rows
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = marks.column("count").to_numpy(), marks.column("best").to_numpy(zero_copy_only=False)
        runs = [texts.column(c).to_pylist() for c in ("steps", "times")]
        step, times = (np.frombuffer(b"".join(r), "<u4").astype(np.int64) for r in runs)
        sizes = np.array([len(r) // 4 for r in runs[0]], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], np.cumsum(step)])
        code = total[1:] - np.repeat(total[ends[:-1]], sizes)
        sums = [np.concatenate([[0], np.cumsum(x[code] * times)])[ends] for x in (best, count)]
        cols = [*(texts.column(c) for c in kept), *(pa.array(np.diff(x)) for x in sums), texts.column("groups")]
        return pa.table(dict(zip([*kept, "n_best", "count_sum", "groups"], cols, strict=True))) if n else pa.table({})

    out = texts.groupBy("of").cogroup(marks.drop("pair").groupBy("batch"))
    return out.applyInArrow(weigh, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
