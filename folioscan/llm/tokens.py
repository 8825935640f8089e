"""Texts to token ids with a public tokenizer, and tables of ids dealt out in an order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts_for, prepare, written
from .text import LOWER, text_bytes

END_ID = 2
#: Words whose ids a Python worker keeps in its newer and its older half each; some 130 MB together.
KEEP_WORDS = 500_000
#: Tokens in a part of a dealt table.
PART_TOKENS = 8_000_000
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[list(b".,;:!?")] = True
_encoders: dict[tuple[str, int], WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """The ids that tokenizers gives for whole texts, found a word at a time.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words between ASCII white
    space, one after the other; each distinct word is encoded once. So that there are fewer of them, A-Z are lower-cased, as the normalizer
    does anyway, and a stop after a letter counts as a word, as the pattern splits there anyway. Words of Latin letters, digits and punctuation
    (no character that normalisation composes or maps to several) go straight to the BPE model, in the pieces of the
    tokenizer's own pattern; all others, and those that may hold a special token, are encoded as a whole. A file with another
    normalizer or pre-tokenizer than this rests on is used on whole texts instead.
    """

    #: The normalizer and the pre-tokenizer of such a file, as the library prints them.
    NORMALIZER = r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
    SPLIT = r"""Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True)"""
    PRE_TOKENIZER = f"Sequence(pretokenizers=[{SPLIT}, ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])"

    def __init__(self, path: str, end_id: int = END_ID):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.model = self.tokenizer.model
        self.by_word = (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)) == (self.NORMALIZER, self.PRE_TOKENIZER)
        self.plain = regex.compile("[!-~¡-įı-ɏ]+")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]
        self._age()

    def _age(self) -> None:
        """Begin a new half; words that are met again come over from the older one, the others are forgotten next time."""
        self.old = getattr(self, "half", _Half())
        self.half, self.piece_ids = _Half(), {}

    def _pieces(self, s: str) -> list[str] | None:
        """The pieces of the tokenizer's pattern; None for words that must be encoded as a whole."""
        if s.isascii() or self.plain.fullmatch(s):
            if s.isalpha():
                return [s.lower()]
            if s[-1] in ".,;:!?" and s[:-1].isalpha():
                return [s[:-1].lower(), s[-1]]
        if "<|" in s or not self.plain.fullmatch(s):
            return None
        return self.pieces.findall(s.lower())

    def word_ids(self, word: bytes) -> list[int]:
        s = word.decode()
        pieces = self._pieces(s)
        if pieces is None:
            return self.tokenizer.encode(s, add_special_tokens=False).ids
        out = []
        for p in pieces:
            ids = self.piece_ids.get(p)
            if ids is None:
                mapped = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
                ids = self.piece_ids[p] = [t.id for t in self.model.tokenize(mapped)]
            out += ids
        return out

    def _learn(self) -> None:
        half, old = self.half, self.old
        flat, sizes = [], []
        for w in half.new:
            k = old.get(w)
            ids = self.word_ids(w) if k is None else old.flat[old.first[k] : old.first[k + 1]].tolist()
            flat += ids
            sizes.append(len(ids))
        half.flat = np.concatenate([half.flat, np.array(flat, np.uint32)])
        half.first = np.concatenate([half.first, half.first[-1] + np.cumsum(sizes, dtype=np.int64)])
        half.new = []

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch's texts, each text's with the end id (null: the end id alone), and their counts."""
        if not self.by_word:
            return self._whole(column)
        data, off = text_bytes(column)
        if len(self.half) > KEEP_WORDS:
            self._age()
        half, found, words = self.half, [], np.zeros(len(off) - 1, np.int64)
        easy, ends = plainer(data, off)
        for i in range(len(words)):
            w = easy[ends[i] : ends[i + 1]].tobytes()
            if b"<|" in w:  # may be a special token, which is so in lower case only
                w = data[off[i] : off[i + 1]].tobytes()
            w = w.split()
            words[i] = len(w)
            found.append(np.fromiter(map(half.__getitem__, w), np.int32, len(w)))
        if half.new:
            self._learn()
        k = np.concatenate(found) if found else np.zeros(0, np.int32)
        first, size = half.first[k], (half.first[1:] - half.first[:-1])[k]
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[np.cumsum(words)]
        counts = np.diff(np.concatenate([[0], ends])) + 1
        out = np.empty(int(before[-1]) + len(counts), np.uint32)
        at_end = np.zeros(len(out), bool)
        at_end[np.cumsum(counts) - 1] = True
        out[at_end] = self.end_id
        out[~at_end] = half.flat[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        return out, counts

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [[*self.tokenizer.encode(t or "", add_special_tokens=False).ids, self.end_id] for t in column.to_pylist()]
        return np.array([x for f in found for x in f], np.uint32), np.array([len(f) for f in found], np.int64)


def plainer(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case (A-Z) with a space between each such letter and a stop after it, and where each begins."""
    cut = np.flatnonzero(LETTER[data[:-1]] & STOP[data[1:]]) + 1
    out = np.full(len(data) + len(cut), 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[cut + np.arange(len(cut))] = False
    out[keep] = LOWER[data]
    return out, off + np.searchsorted(cut, off, "left")


class _Half(dict):
    """Word to its number, given when it is first looked up; the ids of word k are flat[first[k] : first[k + 1]]."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """This Python worker's encoder, kept between tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def slices(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array with each row's run of values."""
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.itemsize, out=off[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID, order=None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 16-bit where all ids fit, else 32-bit), place; written to the shared folder.

    order(ids, counts) gives each row's place in the order to deal by; else it is the doc_id (null: below all).
    """
    from tokenizers import Tokenizer

    prepare(docs.sparkSession)
    path = path or tokenizer_path()
    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def run(batches):
        encode = encoder(path, end_id)
        for b in batches:
            ids, counts = encode(b.column(1))
            if order is None:
                place = b.column(0).fill_null(-(1 << 63))
            else:
                place = pa.array(order(ids, counts, b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), slices(ids.astype(kind), counts), place], ["doc_id", "n_tokens", "ids", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = written(rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, place long"), "tokens", "snappy")
    out._folioscan_kind = kind
    return out


class Parts:
    """Parts of a tokenized() table that follow the order of place and hold about PART_TOKENS tokens each.

    n is their number, sums the tokens of each; bounds and sums, one for each part, are what reaches the driver.
    """

    def __init__(self, table: DataFrame):
        total = table.agg(F.sum("n_tokens")).first()[0] or 0
        self.n = parts_for(table.sparkSession, total, PART_TOKENS)
        at = [i / self.n for i in range(1, self.n)]
        found = table.agg(F.percentile_approx("place", at, 10 * self.n)).first()[0] if at else None
        self.bounds = np.unique(np.array(found or [], np.int64))
        of, most = self.of, len(self.bounds) + 1

        def count(batches):
            sums = np.zeros(most, np.int64)
            for b in batches:
                np.add.at(sums, of(b.column(0)), b.column(1).to_numpy())
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(sums[k])], ["part", "n"])

        rows = table.select("place", "n_tokens").mapInArrow(count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
        self.sums = {r.part: r.n for r in rows}

    @property
    def of(self):
        """A function from places to parts."""
        bounds = self.bounds
        return lambda place: np.searchsorted(bounds, place.to_numpy(), "left").astype(np.int32)


def starts(sums: dict[int, int]) -> dict[int, int]:
    """Of figures by part: the sum over all parts before each."""
    out, total = {}, 0
    for k in sorted(sums):
        out[k] = total
        total += sums[k]
    return out
