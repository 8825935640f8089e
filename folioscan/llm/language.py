"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A run of three letters (case folded; a space stands for
everything that is not a letter) is bound into one vector: the product of its letters' vectors, the first
rotated by two places, the second by one. A text's vector is the sum over its runs, a language's prototype the
sum of the unit vectors of its training texts, and a text gets the language whose prototype has the largest cosine.

Letters are told apart by code point modulo `SLOTS`, so the letter table has a fixed size for any script.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import prepare

SLOTS = 4096
#: Characters that are counted at a time; longer texts are read in pieces that overlap, so that each run is in one of them.
SPAN = 1 << 20


def letters(dims: int, seed: int) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 2, (SLOTS, dims), dtype=np.int8) * 2 - 1).astype(np.int8)


def _pieces(text: str):
    """(piece, whether its first character is the one before the piece, whether its last is the letter after it); pieces are cut before letters.

    Runs over a cut are found once: runs around such an added character are left to the other piece.
    """
    i = 0
    while i < len(text) or not i:
        j = i + SPAN
        while j < len(text) and not text[j].isalpha():
            j += 1
        yield text[max(0, i - 1) : j + 1], i > 0, j < len(text)
        i = j
        if j >= len(text):
            return


class Encoder:
    """Vectors of texts, many at a time: a matrix of run counts times the vectors of the runs they hold."""

    def __init__(self, dims: int, seed: int):
        table = letters(dims, seed)
        self.tables, self.dims = (np.roll(table, 2, 1), np.roll(table, 1, 1), table), dims

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and whether it has a letter."""
        out, has = np.zeros((len(texts), self.dims)), np.zeros(len(texts), bool)  # whole numbers, exact up to 2**53
        held, owner, size = [], [], 0
        for k, text in enumerate(texts):
            for piece in _pieces((text or "").lower()):
                held.append(piece)
                owner.append(k)
                size += len(piece[0])
                if size >= SPAN or len(held) >= 256:
                    self._add(held, np.array(owner), out, has)
                    held, owner, size = [], [], 0
        if held:
            self._add(held, np.array(owner), out, has)
        return out, has

    def _add(self, held: list[tuple[str, bool, bool]], owner: np.ndarray, out: np.ndarray, has: np.ndarray) -> None:
        pieces = [p for p, _, _ in held]
        code = np.frombuffer(" ".join(["", *pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces) + 1), [1, *(len(p) + 1 for p in pieces)])  # the space after a piece is its own
        letter = (code >= 97) & (code <= 122)
        high = np.flatnonzero(code >= 128)
        if len(high):
            odd, back = np.unique(code[high], return_inverse=True)
            letter[high] = np.array([chr(x).isalpha() for x in odd])[back]
        has[owner[np.bincount(piece[letter], minlength=len(pieces) + 1)[1:] > 0]] = True
        ends = np.cumsum([len(p) + 1 for p in pieces])  # each piece's own space
        added = np.zeros(len(code), bool)
        added[[e - len(p) for e, (p, before, _) in zip(ends.tolist(), held, strict=True) if before]] = True
        added[[e - 1 for e, (_, _, after) in zip(ends.tolist(), held, strict=True) if after]] = True
        slot = np.where(letter, 1 + code % (SLOTS - 1), 0)
        keep = np.ones(len(slot), bool)
        keep[1:] = (slot[1:] != 0) | (slot[:-1] != 0)  # one space between words
        slot, piece, added = slot[keep], piece[keep], added[keep]
        if len(slot) < 3:
            return
        used = np.flatnonzero(np.bincount(slot, minlength=SLOTS))
        small = np.zeros(SLOTS, np.int64)
        small[used] = np.arange(len(used))
        x, n = small[slot], len(used)
        run, of = (x[:-2] * n + x[1:-1]) * n + x[2:], piece[1:-1] - 1  # a run belongs to the piece of its middle letter
        own = (of >= 0) & (piece[2:] == piece[1:-1]) & ~added[1:-1]  # none reaches into the next text
        run, of = run[own], of[own]
        if n**3 <= 1 << 23:
            found = np.flatnonzero(np.bincount(run, minlength=n**3))
            place = np.zeros(n**3, np.int64)
            place[found] = np.arange(len(found))
            run = place[run]
        else:
            found, run = np.unique(run, return_inverse=True)
        a, b, c = (used[v] for v in (found // (n * n), found // n % n, found % n))
        step = max(1, (1 << 22) // max(len(pieces), self.dims))
        for i in range(0, len(found), step):
            width = min(step, len(found) - i)
            here = (run >= i) & (run < i + width) if width < len(found) else slice(None)
            counts = np.bincount(of[here] * width + run[here] - i, minlength=len(pieces) * width).reshape(len(pieces), width).astype(np.float32)
            vectors = (self.tables[0][a[i : i + width]] * self.tables[1][b[i : i + width]] * self.tables[2][c[i : i + width]]).astype(np.float32)
            np.add.at(out, owner, counts @ vectors)


def prototypes(docs: DataFrame, lang: str, train: Column, dims: int = 512, seed: int = 7) -> dict[str, np.ndarray]:
    """Each language's prototype; what reaches the driver is one vector for each language.

    Learns from the rows that meet train and have a lang and a letter in their text, each row once, repeated ones as often as they
    are there; without such rows there is no language.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), "text").where(train & F.col(lang).isNotNull())

    def run(batches):
        encode, sums = Encoder(dims, seed), {}
        for b in batches:
            v, has = encode(b.column(1).to_pylist())
            size = np.linalg.norm(v, axis=1)
            v = v.astype(np.float64) / np.where(size == 0, 1, size)[:, None]
            names = np.array(b.column(0).to_pylist(), object)
            for name in set(names[has]):
                sums[name] = sums.get(name, 0) + v[has & (names == name)].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r.lang: np.round(np.array([p.x for p in r.v]), 9) for r in sorted(found, key=lambda r: r.lang)}


def predict(docs: DataFrame, known: dict[str, np.ndarray], dims: int = 512, seed: int = 7) -> DataFrame:
    """doc_id, lang_pred and score (cosine with the nearest prototype, 0 at least) for each row of docs.

    A text that is null or has no letter gets `und` and 0, as do all texts if no language is known.
    Of equal cosines the first language by name wins. Every row has a result of its own, repeated ones the same one, rows
    without a doc_id a null one; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    names = sorted(known)
    unit = np.array([known[n] / (np.linalg.norm(known[n]) or 1.0) for n in names])

    def run(batches):
        encode = Encoder(dims, seed)
        for b in batches:
            v, has = encode(b.column(1).to_pylist())
            size = np.linalg.norm(v, axis=1)
            cosines = (v / np.where(size == 0, 1, size)[:, None]) @ unit.T if names else np.zeros((len(v), 1))
            best = cosines.argmax(1)
            lang = [names[k] if h and names else "und" for k, h in zip(best, has, strict=True)]
            score = np.where(has & bool(names), np.clip(cosines[np.arange(len(v)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
