"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into pieces and each piece is compressed once with either dictionary. Two figures of the total
sizes, the normalised difference (bad - good) / (bad + good) and the mean size for each byte of text, become a
probability by a logistic curve that is fitted on labelled rows which the dictionaries have not seen. (The
difference alone can't place texts that repeat one word: both dictionaries shrink them to nothing.)

The fit reads a bounded sample of labelled rows: at most `fit_rows` rows of each label, of at most
`fit_chars` characters each, the ones with the smallest hash of their id. Scores read whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, prepare, written


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    offset: float
    piece: int
    level: int = 3

    def compressors(self) -> tuple:
        return tuple(_compressor(d, self.level) for d in (self.good, self.bad))

    def figures(self, text: str | None, using: tuple) -> tuple[float, float]:
        """The normalised difference and the mean compressed size for each byte; (0, 1) for no text."""
        data = memoryview((text or "").encode())
        if not len(data):
            return 0.0, 1.0
        good, bad = (sum(len(c.compress(data[i : i + self.piece])) for i in range(0, len(data), self.piece)) for c in using)
        return (bad - good) / (bad + good), (bad + good) / (2 * len(data))

    def score(self, difference: float, ratio: float) -> float:
        z = max(-700.0, min(700.0, self.slopes[0] * difference + self.slopes[1] * ratio + self.offset))
        return 1 / (1 + math.exp(-z))


def _compressor(dictionary: bytes, level: int):
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(texts: list[str], size: int, piece: int) -> bytes:
    parts = [p for t in texts for b in [t.encode()] for i in range(0, len(b), piece) if (p := b[i : i + piece])]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(parts)[-size:] or b"\0" * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and offset of a logistic curve by Newton steps, with a small ridge so that separable rows stay finite."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        g = a.T @ (y - p) - 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return tuple(float(v) for v in slopes), float(w[-1] - slopes @ mean)


def fit_texts(good: list[str], bad: list[str], dictionary_bytes: int = 65536, piece: int = 512) -> CompressionModel:
    """Dictionaries from the even rows of either list, the curve from the odd ones; with rows of one label or none, a constant score."""
    if not good or not bad:
        return CompressionModel(b"\0" * 8, b"\0" * 8, (0.0, 0.0), 4.0 if good else -4.0 if bad else 0.0, piece)
    size = min(dictionary_bytes, max(256, min(sum(len(t) for t in x[::2]) for x in (good, bad)) // 4))
    model = CompressionModel(_dictionary(good[::2], size, piece), _dictionary(bad[::2], size, piece), (0.0, 0.0), 0.0, piece)
    using = model.compressors()
    rows = [(t, y) for x, y in ((good, 1.0), (bad, 0.0)) for t in (x[1::2] or x)]
    slopes, offset = _logistic(np.array([model.figures(t, using) for t, _ in rows]), np.array([y for _, y in rows]))
    return CompressionModel(model.good, model.bad, slopes, offset, piece)


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = 3000, fit_chars: int = 16384, **kw) -> CompressionModel:
    """Fit on rows of docs that labels marks 0 or 1 in quality; train is a condition on doc_id.

    Ids with both labels, labels without an id or other than 0 and 1, and texts that are empty or longer than fit_chars are left out before
    the fit_rows of each label are taken; repeated rows count once. With rows of one label or none, or an empty table, the
    score is a constant.
    """
    quality = F.col("quality")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), quality).where(F.col("doc_id").isNotNull() & train & quality.isNotNull())
    marked = marked.groupBy("doc_id").agg(F.min(quality).alias("quality"), F.max(quality).alias("other")).where(quality.isin(0, 1) & (quality == F.col("other")))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text").between(1, fit_chars))
    ids = short.select("doc_id").hint("merge").join(marked.select("doc_id", "quality"), "doc_id").distinct()
    ids = written(ids, "quality-labelled")
    of = {r.doc_id: r.quality for q in (0, 1) for r in ids.where(quality == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()}
    forget(ids)
    if not of:
        return fit_texts([], [])
    picked = docs.sparkSession.createDataFrame([(i,) for i in sorted(of)], "doc_id long")  # at most 2 * fit_rows ids
    rows = short.join(F.broadcast(picked), "doc_id", "left_semi").collect()
    rows = sorted({(r.doc_id, r.text) for r in rows})
    return fit_texts([t for i, t in rows if of[i] == 1], [t for i, t in rows if of[i] == 0], **kw)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, difference, ratio and score for each row of docs; whole texts, null as empty (difference 0, ratio 1).

    Repeated rows score alike, rows without a doc_id have a null one, an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        using = model.compressors()
        for b in batches:
            f = [model.figures(t, using) for t in b.column(1).to_pylist()]
            cols = [[x for x, _ in f], [r for _, r in f], [model.score(*x) for x in f]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in cols)], ["doc_id", "difference", "ratio", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, difference double, ratio double, score double")


def keep_good(docs: DataFrame, model: CompressionModel, threshold: float) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with all their columns."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        using = model.compressors()
        for b in batches:
            yield b.filter(pa.array([model.score(*model.figures(t, using)) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
