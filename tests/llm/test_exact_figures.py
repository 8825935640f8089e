"""Scores against plain computations, fits that don't depend on a sample's luck, and rows that a short hash would lose."""

import math

import numpy as np
import zstandard
from pyspark.sql import functions as F

from folioscan.llm import exact_dedup, language, ngram_join, quality


def test_language_predictions_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    stems = {"aa": "the of and in".split(), "bb": "der die und éin".split(), "cc": "le la et des".split()}
    rows = [(k * 100 + i, " ".join(rng.choice(w, 12)) + " " + "".join(rng.choice(list("abcdeé"), 5)), lang) for k, (lang, w) in enumerate(stems.items()) for i in range(20)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "1 2", None), (None, "the of", None), (903, "la la", None), (903, "la la", None)]
    docs = spark.createDataFrame([(d, t, lang, "x") for d, t, lang in rows], "doc_id long, text string, lang string, score string").repartition(3)
    known = language.prototypes(docs, "lang", F.col("doc_id") % 2 == 0)
    table = language.letters(512, 7).astype(int)

    def vector(text):
        s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        slot = [0 if c == " " else 1 + ord(c) % (language.SLOTS - 1) for c in f" {' '.join(s.split())} "]
        return sum((np.roll(table[a], 2) * np.roll(table[b], 1) * table[c] for a, b, c in zip(slot, slot[1:], slot[2:], strict=False)), np.zeros(512, int)) if s.strip() else None

    sums = {}
    for d, t, lang in rows:
        v = vector(t)
        if lang and d is not None and d % 2 == 0 and v is not None:
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    want = []
    for d, t, _ in rows:
        v = vector(t)
        cosines = {n: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for n, p in sums.items()} if v is not None else {"und": 0}
        best = min(cosines, key=lambda n: (-cosines[n], n))
        want.append((d, best, round(max(0.0, cosines[best]), 6)))
    got = [(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language.predict(docs, known).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert language.predict(docs.limit(0), known).count() == 0


def test_quality_scores_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    text = lambda a, n: " ".join("".join(rng.choice(list(a), 4)) for _ in range(n))
    good, bad = [text("abcdefgh", 60) for _ in range(40)], [text("ABef!?", 60) for _ in range(40)]
    model = quality.fit_texts(good, bad)
    rows = [(i, t) for i, t in enumerate([good[0], bad[0], text("abef", 900), "é" * 700, "", None, "x"])] + [(None, good[1]), (1, good[1])]

    def plain(t):
        data = (t or "").encode()
        sizes = []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[i : i + model.piece])) for i in range(0, len(data), model.piece)))
        x = ((sizes[1] - sizes[0]) / sum(sizes), sum(sizes) / 2 / len(data)) if data else (0.0, 1.0)
        return 1 / (1 + math.exp(-(model.slopes[0] * x[0] + model.slopes[1] * x[1] + model.offset)))

    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, score string").repartition(2)
    got = sorted(((r.doc_id, round(r.score, 9)) for r in quality.score(docs, model).collect()), key=str)
    assert got == sorted(((d, round(plain(t), 9)) for d, t in rows), key=str)
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_leaves_out_ids_with_both_labels_before_it_samples(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(67)] + [(i, "long " * 5000) for i in range(100, 180)], "doc_id long, text string")
    labels = [(i, 1) for i in range(60)] + [(i, 0) for i in range(53, 67)] + [(i, 1) for i in range(100, 180)] + [(1, 5)]
    seen = []
    keep, quality.fit_texts = quality.fit_texts, lambda good, bad, **kw: seen.append((good, bad))
    try:
        quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True), fit_rows=7)
    finally:
        quality.fit_texts = keep
    ids = [[int(t.split()[1]) for t in part] for part in seen[0]]
    assert len(ids[0]) == len(ids[1]) == 7 and set(ids[0]) <= set(range(53)) - {1} and set(ids[1]) == set(range(60, 67))


def test_rows_that_share_a_short_hash_are_kept(spark, monkeypatch):
    """With every 64-bit row hash the same, exact dedup and the near-duplicate stage drop the same rows."""
    rows = [(1, "one text"), (2, "one text"), (3, "another"), (4, None), (5, ""), (5, ""), (None, "alone"), (6, "same id"), (6, "other text")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, loc string").repartition(3)
    want = sorted([(2, "one text"), (3, "another"), (5, ""), (None, "alone"), (6, "same id"), (6, "other text")], key=str)
    monkeypatch.setattr(exact_dedup, "locator", lambda d, doc_id="doc_id", text="text": F.lit(7).cast("long"))
    assert sorted(((r.doc_id, r.text) for r in exact_dedup.keep_first_copies(docs).collect()), key=str) == want
    words = " ".join(f"w{i}" for i in range(40))
    near = spark.createDataFrame([(1, words), (2, words + " x"), (2, "other words " * 9), (3, words), (None, words), (4, None), (4, "")], "doc_id long, text string").repartition(2)
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in ngram_join.keep_one(near).collect()), key=str) == sorted([(1, "w0 w1"), (2, "other"), (4, ""), (4, "")], key=str)
