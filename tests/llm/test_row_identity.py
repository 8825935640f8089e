"""Rows that share a doc_id keep their own results."""

import zlib
from collections import Counter

from folioscan.llm import katz, substring_dedup

A, B = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")


def test_substring_dedup_of_repeated_ids(spark):
    rows = [(3, A), (5, A), (5, B), (5, B), (None, "c d"), (7, B + " z")]
    want = [(None, 2, 0), (3, 30, 0), (5, 30, 0), (5, 30, 0), (5, 30, 30), (7, 31, 30)]
    for data in (rows, rows[::-1]):
        got = substring_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got), key=lambda r: (r[0] or 0, *r[1:])) == want


def test_katz_scores_of_repeated_ids(spark):
    rows = [(i, f"a b c d{i % 4} a b") for i in range(30)] + [(3, "x y"), (3, "x y"), (3, "a b c"), (None, "b a"), (None, "a"), (10, None)]
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    words = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            words.update([*(t or "").split(), "</s>"])
    want = Counter((i, len((t or "").split()) + 1, sum(words[w] > 0 for w in [*(t or "").split(), "</s>"])) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known) for r in got) == want
    assert len({r.score for r in got if r.doc_id == 3}) == 3  # two equal rows and two others
    again = katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(round(r.score, 9) for r in again) == sorted(round(r.score, 9) for r in got)  # rounds change nothing
