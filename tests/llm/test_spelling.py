"""Spelling variants against comparison of all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from folioscan.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 2 * n else None, len(near))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, counts[w], k, counts[form] if form else None))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_variants_match_all_pairs(spark):
    rng = random.Random(2)
    counts = {}
    for stem in ("colour", "über", "éclair", "anagrams", "aaaaa", "the same few letters"):
        for _ in range(40):
            w = list(stem)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "a", "é", "r", "漢"])
            rng.random() < 0.2 and rng.shuffle(w)
            counts["".join(w)] = rng.choice([1, 3, 3, 4, 8, 20, 50])
    counts.pop("", None)
    counts |= {"long" * 2000: 9, "long" * 2000 + "e": 3}
    table = spark.createDataFrame([(w, n, n) for w, n in counts.items()], "word string, n int, longer int").repartition(3)
    assert rows_of(spelling.variants(table)) == sorted(brute(counts), key=str)
    assert spelling.variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(table, ratio=1)


def test_words_of_documents(spark):
    rng = random.Random(3)
    stems = ["Colour", "colours", "ÉTAIT", "était", "naïve", "Straße", "ab", "x×y÷z"]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(60))) for i in range(40)] + [(1, None), (2, ""), (3, "123 -- 456"), (None, "Colour colours"), (5, "same"), (5, "same")]
    want = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    got = Counter(r.word for r in spelling.spelled_words(docs).collect())
    assert got == want and sum(len(w) == len("colour") - 1 for w in got) > 0
    assert rows_of(spelling.variant_groups(docs)) == sorted(brute({w: n for w, n in want.items() if len(w) >= 5 and n >= 3}), key=str)


def test_hot_signature_keeps_all_links(spark):
    """A third of all words share one half and their letters; links between them are all found."""
    counts = {f"stem{a}{b}{c}": 3 for a in "abcdef" for b in "abcdef" for c in "abcdef"} | {f"other{i:03d}": 3 for i in range(100)}
    got = {r.word: r.n_near for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert all(got[w] == sum(one_edit(w, x) for x in counts) for w in counts)
