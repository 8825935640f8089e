"""Scores against a direct Katz model of any order, whose probabilities add up to one after every context."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscan.llm import katz


class Direct:
    def __init__(self, train, order):
        self.words = Counter(w for t in train for w in [*t, "</s>"])
        self.grams = {k: Counter() for k in range(2, order + 1)}
        for t in train:
            s = ["<s>", *t, "</s>"]
            for k in self.grams:
                self.grams[k].update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
        self.after = {}
        for k, grams in self.grams.items():
            for g, c in grams.items():
                self.after.setdefault(g[:-1], {})[g[-1]] = c
        self.d = {1: katz.discounts(Counter(self.words.values())), **{k: katz.discounts(Counter(g.values())) for k, g in self.grams.items()}}
        n = sum(self.words.values())
        seen = sum(self.d[1].get(c, 1) * c for c in self.words.values())
        self.scale = 1 / n if seen < n - 1e-9 else 1 / (n + 1)
        self.unknown = 1 - seen * self.scale
        self.known = {}

    def p(self, w, context=()):
        if not context:
            c = self.words.get(w, 0)
            return self.d[1].get(c, 1) * c * self.scale if c else self.unknown
        if context not in self.after:
            return self.p(w, context[1:])
        if context not in self.known:
            less = {x: self.d[len(context) + 1].get(c, 1) * c for x, c in self.after[context].items()}
            n, mass = sum(self.after[context].values()), sum(less.values())
            n = mass + 1 if 1 - mass / n < 1e-9 else n
            self.known[context] = {x: v / n for x, v in less.items()}, (1 - mass / n) / (1 - sum(self.p(x, context[1:]) for x in less))
        kept, alpha = self.known[context]
        return kept[w] if w in kept else alpha * self.p(w, context[1:])

    def score(self, t, order):
        s = ["<s>", *t, "</s>"]
        return sum(math.log10(self.p(s[i], tuple(s[max(0, i - order + 1) : i]))) for i in range(1, len(s)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_scores_match_a_direct_model(spark, order):
    rng = np.random.default_rng(3)
    weight = 1 / np.arange(1, 61)
    rows = [" ".join(f"w{x}" for x in rng.choice(60, 3 + i, p=weight / weight.sum())) for i in range(70)]
    rows += ["once seen pair of words", "w0 w1 w2 w3 w0 w1 w2 w4", "unseen", "", None, rows[5]]
    got = {r.doc_id: r.score for r in katz.score(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3), order=order).collect()}
    texts = {i: (t or "").split() for i, t in enumerate(rows)}
    model = Direct([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], order)
    assert {k: v for k, v in model.d[2].items() if v < 1}, "the fixture has discounts"
    for context in [c for c in model.after if len(c) < order]:
        assert abs(sum(model.p(w, context) for w in [*model.words, "not a word"]) - 1) < 1e-9
    for i, t in texts.items():
        assert abs(got[i] - model.score(t, order)) < 1e-6, (i, got[i], model.score(t, order))


def test_spread_contexts_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * (i % 3) + f"a b x{i % 7} a b a b d{i}") for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(katz, "SHARE", 1)
    one = {r.doc_id: r.score for r in katz.score(docs).collect()}
    monkeypatch.setattr(katz, "SHARE", 20)
    monkeypatch.setattr(katz, "PART_WORDS", 30)
    monkeypatch.setattr(katz, "ROUND_WORDS", 100)
    many = {r.doc_id: r.score for r in katz.score(docs).collect()}
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-6 for i in one)
