"""Personal data: strict spans against the plain patterns, the model on planted texts, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_strict_spans_match_the_plain_patterns(spark):
    rng = random.Random(1)
    texts = ["", "a@b@c.d.e@f.g", "@x.y", "a@b..c", "1.2.3.4.5.6.7.8", "0001.2.3.4 256.1.1.1", "+1 (017) 555-7713 +12", "4012 8888-8888 1881x", "é a.b@c.d٣", "a@b.c_d@e.f", "+1+2 345 678 90", "a" * 3000 + "@" + "b" * 3000]
    texts += ["".join(rng.choice("a.b@1 2-3+4(5)0,é\n") for _ in range(60)) for _ in range(3000)]
    texts += ["".join(rng.choice("12 0-") for _ in range(40)) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t in texts:
        assert pii.strict_spans(t) == brute(t), t[:200]
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "." * 400_000, "a" * 200_000 + "@b"):  # no match takes time with the square
        pii.strict_spans(t)
        assert len(list(pii.proposals(t))) < 20 * len(t)


def planted(n=1200):
    rng, rows = random.Random(7), []
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for i in range(n):
        card = num(15)
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        thing = [f"ann{num(2)}@mail{num(1)}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.3.{rng.randrange(256)}", card, f"+1 ({num(3)}) 555-{num(4)}", num(16), f"{num(5)}, {num(9)}"][i % 6]
        rows.append((i, f"some words {thing} and more of them"))
    return rows


def test_model_adds_other_spellings_and_leaves_clean_texts_alone(spark):
    extra = [(5000, "write to ann12 (at) mail3.example.com now"), (5001, "call +1 (171) 5, 55-2028 now"), (5002, None), (5003, ""), (5004, "plain prose only, 12 of 345"), (5005, "on 2024-01-02 12:30:45 at 10.50"), (None, "ann12@mail3.example.com"), (5006, "x 1.2.3.4 y"), (5006, "x 1.2.3.4 y")]
    rows = planted() + extra
    docs = spark.createDataFrame([(t, d, "e") for d, t in rows], "text string, doc_id long, base string").repartition(3)
    model = pii.fit(docs, F.col("doc_id") < 5000)
    found = pii.counts(pii.find(docs, model)).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r for r in found}
    assert of[5000].spans == "email:9:37" and of[5000].n_email == 0 and of[5001].spans == "phone:5:24"
    assert [of[k].spans for k in (5002, 5003, 5004, 5005)] == [""] * 4 and of[5002].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert of[None].spans == "email:0:23" and sum(r.doc_id == 5006 for r in found) == 2
    for d, t in planted():
        base = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(t)]
        assert of[d].spans == ",".join(base) and of[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [of[d].n_email, of[d].n_ip, of[d].n_card, of[d].n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
    again = pii.fit(docs.repartition(5), F.col("doc_id") < 5000)
    assert model.thresholds == again.thresholds and np.array_equal(model.trees.leaf, again.trees.leaf)
    red = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert red[5000] == "write to [email] now" and red[5002] is None and red[5004] == extra[4][1] and red[0] == "some words [email] and more of them"


def test_without_strict_spans_nothing_is_added(spark):
    docs = spark.createDataFrame([(1, "no data here 123456789"), (2, None)], "doc_id long, text string")
    model = pii.fit(docs)
    assert min(model.thresholds) > 1 and {r.spans for r in pii.counts(pii.find(docs, model)).collect()} == {""}
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = pii.boosted(x[:3000], y[:3000], np.ones(3000))
    assert ((trees(x[3000:]) > 0) == (y[3000:] == 1)).mean() > 0.95


def test_the_model_is_one_of_all_candidates(spark):
    """More than 10,000 candidates of either label, against the trees and counts of all of them in plain Python."""
    rows = planted(5000) + [(k, f"on 2024-01-{k % 28 + 1:02d} 12:30:{k % 60:02d} order {k * 7919 % 10**9}") for k in range(5000, 9000)]
    seen = []
    for d, text in rows:
        for x, y, real in pii.examples(text, pii.strict_spans(text)):
            x32 = np.array(x, np.float32).tobytes()
            held = int.from_bytes(hashlib.blake2b(x32 + str(d).encode(), digest_size=8).digest(), "big", signed=True) % 3 == 0
            seen.append((x, y, real, held))
    y, real, held = (np.array(c) for c in list(zip(*seen, strict=True))[1:])
    x = np.array([s[0] for s in seen], np.float64)
    assert min(np.bincount(y)) > 10_000
    trees = pii.boosted(x[~held], y[~held].astype(float), np.ones(int((~held).sum())))
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert np.array_equal(model.trees.leaf, trees.leaf) and np.array_equal(model.trees.cut, trees.cut) and np.array_equal(model.trees.at, trees.at)
    p, kind = model.probability(x[held]), x[held][:, 0]
    for k, least in enumerate(model.thresholds):  # the lowest level from which on enough are right, by counting
        of, best = (kind == k) & real[held], 2.0
        if (of & (y[held] == 1)).sum() >= 20:
            for level in sorted({0.9, *p[(kind == k) & (p > 0.9)].tolist()}, reverse=True):
                hits, false = ((of & (y[held] == v) & (p >= level)).sum() for v in (1, 0))
                if hits and hits >= 0.98 * (hits + false):
                    best = level
        assert least == best


def test_no_decoy_is_what_the_rules_find():
    for k in range(200):
        card = f"{4000_0000_0000_000 + k * 7919}"
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        text = f"some words {card} and more of them"
        spans = pii.strict_spans(text)
        good = pii.features(text, *spans[0])
        assert [s[1] for s in spans] == [pii.CARD] and all(x != good for x, y, _ in pii.examples(text, spans) if y == 0)


def test_one_wrong_candidate_at_the_top_does_not_end_a_kind():
    at, n = np.array([3000, 2000, -2000]), np.array([1, 400, 400])
    model = pii.calibrated(pii.Trees(), np.full(3, pii.CARD), np.array([0, 1, 0]), np.full(3, True), at, n, 0.98, 0.9)
    assert model.thresholds == (2.0, 2.0, 0.9, 2.0) and model.curve(at)[0] > model.curve(at)[1] > 0.9


def test_trees_grow_alike_on_the_driver_and_on_spark(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, (900, pii.N_FEATURES)).astype(float)
    y, n = ((x[:, 0] > 20) ^ (x[:, 5] > 41)).astype(float), rng.integers(1, 9, 900).astype(float)
    edges = [pii.quantile_edges(np.unique(c), np.bincount(np.unique(c, return_inverse=True)[1], n), pii.BINS) for c in x.T]
    assert all(np.allclose(e, np.unique(np.quantile(np.repeat(c, n.astype(int)), np.linspace(0, 1, 33)[1:-1]))) for e, c in zip(edges, x.T, strict=True))
    b = pii.binned(x, edges)
    one = pii.grow(pii.Here(b, y, n, 0.1), edges, 0.1, rounds=5)
    table = spark.createDataFrame([(bytearray(r.tobytes()), int(v), int(m)) for r, v, m in zip(b, y, n, strict=True)], "bins binary, y int, n long")
    two = pii.grow(pii.Spread(table, 0.1, 3, every=2), edges, 0.1, rounds=5)
    assert np.array_equal(one.leaf, two.leaf) and np.array_equal(one.cut, two.cut) and np.array_equal(one.at, two.at)
    again = pii.boosted(np.repeat(x, n.astype(int), 0), np.repeat(y, n.astype(int)), np.ones(int(n.sum())), rounds=3)
    first = pii.boosted(x, y, n, rounds=3)
    assert np.array_equal(again.leaf, first.leaf) and np.array_equal(again.cut, first.cut)


@pytest.mark.parametrize("span,kind", [("a.b@c.example.com", 0), ("1.2.3.4", 1), ("4012888888881881", 2), ("+1 (017) 555-7713", 3)])
def test_other_ways_keep_the_digits(span, kind):
    for seed in range(40):
        for way in pii.other_ways(span, kind, seed):
            assert re.sub(r"[^0-9]", "", way).removeprefix("00") in (re.sub(r"[^0-9]", "", span), re.sub(r"[^0-9]", "", span)[1:]) or kind == 0
