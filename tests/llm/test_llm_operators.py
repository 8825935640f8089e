"""Every operator against a brute-force version on a small fixture with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan.llm import embedding_dedup, exact_dedup, huffman, katz, language, mixing, ngram_join, packing, quality, substring_dedup, text, tokens
from folioscan.llm.store import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, part int, size string"
EXTRA = ("x", 7, "y")


def texts() -> list[tuple]:
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(40):
        out.append(" ".join(rng.choice(words, 60 + i)))
    base = out[0].split()
    for k in range(6):  # near copies
        w = list(base)
        w[k * 3] = f"changed{k}"
        out.append(" ".join(w))
    out += [out[1], out[1], out[2].upper(), None, "", "  \n ", "one", "one two\tthree", "x " * 6000, " ".join(out[3].split()[:30] + out[4].split()[:30])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0 if t is None else len(t), *EXTRA) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return (t or "").encode().split()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_word_hashes_tell_words_apart():
    col = pa.array(["a b", None, "", "a  b\n", "ab", "b a é"])
    data, off = text.text_bytes(col)
    start, end, first = text.words(data, off)
    h = text.word_hashes(data, start, end)
    assert np.diff(first).tolist() == [2, 0, 0, 2, 1, 3]
    assert h[0] == h[2] == h[6] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 4
    w = text.windows(h, 2)
    assert w[0] == w[2] and text.inside(first, 2).tolist() == [True, False, True, False, False, True, True]


def test_exact_dedup(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups = {}
    for i, t in enumerate(texts()):
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_compares_bytes_when_digests_collide(docs):
    weak = exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    full = exact_dedup.exact_dedup(docs)
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, full.collect()))


def test_exact_dedup_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(d).collect()
    assert sum(r.kept for r in got) == 2 and sorted(r.group_size for r in got) == [1, 3, 3, 3]
    assert exact_dedup.keep_first_copies(d).count() == 2


@pytest.mark.parametrize("few", [10, 0])
def test_exact_dedup_of_null_ids_with_colliding_digests(spark, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "FEW_BYTES", few)  # 0: kept texts are merged with salts
    monkeypatch.setattr(exact_dedup, "SALTED", 2)
    rows = [(None, "aa"), (None, "bb"), (1, "cc"), (2, "cc"), (2, None), (2, ""), (3, "dd")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, loc string, _sha int")
    got = sorted(map(tuple, exact_dedup.exact_dedup(d, digest=lambda t: F.lit("same")).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    want = [(None, None, 1, True), (None, None, 1, True), (1, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (2, 2, 2, False), (3, 3, 1, True)]
    assert got == sorted(want, key=str)
    kept = exact_dedup.keep_first_copies(d)
    assert kept.columns == d.columns and sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id) == [(2, ""), (2, "cc"), (3, "dd")] and kept.count() == 5


def shingles(t):
    w = lower(t).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join(docs, empty):
    sets = [shingles(t) for t in texts()]
    up = list(range(len(sets)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in ngram_join.similar_documents(docs).collect()}
    assert len(got) == len(sets)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id) == (len(s), root(i))
    assert ngram_join.similar_documents(empty).count() == 0


def test_ngram_join_tells_rows_of_one_id_apart(spark):
    x, y = ([f"{c}{i}" for i in range(60)] for c in "xy")
    rows = [(1, " ".join(x)), (7, " ".join([*x[:59], "other"])), (7, " ".join(y)), (9, " ".join([*y, "more"])), (None, " ".join([*y, "no id"])), (None, None), (3, "a b"), (3, "a b")]
    want = [(1, 56, 1), (7, 56, 1), (7, 56, 7), (9, 57, 7), (None, 58, 7), (None, 0, None), (3, 1, 3), (3, 1, 3)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame([(*r, "clash", 1) for r in order], "doc_id long, text string, row string, component int").coalesce(1)
        got = sorted(map(tuple, ngram_join.similar_documents(d).collect()), key=str)
        assert got == sorted(want, key=str)
        kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(d).collect()), key=str)
        assert kept == sorted([rows[0], rows[2], rows[5], rows[6]], key=str) and ngram_join.keep_one(d).columns == d.columns


def test_ngram_join_of_a_group_with_many_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE", 40)  # several trees for a group
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(100)]
    out = []
    for i in range(160):
        w = list(base)
        at = int(rng.integers(0, 87))
        for k in range(at, at + 1 + (i % 4 > 0) * (4 + i % 9)):
            w[k] = f"x{i}-{k}"
        out.append(" ".join(w))
    sets = [shingles(t) for t in out]
    up = list(range(len(sets)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    d = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in ngram_join.similar_documents(d).collect()} == {i: root(i) for i in range(len(sets))}
    assert 3 < len({root(i) for i in range(len(sets))}) < 155


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 4000, rng.integers(20, 60)).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[:-1], [np.uint64(10**6 + i)]])) for i, s in enumerate(sets[:40])]
    tree = ngram_join.SignatureTree(np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets], np.arange(len(sets)), np.full(len(sets), 99))
    found = {tuple(sorted(p)) for i, j in tree.pairs(80) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join._similar(sets[i], sets[j], 80)}
    assert len(want) >= 30 and want <= found and len(found) < 2000


def test_mixing(docs, empty):
    rows = mixing.taken(docs).collect()
    size = {i: len(words_of(t)) for i, t in enumerate(texts())}
    assert {r.doc_id: r["size"] for r in rows} == size
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        s = f"s{r.doc_id % 3}" if r.doc_id % 7 else None
        by.setdefault(s, []).append(r)
    total = 0
    for rs in by.values():
        assert len({r.target for r in rs}) == 1 and rs[0].source_size == sum(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1
        total += rs[0].target
    assert abs(total - 1.5 * sum(size.values())) < 1e-6 or total == 2 * sum(size.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken(docs).collect()))
    assert mixing.taken(empty).count() == 0


def test_mixed_texts_hold_the_taken_words(docs):
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    got = {}
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words_of(r.text))
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}


def brute_taken(rows, spec, ends):
    """Words taken of each row, by laying out every word of every source's line and drawing blocks as the quotas say."""
    out = {}
    for s in spec:
        own = sorted((r for r in rows if r.source == s.source and r["size"]), key=lambda r: r.pos)
        line = [r.rid for r in own for _ in range(r["size"])]
        b, w, drawn = s.block, s.whole, s.drawn - s.passes * s.blocks
        for rid in line * s.passes:
            out[rid] = out.get(rid, 0) + 1
        rank = lambda k: w if k == w else (s.step * k + s.shift * (s.passes + 1)) % w  # noqa: E731, B023
        if s.extra >= w:
            picked = list(range(drawn))
        else:
            c = [max(0, e - s.passes * s.blocks) for e in ends[s.sid]]
            picked = [c[i] * w // drawn + k for i in range(len(c) - 1) for k in range(c[i + 1] - c[i])]
        by_rank = {rank(k): k for k in range(s.blocks)}
        for n, r in enumerate(picked):
            words = line[by_rank[r] * b : by_rank[r] * b + b]
            for rid in words[: s.part] if n == s.extra else words:
                out[rid] = out.get(rid, 0) + 1
    return out


def test_mixing_takes_what_the_tree_decides(docs):
    found = {}
    for shards in (4, 16):
        spec, rows, pieces = mixing.mix(docs, shards=shards)
        got = {r.rid: r.n for r in pieces.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
        spec_rows = spec.collect()
        tree = mixing.splitting_tree(spec.agg(F.transform(F.sort_array(F.collect_list(F.struct("sid", "drawn"))), lambda x: x["drawn"]).alias("quotas")), shards, 20)
        ends = {r.sid: r.ends for r in mixing._ends(tree).collect()}
        by_sid = {r.rid: r for r in mixing._lines(rows, spec, 20).select("rid", "sid", "size", "pos").collect()}
        names = {s.sid: s.source for s in spec_rows}
        lines = [type("Row", (dict,), {"__getattr__": dict.__getitem__})(rid=r.rid, source=names[r.sid], size=r["size"], pos=r.pos) for r in by_sid.values()]
        assert got == brute_taken(lines, spec_rows, ends)
        per = {}
        for p in pieces.groupBy("sid", "shard").agg(F.countDistinct("ord").alias("n")).collect():
            per[p.sid, p.shard] = p.n
        assert all(per.get((sid, i), 0) == e[i + 1] - e[i] for sid, e in ends.items() for i in range(shards))
        found[shards] = got
    assert found[4] != found[16]
    with pytest.raises(ValueError):
        mixing.taken(docs, shards=12)


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d", None, 1), (None, "a b c d", None, 2), (5, "e f g", "s", 3), (5, "h", "s", 4), (6, None, "s", 5), (6, "", "t", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _n int").withColumn("_rid", F.lit("x"))
    got = mixing.taken(d).collect()
    assert len(got) == 6 and sum(r.taken for r in got) == 18 and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mixed(d).columns == d.columns and mixing.mixed(d).agg(F.sum(mixing.word_count())).first()[0] == 18


def test_splitting_tree_is_exact(spark):
    leaves = mixing.splitting_tree(spark.createDataFrame([([100, 3, 0, 57],)], "quotas array<long>"), 8, 5).collect()
    q = np.array([r.quotas for r in leaves])
    assert q.sum(0).tolist() == [100, 3, 0, 57] and set(q.sum(1)) <= {20} and (q >= 0).all()


def brute_ids(t):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.tokenizer_path())
    return [*tk.encode(t or "", add_special_tokens=False).ids, 2]


def test_word_encoder_equals_the_tokenizer():
    odd = ["It's İstanbul ŉ <|endoftext|>x Ａ ﬁ ǆ café é a\x1cb ΑΣ. ² ½ 123ab WE'LL 's x's's \u0085  …", "", None, " \n", "😀 ok ﷺ 한국어", "A,b.C! don't", "X.'S <|ENDOFTEXT|> Y", "a.\u0301 A\u0301. é.", "end.", ".Begin", "END. It's.'s"]
    ids, counts = tokens.encoder(tokens.tokenizer_path())(pa.array(odd))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [brute_ids(t) for t in odd]


def test_huffman_round_trip(docs, empty):
    at, got = 0, {r.doc_id: r for r in huffman.round_trip(docs).collect()}
    for i, t in enumerate(texts()):
        ids = brute_ids(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert huffman.round_trip(empty).count() == 0


def test_code_lengths_are_limited_and_complete():
    counts = np.array([2**i for i in range(40)] + [0, 1])
    n = huffman.code_lengths(counts, 12)
    used = n[counts > 0].astype(int)
    assert used.max() <= 12 and n[40] == 0 and sum(2.0**-used) == 1
    assert huffman.code_lengths(np.array([0, 5]))[1] == 1


def test_packing(docs, empty):
    rows = packing.pack(docs, length=256).collect()
    of, seqs = {}, {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in enumerate(texts()):
        ids = [x for r in sorted(of[i], key=lambda r: r.start) for x in r.ids]
        assert ids == brute_ids(t) and {r.doc_tokens for r in of[i]} == {len(ids)}
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    at = packing.hilbert(cells, 3)
    assert sorted(at.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_substring_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 5000
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_language(spark):
    rng = np.random.default_rng(3)
    alphabets = {"aa": "abcdeé", "bb": "mnopqü"}
    rows = [(i, " ".join("".join(rng.choice(list(a), 6)) for _ in range(40)), lang) for lang, a in alphabets.items() for i in range(100 if lang == "bb" else 0, 130 if lang == "bb" else 30)]
    rows += [(900, None, "aa"), (901, "12 !?", "bb"), (902, "abc", None), (903, "日本語", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.prototypes(d, "lang", F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r for r in language.predict(d, known).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang in rows if i < 900)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und") and got[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.predict(d, {}).collect()} == {"und"}
    assert language.predict(d.where("doc_id < 0"), known).count() == 0 and not language.prototypes(d.where("doc_id < 0"), "lang", F.lit(True))


def test_language_vectors_equal_brute_force(monkeypatch):
    monkeypatch.setattr(language, "SPAN", 40)
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcé 1"), n)) for n in (3, 50, 170, 700)] + ["a" * 130 + "bcd" * 40, "", "12 3", "a" * 40 + " " * 90 + "b", "ab " * 90, " " * 200, "x" + "-" * 39 + "y" * 41]
    got, has = language.Encoder(64, 7)(texts)
    table = language.letters(64, 7).astype(int)
    for t, v, h in zip(texts, got, has, strict=True):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = f" {' '.join(s.split())} " if s.split() else " "
        slot = [0 if c == " " else 1 + ord(c) % (language.SLOTS - 1) for c in s]
        want = sum((np.roll(table[a], 2) * np.roll(table[b], 1) * table[c] for a, b, c in zip(slot, slot[1:], slot[2:], strict=False)), np.zeros(64, int))
        assert h == any(c.isalpha() for c in t)
        assert (v == (want if h else 0)).all()


def test_null_ids_are_not_held_out(spark):
    d = spark.createDataFrame([(None,), (1,)], "doc_id long").select((remainder("doc_id", 4) == 2).alias("held_out"))
    assert {r.held_out for r in d.collect()} <= {True, False}


def test_quality(spark):
    rng = np.random.default_rng(4)
    word = lambda a: "".join(rng.choice(list(a), 5))
    rows = [(i, " ".join(word("abcdefgh") if i % 2 else word("VWXYZ") + "!!" for _ in range(80))) for i in range(200)]
    d = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(d, labels, F.col("doc_id") < 120)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(120, 200)) and 0 <= got[500] == got[501] <= 1
    assert quality.keep_good(d, model, 0.7).where("doc_id < 500").count() == 100
    assert quality.fit_texts([], []).score(0, 1) == 0.5


def test_katz_sums_to_one_and_matches_brute_force(docs, empty):
    got = {r.doc_id: r for r in katz.score(docs).collect()}
    toks = {i: [*lower(t).encode().split(), "</s>"] for i, t in enumerate(texts())}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 10]
    c = {}
    for i in train:
        for w in toks[i]:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert abs(r.base_score - sum(np.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6
        assert r.score < 0
    assert katz.score(empty).count() == 0
    assert katz.discounts({}) == dict.fromkeys(range(1, 6), 1.0)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 8))
    near = base[:10] + rng.standard_normal((10, 8)) * 0.03
    vec = [*base.tolist(), *near.tolist(), base[0].tolist(), base[0].tolist(), [0.0] * 8, None, [float("nan")] * 8, [1.0, None] + [0.0] * 6, (base[1] * 3).tolist()]
    label = [i % 2 for i in range(40)] + [i % 2 for i in range(10)] + [0, 1, 0, 0, 0, 0, None]
    d = spark.createDataFrame(list(enumerate(zip(vec, label, strict=True)))).selectExpr("_1 AS vec_id", "_2._1 AS embedding", "_2._2 AS label")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(d).collect()}
    fine = [i for i, (x, y) in enumerate(zip(vec, label, strict=True)) if y is not None and x is not None and None not in x and np.isfinite(x).all() and any(x)]
    links = {i: set() for i in range(len(vec))}
    for i in fine:
        for j in fine:
            a, b = np.array(vec[i]), np.array(vec[j])
            if i != j and label[i] == label[j] and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i].add(j)
    assert sum(map(len, links.values())) > 10
    for i in links:
        comp, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - comp:
                comp.add(j)
                stack.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(comp), i == min(comp))
    assert embedding_dedup.near_vectors(d.where("vec_id < 0")).count() == 0
