"""Cross-tokenizer alignment against whole-text encoding and overlaps by comparison of byte ranges."""

import hashlib
import random
from collections import Counter

from folioscan.llm import alignment
from folioscan.llm.tokens import tokenizer_path

ODD = [None, "", " ", "  ", "\n", "a\n\nb", "x▁y", "<s>hi</s> <|endoftext|>", "café naïve x 　 y", "é \n \n.\n , a.b c,d...", "\x00 z", "é ﬁ 😀 k", "á b", "wordÃ Ã q", "-- ** '' don't we'll I'M", "tab\tx \t y\r\nz", "a" * 3000, "trail  ", "one\n", "12 34,5.6 7"]


def spans(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + sizes[i], i))
        at += sizes[i]
    return out


def brute(rows):
    encode, links, found = alignment.PairEncoder(tokenizer_path("byte_bpe_50k.json"), alignment.piece_path()), Counter(), []
    for doc_id, text in rows:
        a, b = (spans(ids, encode.sizes[side]) for side, ids in enumerate(encode.whole(text or "")))
        own = [(x, y) for s, e, x in a for t, f, y in b if s < f and t < e]
        links.update(own)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        ids = lambda side, lo, hi: ",".join(str(x) for s, e, x in side if lo <= s and e <= hi)
        groups = [f"{ids(a, lo, hi)}|{ids(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((doc_id, len(a), len(b), len(cuts), own, ";".join(groups)))
    top = Counter()
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    key = lambda r: (r[0] is None, *r[:1], *map(str, r[1:]))
    return sorted(((d, na, nb, ng, len(own), sum(links[p] == top[p[1]] for p in own), sum(links[p] for p in own), g) for d, na, nb, ng, own, g in found), key=key), key


def test_alignment_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    letters = "ab \n.,é'’1  ß!XÃ e"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(90)))) for i in range(80)]
    rows += [(7, "shared id"), (7, "shared id"), (None, "no id at all")]
    rows += [(r.doc_id, r.text[:500]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    docs = spark.createDataFrame([(f"x{i}", d, t) for d, t in rows for i in [0]], "groups string, doc_id long, text string").repartition(3)
    want, key = brute(rows)
    assert sorted(map(tuple, alignment.align(docs).collect()), key=key) == want
    monkeypatch.setattr(alignment, "BATCH_TEXT", 64)  # many batches, whose pairs are counted together
    got = {tuple(r) for r in alignment.align(docs, digest=True).collect()}
    assert got == {(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in want}
    assert alignment.align(docs.limit(0)).count() == 0


def test_units_give_what_whole_texts_give():
    encode = alignment.PairEncoder(tokenizer_path("byte_bpe_50k.json"), alignment.piece_path())
    assert encode.by_unit
    import pyarrow as pa

    from folioscan.llm.text import text_bytes

    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aZé \n\r\t .,;!?'0-_ßÿ\xa0") for _ in range(60)) for _ in range(300)]
    (a, na), (b, nb) = encode(*text_bytes(pa.array(texts)))
    whole = [encode.whole(t or "") for t in texts]
    assert a.tolist() == [x for w in whole for x in w[0]] and b.tolist() == [x for w in whole for x in w[1]]
    assert na.tolist() == [len(w[0]) for w in whole] and nb.tolist() == [len(w[1]) for w in whole]
    encode.by_unit = False
    (a2, na2), (b2, nb2) = encode(*text_bytes(pa.array(texts)))
    assert (a2.tolist(), na2.tolist(), b2.tolist(), nb2.tolist()) == (a.tolist(), na.tolist(), b.tolist(), nb.tolist())
