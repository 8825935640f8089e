"""Headings, segments and chunks of whole texts against hand-made cases and what must hold for any text."""

import random

from folioscan.operators import chunking

CASES = {
    "Article 1": [],
    "a.\nArticle 1 x\n  Chapter II\nfoo\n§ 3 bar": [(1, [], "a."), (4, ["Article 1 x"], "Article 1 x\n  Chapter II\nfoo")],
    "intro.\nChapter I Scope.\nArticle 1 A.\nbody.\nArticle 2 B\nend.\nTitle IV\nlast": [(1, [], "intro."), (25, ["Chapter I Scope.", "Article 1 A."], "Article 1 A.\nbody."), (44, ["Chapter I Scope.", "Article 2 B"], "Article 2 B\nend."), (61, ["Title IV"], "Title IV\nlast")],
    "one\n\nArticle 1 x\ny\n\ntwo.\nArticle 2 z\n\nthree": [(1, [], "one"), (6, ["Article 1 x"], "Article 1 x\ny\n\ntwo.\nArticle 2 z\n\nthree")],
    "": [],
    " \n ": [],
}


def test_segments_of_cases(spark):
    rows = [(i, t, "k") for i, t in enumerate(CASES)] + [(99, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(2)
    got = [(r.doc_id, r.pos, r.path, r.body) for r in chunking.segments(docs, "doc_id").orderBy("doc_id", "pos").collect()]
    assert got == [(i, *s) for i, found in enumerate(CASES.values()) for s in found]


def test_chunks_keep_all_words_and_need_no_shuffle(spark):
    rng = random.Random(1)
    words = ["alpha", "beta.", "Article 2 rules", "Chapter III", "\n", "\n\n", "x" * 90, "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(400))), "m") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, meta string").repartition(3)
    out = chunking.chunk(docs, "doc_id", meta="meta", tokens=40, overlap=0)
    assert "Exchange" not in chunking.chunk(spark.createDataFrame(rows, docs.schema), "doc_id")._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        mine = got.get(i, [])
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        assert all(len(r.text) <= 160 for r in mine)
        segments = " ".join(b for _, _, b in chunking.text_segments(t))
        assert "".join("".join(r.text.split()) for r in mine).replace(".", "") == "".join(segments.split()).replace(".", "")
