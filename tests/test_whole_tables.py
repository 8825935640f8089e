"""Registered queries on tables larger than any fixed cut, against plain Python."""

import hashlib

from folioscan import plans


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_continued_chain_takes_every_document(spark, tmp_path):
    rows = [(i, f"text {i // 3 % 700}", "en", f"s{i % 4 // 2}" if i < 1500 else f"s{i % 3}", 0) for i in range(2501)]
    got = sorted(tuple(r) for r in plans.QUERIES["W3_continued_chain"](spark, documents(spark, tmp_path, rows)).collect())
    last, want = {}, []
    for i, text, _, source, _ in rows:
        h = hashlib.md5(text.encode()).hexdigest()
        n, before = last.get(source, (0, None))
        if h != before:
            last[source] = (n + 1, h)
            want += [(source, i, n + 1)] if i > 1250 else []
    assert got == sorted(want) and max(i for _, i, _ in got) > 1000


def test_keywords_count_in_the_whole_text(spark, tmp_path):
    late = "plain words only. " * 40
    rows = [(6, late, "en", "s", 0), (7, late + "cyber risk", "en", "s", 0), (15, late + "outsourcing and cyber risk", "en", "s", 0), (13, "cyber", "en", "s", 0)]
    got = {r.doc_id: (r.by_substring, r.by_word) for r in plans.QUERIES["F25_F26_F27_F28_F30_classify"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {6: (False, False), 7: (True, False), 15: (True, True), 13: (True, False)}


def test_every_question_is_asked(spark, tmp_path, monkeypatch):
    n, dim = 230, 4
    vectors = [[float((i * 37 + j * 11) % 101) for j in range(dim)] for i in range(n)]
    d = documents(spark, tmp_path, [(i, f"common word{i}", "en", "s", 0) for i in range(n)])
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, f"word{i} common") for i in range(30)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, f"n{i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    want = set()
    for i, a in enumerate(vectors):
        near = sorted((round(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5, 6), j) for j, b in enumerate(vectors))
        want |= {(i, j, k) for k, (_, j) in enumerate(near[:30])} if i % 100 == 0 else set()
    ask = lambda name: plans.QUERIES[name](spark, d).collect()
    assert {tuple(r) for r in ask("T6_W12_dense")} == want
    monkeypatch.setattr("folioscan.operators.retrieval.MOST_QUESTIONS", 2)
    assert {tuple(r) for r in ask("T6_W12_dense")} == want
    for name, k in (("A11_T9_U5_fusion", 30), ("P9_T8_J13_F57_retrieve", 30), ("J16_expand", n), ("J14_citations", n)):
        assert {r.question_id for r in ask(name)} == set(range(k)), name
