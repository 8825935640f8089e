"""Postings of an index: counted within rows, as the plain count; reading an index without tombstones shuffles nothing."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from folioscan.operators import index_store, indexing, inference, retrieval
from folioscan.plans import text_queries

CATALOG = "entity_id long, stage string, topic boolean, kinds array<string>"


def test_postings_are_counted_within_rows_and_kept_by_version(spark, tmp_path):
    texts = ["a b a", "Ä ä. b", "", " . ", None, "one", "z y x " * 500]
    chunks = spark.createDataFrame([(i, i // 2, t) for i, t in enumerate(texts)], "chunk_id long, version_id long, text string")
    p = indexing.index_postings(chunks)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    want = retrieval.postings(chunks).select("chunk_id", F.floor(F.col("chunk_id") / 2).alias("version_id"), "term", "tf", "n_terms")
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, index_store.postings_of(index_store.blocks(p)).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_an_index_without_tombstones_is_read_as_it_is(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    versions = spark.createDataFrame([(v, v % 3, "word text " * 300 + str(v), v == 5) for v in range(12)], "version_id long, entity_id long, text string, protected boolean")
    catalog = spark.createDataFrame([(0, "A", True, ["K"]), (1, "B", False, None)], CATALOG)
    index_store.build(root, versions, catalog, inference.hash_embedding, 0, overlap=0)
    live = index_store.live(spark, root, "chunks")
    assert "Join" not in live._jdf.queryExecution().executedPlan().toString()
    got = {(r.version_id, r.entity_id, r.stage) for r in live.collect()}
    assert got == {(v, v % 3, {0: "A", 1: "B"}.get(v % 3)) for v in range(12) if v != 5}
    index_store.reindex(root, versions.where("entity_id = 1").withColumn("text", F.lit("new")), catalog, versions.where("entity_id = 1"), inference.hash_embedding, overlap=0)
    ask = lambda: sorted((r.version_id, r.text) for r in index_store.live(spark, root, "chunks").collect())
    few = ask()
    assert [t for v, t in few if v % 3 == 1] == ["new"] * 4 and len(few) > 8
    monkeypatch.setattr(index_store, "MOST_TOMBSTONES", 1)
    assert ask() == few


def test_an_index_keeps_no_second_copy_and_counts_blocks(spark, tmp_path):
    root, merged = str(tmp_path / "index"), str(tmp_path / "merged")
    versions = spark.createDataFrame([(v, v % 3, "word text text " * 300 + str(v), v == 5) for v in range(12)], "version_id long, entity_id long, text string, protected boolean")
    catalog = spark.createDataFrame([(0, "A", True, ["K"]), (1, "B", False, None)], CATALOG)
    index_store.build(root, versions, catalog, inference.hash_embedding, 0, overlap=0)
    index_store.reindex(root, versions.where("entity_id = 1").withColumn("text", F.lit("new text")), catalog, versions.where("entity_id = 1"), inference.hash_embedding, overlap=0)
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.is_dir()) == ["chunks", "postings", "tombstones", "vectors"]
    index_store.merge(spark, root, merged)
    rows = [sorted(map(str, index_store.live(spark, r, "postings").drop("generation").collect())) for r in (root, merged)]
    assert rows[0] == rows[1] and rows[0]
    per = text_queries._per_term(SimpleNamespace(spark=spark), merged)
    got = {r.term: (r.n, r.n_versions) for r in per.collect()}
    assert got["word"] == (300 * 7, 7) and got["text"] == (600 * 7 + 4, 11) and got["new"] == (4, 4) and "1" not in got and got["11"] == (1, 1)
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert "version_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_a_stored_search_shuffles_no_row_for_a_question_and_chunk(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    texts = [" ".join(f"w{i * j % 17}" for j in range(1, 3 + i % 9)) for i in range(60)]
    versions = spark.createDataFrame([(v, v % 3, x, False) for v, x in enumerate([*texts, texts[0], " "])], "version_id long, entity_id long, text string, protected boolean")
    index_store.build(root, versions, spark.createDataFrame([], CATALOG), inference.hash_embedding, 0, overlap=0)
    chunks = index_store.live(spark, root, "chunks")
    corpus = chunks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_len"))
    questions = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w0 none w5 w7"), (3, ""), (4, "none")], "question_id long, text string")
    want = retrieval.ranked(index_store.postings_of(index_store.live(spark, root, "postings")), corpus, questions, 10).collect()
    assert len(want) == 20
    for cells in (retrieval.CELLS, 8):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        got = index_store.search(spark, root, questions, 10)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "question_id" in x and "chunk_id" in x]
    assert index_store.search(spark, root, questions.where("question_id > 2"), 10).isEmpty()
    assert index_store.search(spark, root, questions.limit(0), 10).isEmpty()
