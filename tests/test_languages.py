"""N-gram rank profiles against plain counting, and the edge cases of detection."""

from collections import Counter

from pyspark.sql import functions as F

from folioscan.operators import languages


def test_profiles_and_distances(spark):
    rows = [(i, t, lang) for lang, ts in {"aa": ["the cat and the hat", "and then"], "bb": ["der hut und die katze", "und dann"]}.items() for i, t in enumerate(ts)]
    rows += [(8, None, "aa"), (9, "x", None), (10, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = languages.profiles(languages.learn(docs))
    for lang in ("aa", "bb"):
        counts = Counter()
        for _, t, own in rows:
            if own == lang and t:
                counts.update(languages.ngrams(t))
        assert list(known[lang]) == [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: languages.PROFILE]]
    assert languages.ngrams("Ab, b2")["b "] == 2 and languages.ngrams("1 _ 2") == Counter()
    asked = spark.createDataFrame([(1, "the hat"), (2, "die katze"), (3, None), (4, "12 - 3"), (5, " " * 2500 + "the")], "id int, text string")
    got = {r.id: r.f for r in asked.select("id", languages.detect(F.col("text"), known).alias("f")).collect()}
    assert got == {1: "aa", 2: "bb", 3: None, 4: None, 5: None}
    assert languages.profiles(languages.learn(docs.limit(0))) == {} and languages.nearest("the", {}) is None
