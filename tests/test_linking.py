"""Links by pattern tables in several blocks, and snippets around identifiers."""

from folioscan.functions import text as T
from folioscan.operators import linking

DOCS = [(1, "Under CSSF 12/552 and " + "x" * 80 + " 32013L0036 applies; 32013L0036 again"), (2, "nothing here"), (3, None), (4, ""), (5, "32019R0876 and cssf 12/552")]


def test_pattern_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    aliases = spark.createDataFrame([(k, k % 3, p, kind) for k, (p, kind) in enumerate([("cssf 12/552", "EXACT"), (r"3201\d[LR]", "REGEX"), ("here", "EXACT"), ("x+", "REGEX"), ("skip", "OTHER")])], "ord int, entity_id long, pattern string, kind string")
    labels = spark.createDataFrame([(1, "Red Ring"), (2, "blue"), (3, None)], "k long, label string")
    patterns = spark.createDataFrame([("ring", "A"), ("RED", "B"), ("red", "B"), ("green", "C")], "pattern string, slug string")
    ask = lambda: (sorted(map(tuple, linking.link_alias_table(docs, aliases).collect())), sorted((r.k, *r.slugs) for r in linking.match_labels(labels, patterns, "k", "label").collect()))
    one = ask()
    monkeypatch.setattr(linking, "BLOCK_PATTERNS", 1)
    assert ask() == one and one[1] == [(1, "A", "B")]
    assert {r[:2] for r in one[0]} == {(1, 0), (1, 1), (2, 2), (5, 0), (5, 1)}


def test_identifier_links_quote_the_first_place(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    catalog = spark.createDataFrame([(7, "32013L0036"), (8, "32019R0876"), (9, None)], "entity_id long, celex_id string")
    got = {(r.doc_id, r.entity_id): r.snippet for r in linking.link_ids(docs, catalog, T.CELEX, "celex_id", "CELEX_ID").collect()}
    at = DOCS[0][1].index("32013L0036")
    assert got == {(1, 7): DOCS[0][1][at - 60 : at + 70].strip(), (5, 8): "32019R0876 and cssf 12/552"}


def test_automaton_finds_what_the_nested_loop_finds(spark):
    import random

    from pyspark.sql import functions as F

    from folioscan.functions import text as T
    from folioscan.operators import linking

    rng = random.Random(4)
    stems = ["règlement", "DORA", "Straße", "İstanbul", "ſoft", "Kelvin", "a.b", "(x)", "data  act", "é"]
    docs = [(i, " ".join(rng.choice([str.upper, str.lower, str])(rng.choice([*stems, "filler", "word"])) for _ in range(8))) for i in range(120)] + [(900, None), (901, "")]
    aliases = [(k, s, "EXACT", k) for k, s in enumerate(stems)] + [(50 + k, p, "REGEX", 50 + k) for k, p in enumerate([r"r[eè]glement\s+dora", r"data\s+act", r"fil+er", r"word|dora", r"(?:ab)?filler", r"x?y*", r"\bkel.in\b", r"fill{1,2}er", r"\Qa.b\E", r"w(?=o)ord"])] + [(99, "word", "CELEX", 99)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    a = spark.createDataFrame(aliases, "entity_id long, pattern string, kind string, ord int")
    regex = a.withColumn("regex", linking.alias_pattern(F.col("pattern"), F.col("kind"))).where("regex is not null")
    want = d.join(F.broadcast(regex), F.rlike("text", "regex")).select("doc_id", "entity_id", T.snippet(F.col("text"), F.col("regex")).alias("snippet"))
    got = linking.link_alias_table(d, a).select("doc_id", "entity_id", "snippet")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 300
    assert linking.link_alias_table(d, a.limit(0)).count() == linking.link_alias_table(d.limit(0), a).count() == 0


def test_needed_literals():
    from folioscan.operators.linking import needed_literal

    cases = {"abc": "abc", "ab?c": "a", "abc+d": "abc", "a|b": "", "(ab)cde": "cde", "[ab]cd": "cd", r"\bword\b": "word", "x{0,2}yz": "yz", "a(b|c)dd": "dd", "": "", "ab*cd": "cd", r"the\s+and": "the", "(?x)a b": "", r"\Qa.b\E": ""}
    assert {p: needed_literal(p) for p in cases} == cases
