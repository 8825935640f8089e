"""The aliases' SQL states the rule of the query: edges of words of any script."""

import duckdb

from folioscan.plans import linking_queries, registry

TEXTS = ["Deséan", "desèti", "une", "éune", "x des", "des_", "des9", "9des", "(DES)", "éune x", "́une", "!́une", "_́une", "x́̂une", "unе́", "uné", "the\x0band", "the \t and", "natİon", "natıon", "İng the", "ung. D", "ungx D", "É", "é", "üb", "Üß", "deſ", "", None]


def test_alias_sql_agrees_on_edges_of_words(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("J2_alias_links", "J2_alias_table", "J2_link_and_rank", "J5_combined_links", "M2_event_links"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
    assert linking_queries.RE2[4] is None and len(linking_queries.RE2) == len(linking_queries.ALIASES)
