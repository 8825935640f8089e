"""Landed query results: pages of bounded size, whole."""

from pyspark.sql import functions as F

from folioscan.plans import text_queries
from folioscan.sources import feeds


def test_pages_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_queries, "PAGE_ROWS", 50)
    cell = F.struct(F.lit("literal").alias("type"), F.concat(F.lit('"é,\n'), F.col("id").cast("string")).alias("value"))
    rows = spark.range(2000).select(F.col("id").alias("k"), F.create_map(F.lit("celex"), cell).alias("b"))
    root = str(tmp_path / "results")
    text_queries._land_results(rows, "k", root)
    raw = spark.read.schema(feeds.BINDINGS).option("multiLine", True).json(root)
    sizes = [r[0] for r in raw.select(F.size("results.bindings")).collect()]
    assert sum(sizes) == 2000 and max(sizes) < 150 and len(sizes) > 30
    assert {r.c for r in feeds.read_sparql(spark, root, {"c": ["celex"]}).collect()} == {f'"é,\n{i}' for i in range(2000)}
    text_queries._land_results(rows.limit(0), "k", str(tmp_path / "none"))
    assert feeds.read_sparql(spark, str(tmp_path / "none"), {"c": ["celex"]}).count() == 0
