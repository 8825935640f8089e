"""Small files whose rows are costly are dealt to all cores."""

from folioscan.plans import registry


def test_pages_of_a_small_file_are_dealt_to_many_tasks(spark, monkeypatch):
    assert registry.QUERIES["S12_listing_fields"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(registry, "SPREAD_ROWS", 5)
    spread = t.spread("part", "p_partkey")
    assert spread.rdd.getNumPartitions() == max(16, -(-t.part.count() // 5)) and sorted(spread.collect()) == sorted(t.part.collect())
