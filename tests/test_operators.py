"""Version chains, graphs, reconciliation and streams on small tables."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.operators import graph, inference, reconcile, versions


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from("ab"), min_size=1, max_size=8))
def test_chain_is_gap_free_with_one_current(spark, hashes):
    rows = spark.createDataFrame([("e", i, h) for i, h in enumerate(hashes)], "entity string, ord int, content_hash string")
    got = versions.version_chain(rows, "entity", ["ord"]).orderBy("ord").collect()
    want = [h for i, h in enumerate(hashes) if i == 0 or hashes[i - 1] != h]
    assert [r.content_hash for r in got] == want
    assert [r.version_number for r in got] == list(range(1, len(want) + 1))
    assert [r.is_current for r in got] == [False] * (len(want) - 1) + [True]


def test_effective_parents_stop_at_the_node_met_again(spark):
    nodes = spark.createDataFrame([(i, False) for i in range(8)], "node long, repealed boolean")
    parents = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (5, 6)], "node long, parent long")
    got = {r.node: r.top for r in graph.effective_parents(nodes, parents).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 6, 7: 7}


def test_repealed_parents_are_skipped(spark):
    nodes = spark.createDataFrame([(1, False), (2, True), (3, False)], "node long, repealed boolean")
    edges = spark.createDataFrame([(1, 2, "AMENDS", 1), (1, 3, "AMENDS", 2)], "src long, dst long, relation string, link_id long")
    assert [tuple(r) for r in graph.first_parents(edges, nodes).collect()] == [(1, 3)]


def test_run_status(spark):
    rows = [(1, "NEW"), (2, "NEW"), (2, "FAILED"), (3, "FAILED"), (3, "WITHDRAWN"), (4, "ERROR"), (5, "ERROR"), (5, "UNCHANGED")]
    got = reconcile.run_status(spark.createDataFrame(rows, "run_id int, outcome string"))
    assert {r.run_id: r.status for r in got.collect()} == {1: "SUCCESS", 2: "PARTIAL", 3: "FAILED", 4: "FAILED", 5: "PARTIAL"}


def test_diff_is_null_without_change(spark):
    v = spark.createDataFrame([("e", 1, "a\nb"), ("e", 2, "a\nc"), ("e", 3, "a\nc")], "entity string, version_number int, text string")
    got = {r.version_number: r.diff for r in versions.with_diff(v, "entity").collect()}
    assert got[1] is None and got[3] is None and "-b" in got[2] and "+c" in got[2]


def test_failed_provider_fails_rows_not_the_run(spark):
    def broken(prompts):
        raise RuntimeError("down")

    got = inference.infer(spark.createDataFrame([("x",), (None,)], "p string"), "p", broken).collect()
    assert all(r.reply is None and "down" in r.error for r in got)


def test_native_rules_plan_without_python(spark):
    from folioscan.operators import linking

    docs = spark.createDataFrame([(1, "the word")], "doc_id long, text string")
    plan = linking.link_aliases(docs, [(1, "WORD", "EXACT")])
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [r.snippet for r in plan.collect()] == ["the word"]
    assert plan.where(F.col("entity_id") == 2).isEmpty()
