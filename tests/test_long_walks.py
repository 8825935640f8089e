"""Walks longer than any fixed number of steps."""

from folioscan.operators import graph


def test_effective_parents_of_long_chains_and_cycles(spark):
    up = {i: i + 1 for i in range(300)}  # a chain to 300
    up |= {1000 + i: 1000 + (i + 1) % 150 for i in range(150)}  # a cycle
    up |= {2000 + i: 2001 + i for i in range(99)} | {2099: 1070}  # a long tail into it
    up |= {3000: 3000, 3001: 3000}
    every = sorted({*up, *up.values()})

    def top(x):
        seen = set()
        while x in up and x not in seen:
            seen.add(x)
            x = up[x]
        return x

    nodes = spark.createDataFrame([(i, False) for i in every], "node long, repealed boolean")
    got = graph.effective_parents(nodes, spark.createDataFrame(list(up.items()), "node long, parent long")).collect()
    assert sorted(tuple(r) for r in got) == [(i, top(i)) for i in every]
