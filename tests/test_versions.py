"""Version chains in two levels against a walk over each entity's rows."""

import difflib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioscan.operators import versions


def walk(rows, last):
    out, state = [], dict(last)
    for entity, at, h in sorted(rows, key=lambda r: r[1]):
        n, before = state.get(entity, (0, object()))
        if before != h:
            state[entity] = (n + 1, h)
            out.append((entity, at, n + 1))
    return sorted(((e, at, n, n == state[e][0]) for e, at, n in out), key=str)


def test_one_entity_with_most_rows(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice(["x", "y", "z", None])) for i in range(600)]
    df = spark.createDataFrame([(e, at, h, "t") for e, at, h in rows], "entity string, at long, content_hash string, text string").repartition(3)
    for last in ({}, {"hot": (7, rows[0][2]), "a": (2, "q"), "gone": (1, "x")}):
        table = spark.createDataFrame([(e, n, h) for e, (n, h) in last.items()], "entity string, version_number int, content_hash string") if last else None
        got = versions.version_chain(df, "entity", ["at"], last=table)
        assert sorted(((r.entity, r.at, r.version_number, r.is_current) for r in got.collect()), key=str) == walk(rows, last)
    ranges = df.where("entity = 'hot'").select(versions._ranges(df, "at").alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()
    assert len(ranges) >= 4 and max(r.n for r in ranges) < 300  # the entity's rows are spread
    named = df.withColumn("name", F.lpad(F.col("at").cast("string"), 6, "0"))  # an order without ranges
    assert sorted(((r.entity, r.at, r.version_number, r.is_current) for r in versions.version_chain(named, "entity", ["name"]).collect()), key=str) == walk(rows, {})
    assert versions.version_chain(df.limit(0), "entity", ["at"]).count() == 0


def test_diffs_leave_the_worker_in_small_batches(spark):
    rng = random.Random(4)
    texts = [None, "", "a\nb", "a\r\nb\n", "é x"] + ["\n".join(rng.choice(["one", "two", "drei", ""]) for _ in range(rng.randrange(40))) for _ in range(600)] + ["w " * 300_000 + str(k) for k in range(6)]
    pairs = [(rng.choice(texts), t) for t in texts] + [(t, t) for t in texts[:9]]

    def plain(a, b):
        return None if not a or b is None or a == b else "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "previous", "current", n=3, lineterm=""))

    out = list(versions.unified_diff.func(iter([tuple(pa.array(c, pa.string()) for c in zip(*pairs, strict=True))])))
    assert [d for b in out for d in b.to_pylist()] == [plain(*p) for p in pairs]
    assert max(map(len, out)) <= versions.DIFF_ROWS and max(b.nbytes for b in out if len(b) > 1) < 4 * versions.DIFF_CHARS
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a string, b string").repartition(2)
    got = df.select("k", versions.unified_diff("a", "b").alias("d")).orderBy("k").collect()
    assert [r.d for r in got] == [plain(*p) for p in pairs]
