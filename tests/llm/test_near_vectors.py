"""Near-duplicate vectors with repeated and missing ids, very large values, two lengths, ties and hot labels, against all pairs."""

import math
import random

import numpy as np

from folioscan.llm import embedding_dedup
from folioscan.llm.graph import smallest_reached


def brute(rows, t=0.98):
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = (np.ldexp(np.array(x, float), -np.frexp(max(map(abs, x)))[1]) for x in (a, b))
        return float((a / np.sqrt((a * a).sum()) * (b / np.sqrt((b * b).sum()))).sum())

    ok = [usable(v, label) for _, label, v in rows]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]) and (rows[i][2] == rows[j][2] or cosine(rows[i][2], rows[j][2]) >= t)] for i in range(len(rows))]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((vec_id, len(links[i]), comp, comp is None or vec_id == comp))
    return sorted(out, key=str)


def test_odd_rows_match_all_pairs(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for k in range(160):
        v = [x + rng.gauss(0, 0.06) for x in rng.choice(base)]
        rows.append((rng.choice([None, rng.randrange(80), rng.randrange(80), 2**60 + k]), rng.choice(["a", "a", "b", None]), v))
    rows += [(5, "c", [1.0, 0.0]), (5, "c", [0.0, 1.0]), (6, "c", [1.0, 0.01]), (None, "c", [1.0, 0.02]), (7, "c", [1e200, 1e198]), (8, "c", [1e-200, 0.0]), (9, "c", [1.0, 0.0])]
    rows += [(10, "c", [1.0, 0.0, 0.0]), (11, "c", [0.0, 0.0]), (12, "c", []), (13, "c", None), (14, "c", [1.0, None]), (15, "c", [float("inf"), 1.0]), (None, "d", [3.0, 4.0]), (None, "d", [3.0, 4.0])]
    data = [(i, label, v, "x", 1, True) for i, label, v in rows]
    vectors = spark.createDataFrame(data, "vec_id long, label string, embedding array<double>, id string, n int, kept boolean").repartition(3)
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(vectors).collect()), key=str)
    assert got == brute(rows)


def test_smallest_reached():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        i, j = rng.integers(0, n, n), rng.integers(0, n, n)
        low = list(range(n))
        for _ in range(n):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                low[a] = low[b] = min(low[a], low[b])
        assert smallest_reached(n, i, j).tolist() == low
