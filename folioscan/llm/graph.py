"""Connected components by alternating star operations on an edge table; no links reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the smallest one it is connected with by the links (i, j) that one task holds."""
    low = np.arange(n)
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return low
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (the smallest id it is connected with) for each end of the edges (a, b).

    Each round hangs every vertex's larger neighbours on its smallest one (large star), then its smaller neighbours
    (small star), until nothing changes; the rounds grow with the logarithm of the longest chain. A vertex with many
    neighbours is aggregated before the shuffle and its join may be split. Loops and repeated edges don't matter.
    Edges that still change after most_rounds are an error.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(ordered, "edges")
    mark = _mark(now)
    for _ in range(most_rounds if mark[0] else 0):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.hint("merge").join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        forget(low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.hint("merge").join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "edges")
        forget(now, large, low)
        now, last = after, mark
        mark = _mark(now)
        if mark == last:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """Figures that change whenever the edges do."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
