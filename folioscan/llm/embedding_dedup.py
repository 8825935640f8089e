"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the basis of their principal axes, largest variance first, so that the
leading dimensions hold most of each product. Two vectors of cosine t or more are at most r = sqrt(2 - 2t) apart, so
they lie in the same or in neighbouring cells of a grid of width r over the first `GRID` axes; only those are compared,
tile by tile. In a tile pair the product over the leading dimensions is taken first; the rest can add at most the
product of the suffix norms, and pairs that cannot reach the threshold stop there. What is left is checked by cosine in
double precision on the vectors as given.

Equal vectors of a label are one class, compared once. A tile has at most `TILE` classes; a crowded cell becomes
several tiles, each pair of them a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, smallest_reached
from .store import prepare, written

TILE, GRID, LEAD = 2048, 3, 12


def _plain(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dims)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column, each times a power of two that keeps its squares in range; that changes no digit of a cosine."""
    x = _plain(col, dims)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=1e-300))[1][:, None]) if len(x) else x


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes (columns) by falling variance of the unit vectors v; one dims x dims matrix of sums reaches the driver."""

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column(0), dims)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["i", "x"])

    rows = vectors.select("v").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(dims * dims)
    for r in rows:
        total[r.i] = r.x
    _, axes = np.linalg.eigh(total.reshape(dims, dims))
    return axes[:, ::-1].copy()


def near_vectors(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    Rows are compared when their labels are equal and not null. Null vectors, empty or zero ones and such with null or
    non-finite components link with nothing, nor do vectors of different lengths. Rows that share a vec_id count as
    rows of their own, and so do rows without one: their component has the smallest vec_id of its other rows, null if it has
    none, and they are kept in that case only. An empty table gives an empty result; other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    v = F.col(vector).cast("array<double>")
    fine = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    zero = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are equal
    rows = rows.withColumn("v", F.when(F.col("fine"), zero)).withColumn("fine", F.col("fine") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = written(rows.withColumn("digest", F.when(F.col("fine"), F.sha2(F.to_json(F.struct("v")).cast("binary"), 256))), "vectors")
    classes = rows.where("fine").groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    links = None
    for dims in [r.d for r in classes.select(F.size("v").alias("d")).distinct().collect()]:
        found = _links(classes.where(F.size("v") == dims), dims, threshold)
        links = found if links is None else links.unionByName(found)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    if links is None:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    links = written(links, "vector-links")
    near = links.where("n > 0").groupBy("id").agg(F.sum("n").alias("near"))
    comp = components(links.where("n = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    by_class = classes.select("label", "digest", "id", "least", "n").hint("merge").join(near, "id", "left").hint("merge").join(comp, "id", "left")
    by_class = written(by_class.select("label", "digest", "least", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "vector-marks")
    named = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    marks = by_class.drop("least").hint("merge").join(named, "component")
    out = rows.select("vec_id", "label", "digest").hint("merge").join(marks, ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", kept)


def _links(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """id, other, n: with n > 0, rows that id's class has links to in one tile pair; with n = 0, an edge of a spanning forest of the links."""
    axes = principal_axes(classes, dims)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    grid = min(GRID, dims)

    def turn(batches):
        for b in batches:
            x = _matrix(b.column(3), dims)
            y = (x / np.linalg.norm(x, axis=1)[:, None]) @ axes
            cell = np.floor(y[:, :grid] / width).astype(np.int64)
            lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), lists(y, pa.float64()), lists(cell, pa.int64())], ["label", "id", "n", "v", "y", "cell"])

    schema = "label string, id long, n long, v array<double>, y array<double>, cell array<long>"
    placed = written(classes.select("label", "id", "n", "v").mapInArrow(turn, schema), "vector-cells")
    crowd = written(placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "vector-crowds")
    steps = [()]
    for _ in range(grid):
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    moves = F.array(*(F.array(*(F.lit(d).cast("long") for d in s)) for s in steps))
    near = crowd.withColumn("move", F.explode(moves)).select("label", F.zip_with("cell", "move", lambda c, d: c + d).alias("cell"), F.col("cell").alias("from"), F.col("tiles").alias("from_tiles"))
    pairs = crowd.hint("merge").join(near, ["label", "cell"]).where(F.col("cell") <= F.col("from"))  # each pair of cells once
    tile_pairs = (
        pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("from_tiles") - 1)))
        .where((F.col("cell") != F.col("from")) | (F.col("i") <= F.col("j")))
        .select("label", F.struct("cell", F.col("i").alias("t")).alias("a"), F.struct(F.col("from").alias("cell"), F.col("j").alias("t")).alias("b"), F.xxhash64("label", "cell", "i", "from", "j").alias("pair"))
    )
    same = F.col("a") == F.col("b")
    sides = tile_pairs.select("label", "pair", F.col("a").alias("tile"), F.when(same, 2).otherwise(0).alias("side")).unionByName(tile_pairs.where(~same).select("label", "pair", F.col("b").alias("tile"), F.lit(1).alias("side")))
    sides = written(sides.select("label", "pair", "side", F.col("tile.cell").alias("cell"), F.col("tile.t").alias("t")), "vector-tiles")
    salted = placed.hint("merge").join(crowd, ["label", "cell"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = sides.hint("merge").join(salted, ["label", "cell", "t"]).select("label", "pair", "side", "id", "n", "v", "y")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, ids, n = (table.column(c).to_numpy() for c in ("side", "id", "n"))
        v, y = _matrix(table.column("v").combine_chunks(), dims), _plain(table.column("y").combine_chunks(), dims)
        order = np.lexsort((ids, side))
        side, ids, n, v, y = side[order], ids[order], n[order], v[order], y[order]
        cut = len(side) if len(side) and side[0] == 2 else int((side == 0).sum())
        left, right = slice(0, cut), slice(0, cut) if cut == len(side) and len(side) and side[0] == 2 else slice(cut, len(side))
        i, j = _close(y[left], y[right], v[left], v[right], threshold)
        i, j = i + left.start, j + right.start
        if left == right:
            i, j = i[i < j], j[i < j]
        near = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        low = smallest_reached(len(ids), i, j)  # a star for each group of links has the same components
        moved, some = np.flatnonzero(low != np.arange(len(ids))), np.flatnonzero(near)
        columns = [np.concatenate([ids[some], ids[low[moved]]]), np.concatenate([ids[some], ids[moved]]), np.concatenate([near[some], np.zeros(len(moved))]).astype(np.int64)]
        return pa.table(dict(zip(("id", "other", "n"), map(pa.array, columns), strict=True)))

    return dealt.groupBy("label", "pair").applyInArrow(compare, "id long, other long, n long")


def _close(ya, yb, va, vb, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine reaches the threshold."""
    lead = min(LEAD, ya.shape[1])
    rest = lambda y: np.sqrt((y[:, lead:] ** 2).sum(1))
    out_i, out_j, ra, rb = [], [], rest(ya), rest(yb)
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    ua, ub = unit(va), unit(vb)
    for s in range(0, len(ya), 512):
        bound = ya[s : s + 512, :lead] @ yb[:, :lead].T + ra[s : s + 512, None] * rb
        i, j = np.nonzero(bound >= threshold - 1e-9)
        for k in range(0, len(i), 1 << 18):
            a, b = i[k : k + (1 << 18)] + s, j[k : k + (1 << 18)]
            hit = (ua[a] * ub[b]).sum(1) >= threshold
            out_i.append(a[hit])
            out_j.append(b[hit])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))
