"""Effective parents along amendment edges by pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, parent: the target of each node's first AMENDS edge to a node that isn't repealed."""
    live = nodes.where("not repealed").select(F.col("node").alias("dst"))
    return edges.where("relation = 'AMENDS'").join(live, "dst").groupBy(F.col("src").alias("node")).agg(F.min_by("dst", "link_id").alias("parent"))


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir; where that is unset on one machine (tests), in one for this application, else an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _jumped(step: DataFrame, most: int) -> DataFrame:
    """node, top after so many steps that every top is the end of a chain or on a cycle; no chain has more than most steps."""
    length = 1
    while length <= most:
        nxt = step.select(F.col("node").alias("top"), F.col("top").alias("nxt"))
        both = _kept(step.join(nxt, "top").select("node", "top", "nxt"))
        if both.where("top <> nxt").isEmpty():
            break
        step = both.select("node", F.col("nxt").alias("top"))
        length *= 2
    return step


def effective_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """node, top: the end of each node's chain of parents; on a cycle, the node that the walk meets twice first.

    Every round doubles the length of the known steps, so the rounds grow with the logarithm of the longest chain, or of
    the number of nodes if there are cycles. Tops that still have a parent then are all the nodes on cycles; without the
    steps out of these, the other nodes' chains end where they enter the cycle.
    """
    first = nodes.select("node").join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("top"))
    step = _jumped(_kept(first), n := nodes.count())
    moving = _kept(step.join(parents.select(F.col("node").alias("top")), "top", "left_semi"))
    if moving.isEmpty():
        return step
    cycles = _kept(moving.select(F.col("top").alias("node")).distinct())
    cut = parents.join(cycles, "node", "left_anti")
    into = _jumped(_kept(moving.select("node").join(cut, "node", "left").select("node", F.coalesce("parent", "node").alias("top"))), n)
    if not into.join(cycles.select(F.col("node").alias("top")), "top", "left_anti").isEmpty():
        raise RuntimeError("walks along parents did not end")
    return step.join(moving.select("node"), "node", "left_anti").select("node", "top").unionByName(into.select("node", "top"))


def children(tops: DataFrame) -> DataFrame:
    """top, n, members (sorted) of the nodes below each top-level node."""
    return tops.where("node <> top").groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("node")).alias("members"))


def neighbours(edges: DataFrame) -> DataFrame:
    """node with the sorted sets amended_by, amends, repeals."""
    out = edges.select(F.col("src").alias("node"), F.when(F.col("relation") == "AMENDS", "amends").when(F.col("relation") == "REPEALS", "repeals").alias("set"), F.col("dst").alias("other"))
    back = edges.where("relation = 'AMENDS'").select(F.col("dst").alias("node"), F.lit("amended_by").alias("set"), F.col("src").alias("other"))
    pick = lambda s: F.sort_array(F.collect_set(F.when(F.col("set") == s, F.col("other")))).alias(s)
    return out.unionByName(back).groupBy("node").agg(pick("amended_by"), pick("amends"), pick("repeals"))
