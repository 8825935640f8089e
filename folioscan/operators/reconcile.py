"""Catalog against crawled snapshots: outcomes, retirement, stubs and amendment edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(listing: DataFrame, catalog: DataFrame, excluded: DataFrame) -> DataFrame:
    """reference, outcome for each listed row (reference, title, status, amended_by) against the catalog (reference, title, stage, amended_by).

    status is the page's HTTP status, null if it could not be read. Excluded references are dropped first.
    """
    left = listing.join(excluded.select("reference"), "reference", "left_anti")
    old = catalog.select("reference", F.col("title").alias("_title"), F.col("stage").alias("_stage"), F.col("amended_by").alias("_by"))
    j = left.join(old, "reference", "left")
    fresh = F.array_except(F.coalesce("amended_by", F.array().cast("array<string>")), F.coalesce("_by", F.array().cast("array<string>")))
    known = F.col("_title").isNotNull()
    outcome = (
        F.when((F.col("status") == 404) & known, "WITHDRAWN")
        .when(F.col("status").isNull() | (F.col("status") != 200), "FAILED")
        .when(~known, "NEW")
        .when(F.size(fresh) > 0, "AMENDED")
        .when(~F.col("title").eqNullSafe(F.col("_title")) | (F.col("_stage") == "REPEALED"), "UPDATED_METADATA")
        .otherwise("UNCHANGED")
    )
    return j.select("reference", outcome.alias("outcome"), fresh.alias("new_amendments"), ((F.col("_stage") == "REPEALED") & (F.col("status") == 200)).alias("reactivated"))


def retire(catalog: DataFrame, seen: DataFrame, keep: DataFrame) -> DataFrame:
    """References of web-sourced rows in force that the run did not see and no override keeps."""
    gone = catalog.where((F.col("source") == "WEB") & (F.col("stage") != "REPEALED"))
    return gone.join(seen.select("reference"), "reference", "left_anti").join(keep.select("reference"), "reference", "left_anti").select("reference")


def retired(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    mark = gone.select("reference", F.lit(True).alias("_gone"))
    return catalog.join(mark, "reference", "left").withColumn("stage", F.when(F.col("_gone"), "REPEALED").otherwise(F.col("stage"))).drop("_gone")


def run_status(items: DataFrame, run: str = "run_id", outcome: str = "outcome") -> DataFrame:
    """Counts by outcome and the status of each run; rows with outcome ERROR are cells that broke off."""
    n = lambda *v: F.count_if(F.col(outcome).isin(*v))
    c = items.groupBy(run).agg(n("NEW").alias("n_new"), n("AMENDED").alias("n_amended"), n("UPDATED_METADATA").alias("n_updated"), n("UNCHANGED").alias("n_unchanged"), n("WITHDRAWN").alias("n_withdrawn"), n("FAILED").alias("n_failed"), n("ERROR").alias("n_error"))
    ok = F.col("n_new") + F.col("n_amended") + F.col("n_updated") + F.col("n_unchanged")
    status = (
        F.when((F.col("n_error") > 0) & (ok > 0), "PARTIAL")
        .when(F.col("n_error") > 0, "FAILED")
        .when((F.col("n_failed") > 0) & (ok == 0), "FAILED")
        .when(F.col("n_failed") > 0, "PARTIAL")
        .otherwise("SUCCESS")
    )
    return c.withColumn("status", status)


def retire_gate(runs: DataFrame, floor: int) -> DataFrame:
    """Whether a run may retire rows, and why not: it must be a whole, successful, real run with enough rows."""
    scraped = F.col("n_new") + F.col("n_amended") + F.col("n_updated") + F.col("n_unchanged")
    note = F.when(F.col("status") != "SUCCESS", "run not successful").when(F.col("dry_run"), "dry run").when(F.col("restricted"), "restricted run").when((F.lit(floor) > 0) & (scraped < floor), "too few rows")
    return runs.withColumn("note", note).withColumn("may_retire", note.isNull())


def cells(items: DataFrame, shown: tuple[str, ...] = ("NEW", "AMENDED", "UPDATED_METADATA", "UNCHANGED", "FAILED")) -> DataFrame:
    """Outcome counts for each (entity_type, content_type), missing names as empty strings."""
    by = [F.coalesce(c, F.lit("")).alias(c) for c in ("entity_type", "content_type")]
    return items.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in shown))


def until_known(rows: DataFrame, group: str, order: list, known: str = "known") -> DataFrame:
    """Rows of each group in order, up to the first known one."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_k", F.sum(F.col(known).cast("int")).over(w)).where("_k = 0").drop("_k")


def stubs(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """References named in amended_by, amends or supersedes that the catalog lacks."""
    named = F.array_union(F.array_union("amended_by", "amends"), "supersedes")
    return rows.select(F.explode(named).alias("reference")).where("reference <> ''").distinct().hint("merge").join(catalog.select("reference"), "reference", "left_anti")


def edges(rows: DataFrame, catalog: DataFrame, known: DataFrame) -> DataFrame:
    """New (src, dst, relation) between catalog ids: amended_by reversed to AMENDS, amends, supersedes to REPEALS."""
    e = rows.select(F.col("reference").alias("b"), F.explode("amended_by").alias("a"), F.lit("AMENDS").alias("relation")).select("a", "b", "relation")
    e = e.unionByName(rows.select(F.col("reference").alias("a"), F.explode("amends").alias("b"), F.lit("AMENDS").alias("relation")))
    e = e.unionByName(rows.select(F.col("reference").alias("a"), F.explode("supersedes").alias("b"), F.lit("REPEALS").alias("relation")))
    ids = catalog.select("reference", "entity_id")
    e = e.hint("merge").join(ids.select(F.col("reference").alias("a"), F.col("entity_id").alias("src")), "a").hint("merge").join(ids.select(F.col("reference").alias("b"), F.col("entity_id").alias("dst")), "b")
    return e.where("src <> dst").select("src", "dst", "relation").distinct().hint("merge").join(known, ["src", "dst", "relation"], "left_anti")
