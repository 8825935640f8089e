"""Events, links and versions of a stream, persisted a micro-batch at a time with a ledger of the batches that are whole.

A batch writes its events, links and versions each to a folder of its own, named after it, and its line in the ledger last.
Readers take batches of the ledger only: one that broke off between two tables is not seen, and when the
stream starts again the batch overwrites what it left. A replayed batch reads the batches before it only, so it
writes what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import first_wins, version_chain
from . import ingest

LEDGER = "batch long, n_events long, n_links long, n_versions long"
CONTENTS = "content_hash string, batch long"
VERSIONS = "entity_id long, doc_id long, content_hash string, version_number int, batch long"


def _folder(root: str, name: str, batch: int) -> str:
    return f"{root}/{name}/b{batch:012d}"


def _save(df: DataFrame, root: str, name: str, batch: int) -> DataFrame:
    """Write a batch's part of a table over whatever is there, and read it back."""
    path, out = _folder(root, name, batch), df.withColumn("batch", F.lit(batch).cast("long"))
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def begin(spark: SparkSession, root: str) -> None:
    """An empty ledger, version and event table, so that the first batch has something to read; does nothing where they are."""
    for name, schema in (("ledger", LEDGER), ("versions", VERSIONS), ("events", CONTENTS)):
        spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{root}/{name}/begin")


def committed(spark: SparkSession, root: str, name: str, schema: str | None = None, before: int | None = None) -> DataFrame:
    """A table's rows of all batches in the ledger, or of those before one."""
    ledger = spark.read.schema(LEDGER).parquet(f"{root}/ledger/*").select("batch")
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    rows = reader.parquet(f"{root}/{name}/*")
    if before is not None:
        ledger, rows = ledger.where(F.col("batch") < before), rows.where(F.col("batch") < before)
    return rows.join(F.broadcast(ledger), "batch", "left_semi")  # a number for each batch that ran


def batch_writer(root: str, link: Callable[[DataFrame], DataFrame], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over items (doc_id, content_hash and what else events should keep).

    link(events) gives (doc_id, entity_id, ...): what an event is about. An entity gets a version for each event about it
    whose content is not that of the version before, numbered on from the batches before. Of items of one
    content in a batch the first in order is the event, and none is if a batch before has one (a null is one content).
    """

    def write(items: DataFrame, batch: int) -> None:
        spark = items.sparkSession
        begin(spark, root)
        known = committed(spark, root, "events", CONTENTS, before=batch).select(F.col("content_hash").alias("_known")).distinct()
        first = first_wins(items, ["content_hash"], order).hint("merge")
        events = _save(first.join(known, F.col("content_hash").eqNullSafe(F.col("_known")), "left_anti"), root, "events", batch)
        links = _save(link(events), root, "links", batch)
        old = committed(spark, root, "versions", VERSIONS, before=batch)
        last = old.groupBy("entity_id").agg(F.max("version_number").alias("version_number"), F.max_by("content_hash", "version_number").alias("content_hash"))
        about = links.select("doc_id", "entity_id").distinct().hint("merge").join(events.drop("batch"), "doc_id")
        new = version_chain(about, "entity_id", order, last=last).select("entity_id", "doc_id", "content_hash", "version_number")
        versions = _save(new, root, "versions", batch)
        counts = [t.count() for t in (events, links, versions)]
        _save(spark.createDataFrame([tuple(counts)], "n_events long, n_links long, n_versions long").coalesce(1), root, "ledger", batch)

    return write


def run(stream: DataFrame, root: str, checkpoint: str, link: Callable[[DataFrame], DataFrame], order: list[str]) -> None:
    """Persist what has landed. The stream keeps no state of contents: that would take any of a batch's copies, not the first in order."""
    begin(stream.sparkSession, root)
    ingest.run(stream, checkpoint, batch_writer(root, link, order))


def current_versions(spark: SparkSession, root: str) -> DataFrame:
    """The committed versions with is_current, true for each entity's last."""
    rows = committed(spark, root, "versions", VERSIONS)
    top = rows.groupBy("entity_id").agg(F.max("version_number").alias("_top"))
    return rows.hint("merge").join(top, "entity_id").withColumn("is_current", F.col("version_number") == F.col("_top")).drop("_top")
