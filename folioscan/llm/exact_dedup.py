"""Exact deduplication with disk-backed streaming state, on DataFrame operations only.

A stream of slim rows (digest, stable identifier, content locator) updates one state row for each digest in
RocksDB; the state has no watermark, so nothing expires and later batches meet all earlier ones. A digest
seen more than once is a hit: the locators in the state fetch the text of the row that stays, and the full bytes of
every other row of the group are compared with it before they count as equal. While the groups of several and the bytes
of their kept texts are counted to be few, they are broadcast and no text is shuffled; beyond that the texts of such groups
are, with large groups salted.

A locator is a hash of identifier and text, so it finds a row again in any order of reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, new_path, prepare, written

#: Rows and bytes of a table that is broadcast.
FEW_ROWS, FEW_BYTES = 250_000, 32 << 20
#: Rows of a group that are compared with one copy of the kept text.
SALTED = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def update_state(slim: DataFrame, checkpoint: str, out: str) -> None:
    """Feed a stream of (digest, n_bytes, doc_id, loc, at) to the keyed state and append each batch's changed groups to out.

    Run again with the same checkpoint, it takes up only new files; a batch that is repeated after a failure
    overwrites its own folder.
    """
    spark = slim.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # no megabytes set aside for each small store
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "96")
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    groups = slim.groupBy("digest", "n_bytes").agg(F.max(F.struct("doc_id", "loc", "at")).alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def save(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b{batch:09d}")

    q = groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()


def exact_dedup(docs: DataFrame, digest=sha256_hex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; of several rows with that id, any one of them (equal texts
    have nothing else to choose by). A null text counts as empty; a null doc_id is below all others; an empty table gives an empty
    result; other columns are not read. digest may be any function of the text: rows that share a digest but not their bytes are
    grouped by the text itself.
    """
    return _marked(docs, digest, doc_id, text).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def locator(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(docs[doc_id].cast("long"), F.coalesce(docs[text], F.lit("")))


def _few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


def _marked(docs: DataFrame, digest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of exact_dedup() with their locators and those of the rows that stay."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), locator(docs, doc_id, text).alias("loc"))
    texts = texts.withColumns({"digest": digest(F.col("text")), "n_bytes": F.octet_length("text").cast("long")})
    slim = written(texts.select("doc_id", "digest", "n_bytes", sha256_hex(F.col("text")).alias("text_sha256"), "loc", F.monotonically_increasing_id().alias("at")), "dedup-slim")
    out = new_path(spark, "dedup-groups")
    update_state(spark.readStream.schema(slim.schema).parquet(slim._folioscan_path), new_path(spark, "dedup-state"), out)
    schema = "digest string, n_bytes long, keep struct<doc_id: long, loc: long, at: long>, group_size long, batch int"
    last = spark.read.schema(schema).parquet(f"{out}/*").groupBy("digest", "n_bytes").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("g"))
    several = written(last.where("g.group_size > 1").select("digest", "n_bytes", "g.keep", "g.group_size"), "dedup-several")
    mine = F.struct("doc_id", "loc", "at")
    found = slim.join(_few(several), ["digest", "n_bytes"], "left").withColumns({"keep": F.coalesce("keep", mine), "group_size": F.coalesce("group_size", F.lit(1))})
    found = written(found, "dedup-found")
    forget(slim)
    wrong = _collisions(texts, several)
    columns = ["doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep.at")).alias("kept"), "text_sha256", "loc", F.col("keep.loc").alias("keep_loc")]
    if wrong.isEmpty():
        return found.select(*columns)
    again = found.join(wrong.hint("merge"), ["digest", "n_bytes"], "left_semi").drop("keep", "group_size")
    groups = again.groupBy("text_sha256", "n_bytes").agg(F.max(mine).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = again.hint("merge").join(groups, ["text_sha256", "n_bytes"])
    return found.join(wrong.hint("merge"), ["digest", "n_bytes"], "left_anti").select(*columns).unionByName(again.select(*columns))


def _collisions(texts: DataFrame, several: DataFrame) -> DataFrame:
    """(digest, n_bytes) of groups whose rows don't all have the bytes of the row that stays."""
    groups = several.select("digest", "n_bytes", F.col("keep.loc").alias("keep_loc"), "group_size")
    hits = texts.join(_few(groups), ["digest", "n_bytes"])
    kept = written(hits.where("loc = keep_loc").select("digest", "n_bytes", F.col("text").alias("keep_text"), "group_size").dropDuplicates(["digest", "n_bytes"]), "dedup-kept")
    others = hits.where("loc <> keep_loc").select("digest", "n_bytes", "text", "group_size")
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    if rows <= FEW_ROWS and size <= FEW_BYTES:
        pairs = others.join(F.broadcast(kept.drop("group_size")), ["digest", "n_bytes"])
    else:
        salts = F.ceil(F.col("group_size") / SALTED)
        each = kept.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("group_size")
        pairs = others.withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts)).hint("merge").join(each, ["digest", "n_bytes", "salt"])
    return written(pairs.where(F.col("text") != F.col("keep_text")).select("digest", "n_bytes").distinct(), "dedup-collisions")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() drops, with all their columns; of rows that repeat id and text any one stays.

    Rows are known by their doc_id and the SHA-256 of their text, never by a short hash.
    """
    marks = written(_marked(docs, sha256_hex).select("doc_id", "keep_id", "text_sha256"), "dedup-marks")
    gone = marks.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    few = _few(written(gone, "dedup-gone"))
    doc_id, text_sha256 = docs["doc_id"].cast("long"), sha256_hex(F.coalesce(docs["text"], F.lit("")))
    out = docs.join(few, doc_id.eqNullSafe(few["doc_id"]) & (text_sha256 == few["text_sha256"]), "left_anti")
    if marks.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        return out
    key = new_path(docs.sparkSession, "row")  # a name that no column of docs has
    own = F.struct(out["doc_id"].cast("long").alias("doc_id"), sha256_hex(F.coalesce(out["text"], F.lit(""))).alias("text_sha256"))
    return out.withColumn(key, own).dropDuplicates([key]).drop(key)
