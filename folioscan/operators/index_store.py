"""The stored search index: chunks, vectors and postings in generations, with tombstones for versions that were built again.

A build writes its rows as a new generation. Reindexing a version writes a tombstone (version_id, generation) first: rows of that version from
earlier generations are dead from then on, whatever table they are in. merge() writes the live rows anew. Postings are kept in blocks by term, so that a search reads the terms it asks for and no text is cut into words again.

    chunks      chunk_id, version_id, entity_id, chunk_index, text, ... as index.build_index() gives them
    vectors     chunk_id, version_id, embedding
    postings    term, block, version_id and, in order of chunk_id, chunk_ids, tfs, sizes
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import indexing, inference, retrieval

TABLES = ("chunks", "vectors", "postings")
TOMBSTONES = "version_id long, generation long"
#: Postings of a term in one version are one block; frequent terms have many versions and so many blocks.
BUCKETS = 64
#: Parts of a bucket, by version; each is written by one task.
PARTS = 8
#: Tombstones that are broadcast (two numbers each); with more, rows are merged with them.
MOST_TOMBSTONES = 1_000_000


def _write(df: DataFrame, root: str, name: str, generation: int) -> None:
    df.withColumn("generation", F.lit(generation).cast("long")).write.mode("append").option("compression", "zstd").parquet(f"{root}/{name}")
    _release(df.sparkSession)


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blocks(postings: DataFrame) -> DataFrame:
    """Postings (term, version_id, chunk_id, tf, n_terms) as a row for each term and version, shuffled once, by bucket and part."""
    p = _dealt(postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")))
    each = F.sort_array(F.collect_list(F.struct("chunk_id", F.col("tf").cast("int").alias("tf"), F.col("n_terms").cast("int").alias("n"))))
    b = p.groupBy("bucket", "_part", "term", "version_id").agg(each.alias("p"))
    return b.select("bucket", "term", "version_id", F.col("p.chunk_id").alias("chunk_ids"), F.col("p.tf").alias("tfs"), F.col("p.n").alias("sizes"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of postings by bucket and `_part`."""
    return rows.withColumn("_part", F.pmod(F.xxhash64("version_id"), F.lit(PARTS)).cast("int")).repartition("bucket", "_part")


def postings_of(block: DataFrame) -> DataFrame:
    """term, version_id, chunk_id, tf, n_terms from blocks."""
    zipped = F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("tfs").alias("tf"), F.col("sizes").alias("n_terms"))
    rows = block.select("term", "version_id", F.explode(zipped).alias("p"))
    return rows.select("term", "version_id", F.col("p.chunk_id").alias("chunk_id"), F.col("p.tf").cast("long").alias("tf"), F.col("p.n_terms").alias("n_terms"))


def build(root: str, versions: DataFrame, catalog: DataFrame, model: Callable, generation: int, **chunking) -> int:
    """Write chunks, vectors and postings of versions (version_id, entity_id, text, protected) as a generation; the number of chunks."""
    spark = versions.sparkSession
    _write(indexing.build_index(versions, catalog, **chunking), root, "chunks", generation)  # cut once, read for each table
    chunks = spark.read.parquet(f"{root}/chunks").where(F.col("generation") == generation).drop("generation")
    _write(inference.embed(chunks.select("chunk_id", "version_id", "embed_text"), "embed_text", model).select("chunk_id", "version_id", "embedding"), root, "vectors", generation)
    p = blocks(indexing.index_postings(chunks)).sortWithinPartitions("bucket", "term")
    p.withColumn("generation", F.lit(generation).cast("long")).write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings")
    if generation == 0:
        spark.createDataFrame([], TOMBSTONES).coalesce(1).write.mode("append").parquet(f"{root}/tombstones")
    _release(spark)
    return chunks.count()


def live(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's rows without those of generations before their version's last tombstone."""
    dead = spark.read.schema(TOMBSTONES).parquet(f"{root}/tombstones").groupBy("version_id").agg(F.max("generation").alias("_since"))
    n, rows = dead.limit(MOST_TOMBSTONES + 1).count(), spark.read.parquet(f"{root}/{name}")
    if not n:
        return rows
    rows = rows.join(F.broadcast(dead) if n <= MOST_TOMBSTONES else dead.hint("merge"), "version_id", "left")
    return rows.where(F.col("_since").isNull() | (F.col("generation") >= F.col("_since"))).drop("_since")


def last_generation(spark: SparkSession, root: str) -> int:
    tops = [spark.read.parquet(f"{root}/{name}").agg(F.max("generation")).first()[0] for name in ("chunks", "tombstones")]
    return max((t for t in tops if t is not None), default=-1)


def reindex(root: str, versions: DataFrame, catalog: DataFrame, entities: DataFrame, model: Callable, **chunking) -> int:
    """Wipe the versions of these entities and build them again from versions; protected ones are wiped only. The number of new chunks."""
    spark = versions.sparkSession
    chosen = versions.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    generation = last_generation(spark, root) + 1
    _write(chosen.select(F.col("version_id").cast("long")).distinct(), root, "tombstones", generation)
    return build(root, chosen, catalog, model, generation, **chunking)


def merge(spark: SparkSession, root: str, to: str) -> None:
    """The live rows of all tables as generation 0 of a new index, without tombstones."""
    for name in TABLES:
        rows = live(spark, root, name).withColumn("generation", F.lit(0).cast("long"))
        if name == "postings":
            # a file has one bucket and files of a task are read in order of size, so buckets stay together without a shuffle
            rows.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{to}/{name}")
        else:
            rows.write.option("compression", "zstd").parquet(f"{to}/{name}")
        _release(spark)
    spark.createDataFrame([], TOMBSTONES).coalesce(1).write.parquet(f"{to}/tombstones")


def search(spark: SparkSession, root: str, questions: DataFrame, k: int, **bm25) -> DataFrame:
    """question_id, chunk_id, sparse_rank by BM25 over the stored postings of the questions' words; no text is read but the questions'."""
    size = live(spark, root, "chunks").agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("mean")).first()
    if not size.n:
        return questions.select("question_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0).alias("sparse_rank")).limit(0)
    return retrieval.by_blocks(questions, lambda q: retrieval.ranked_blocks(live(spark, root, "postings"), size.n, size.mean, q, k, **bm25))
