"""Tables in the folder that the driver and all executors share, and session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of an Arrow batch: 1,024 documents of a few kB each are a few MB in a Python worker.
BATCH_ROWS, BATCH_BYTES = "1024", "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests), a temporary one for this application, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_folioscan_dir", None):
        sc._folioscan_dir = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(sc._folioscan_dir)
    return sc._folioscan_dir


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    env["TOKENIZERS_PARALLELISM"] = "false"
    # freed arrays go back to the system, so that a worker that waits for its next task holds little
    env |= {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and later plans know its size."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._folioscan_path = path
    return back


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written(), in buckets by key: grouping or cogrouping by it reads them where they are, without a shuffle.

    Rows of a key should be in one task already, so that each task writes a file for few buckets.
    """
    path, table = new_path(df.sparkSession, name), f"folioscan_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).option("compression", "zstd").saveAsTable(table)
    back = df.sparkSession.table(table)
    back._folioscan_path, back._folioscan_table = path, table
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() and bucketed() that no later plan reads."""
    for t in tables:
        forget(*getattr(t, "_folioscan_parts", ()))
        if table := getattr(t, "_folioscan_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path := getattr(t, "_folioscan_path", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def told_apart(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) with id, the doc_id; where a doc_id has several texts, all doc_ids become numbers in the order
    of doc_id and the text's digest, one for each different pair of them."""
    fp = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    several = texts.select("doc_id", fp.alias("fp")).groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    if several.isEmpty():
        return texts.select("doc_id", F.col("doc_id").alias("id"), "text")
    named = texts.select("doc_id", "text", fp.alias("fp"))
    numbers = named.select("doc_id", "fp").distinct().orderBy("doc_id", "fp")
    numbers = written(numbers.select("doc_id", "fp", F.monotonically_increasing_id().alias("row")), "row-numbers")
    out = named.hint("merge").join(numbers, ["doc_id", "fp"])
    return written(out.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"), "text"), "row-texts")


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Parts so that each holds about per_part rows, at least as many as the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part), 1)


def remainder(doc_id: str, m: int):
    """crc32 of the id as text, modulo m; -1 without an id, so that such rows are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % m, F.lit(-1))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, not at some later collection of the driver's garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
