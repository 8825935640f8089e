"""Incremental ingest: landed items in, events, links and versions out, with state by content hash and entity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def landed(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """A stream of new Parquet files; its checkpoint takes the place of polling again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def without_copies(items: DataFrame, content_hash: str = "content_hash", at: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first item of each content. With a time column, state older than the delay is dropped; without, it is kept for ever."""
    if at is None:
        return items.dropDuplicates([content_hash])
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark([content_hash])


def not_late(items: DataFrame, at: str, since: Column, delay: str) -> DataFrame:
    return items.withWatermark(at, delay).where(F.col(at) >= since)


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Take up what has landed, a batch at a time, and stop."""
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()


def to_folder(out: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch to a folder of its own; a repeated batch overwrites it."""

    def save(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return save


VERSION = "entity string, doc_id long, version_number int, content_hash string"


def versions(items: DataFrame) -> DataFrame:
    """entity, doc_id, version_number, content_hash for each item that changes its entity's content; state is the last hash and number."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("doc_id")
        out = []
        for doc_id, h in zip(rows["doc_id"], rows["content_hash"], strict=True):
            if h != last:
                last, n = h, n + 1
                out.append((key[0], doc_id, n, h))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["entity", "doc_id", "version_number", "content_hash"])

    return items.groupBy("entity").applyInPandasWithState(step, VERSION, "last string, n int", "append", GroupStateTimeout.NoTimeout)
