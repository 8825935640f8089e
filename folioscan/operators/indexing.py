"""The search index of a catalog's versions: chunks with their catalog values, and postings; built anew or for some entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, retrieval

COPIED = ["stage", "topic", "kinds"]
#: Rows of a catalog that is broadcast, so that texts are not shuffled.
MOST_ENTITIES = 250_000


def build_index(versions: DataFrame, catalog: DataFrame, tokens: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of versions (version_id, entity_id, text, protected) with a chunk_id, their language and the stage, topic and kinds of
    their entity in the catalog. Protected versions and blank texts have none; versions of unknown entities have null values."""
    rows = versions.where(~F.coalesce("protected", F.lit(False)) & F.col("version_id").isNotNull())
    rows = rows.select(F.struct(F.col("version_id"), F.col("entity_id")).alias("_of"), "text")
    cuts = chunking.chunk(rows, "_of", tokens=tokens, overlap=overlap).select("_of.version_id", "_of.entity_id", "*").drop("_of")
    values = catalog.select("entity_id", *COPIED)
    values = F.broadcast(values) if values.limit(MOST_ENTITIES + 1).count() <= MOST_ENTITIES else values.hint("merge")
    chunks = cuts.join(values, "entity_id", "left")
    return chunks.withColumns({"chunk_id": F.xxhash64("version_id", "chunk_index"), "language": T.language(F.col("text")), "n_terms": F.size(retrieval.terms(F.col("text")))})


def index_postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, version_id, term, tf, n_terms: the text index of chunks, with the version so that it can be replaced with it.

    A chunk's words are sorted and counted within its row, so nothing is shuffled. Generated columns are taken by the optimizer as they are.
    """
    of = ["chunk_id", "version_id"]
    words = chunks.select(*of, F.explode(F.array(F.sort_array(retrieval.terms(F.col("text"))))).alias("t")).where(F.size("t") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = words.select(*of, "t", F.explode(F.array(begins)).alias("b"))
    ends = F.concat(F.slice("b", 2, F.size("b")), F.array(F.size("t")))
    each = F.arrays_zip(F.transform("b", lambda i: F.get("t", i)).alias("term"), F.col("b").alias("begin"), ends.alias("end"))
    rows = runs.select(*of, F.size("t").alias("n_terms"), F.explode(each).alias("p"))
    return rows.select(*of, "p.term", (F.col("p.end") - F.col("p.begin")).cast("long").alias("tf"), "n_terms")


def reindex(chunks: DataFrame, versions: DataFrame, catalog: DataFrame, entities: DataFrame, tokens: int = 500, overlap: int = 50) -> DataFrame:
    """chunks with those of all versions of these entities wiped and built again; protected versions are wiped only."""
    chosen = versions.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    kept = chunks.join(chosen.select("version_id").distinct(), "version_id", "left_anti")
    return kept.unionByName(build_index(chosen, catalog, tokens, overlap).select(chunks.columns))
