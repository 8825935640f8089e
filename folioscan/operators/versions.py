"""First-wins dedupe, version chains, diffs and snapshot rewrites."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def new_events(rows: DataFrame, history: DataFrame, order: list, content_hash: str = "content_hash") -> DataFrame:
    """Rows whose content is new: first in the batch, and not in the history. Runs before any costly step."""
    return first_wins(rows, [content_hash], order).join(history.select(content_hash), content_hash, "left_anti")


def _ranges(rows: DataFrame, by: str) -> Column:
    """A number for each of about as many ranges of a column as there are shuffle partitions; 0 for all where it has no such order."""
    if not isinstance(rows.schema[by].dataType, (NumericType, DateType, TimestampType)):
        return F.lit(0)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    if not bounds:
        return F.lit(0)
    kind = rows.schema[by].dataType
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in dict.fromkeys(bounds))), lambda x: x < F.col(by))), F.lit(0))


def version_chain(rows: DataFrame, entity: str, order: list, content_hash: str = "content_hash", last: DataFrame | None = None) -> DataFrame:
    """Rows that change an entity's content, with version_number and is_current.

    order is a total order; its first column is a name. last (entity, version_number, content_hash) continues the chains of an earlier
    table; its own rows are not returned. A scan in two levels: an entity's rows are dealt to ranges of the first order column, each
    range gives its first and last hash and how often the content changes inside, and sums over these rows tell
    every range where its numbers begin. So one entity with most of the rows is spread over tasks.
    """
    p, h = "_part", F.col(content_hash)
    w = Window.partitionBy(entity, p).orderBy(*order)
    rows = rows.select("*", F.explode(F.array(_ranges(rows, order[0]))).alias(p))  # as a generated column the optimizer takes it as it is
    rows = rows.withColumns({"_first": F.row_number().over(w) == 1, "_inner": ~F.lag(content_hash).over(w).eqNullSafe(h)})
    rows = rows.withColumn("_inner", ~F.col("_first") & F.col("_inner"))
    key = F.struct(*order)
    each = rows.groupBy(entity, p).agg(F.min_by(content_hash, key).alias("_from"), F.max_by(content_hash, key).alias("_to"), F.count_if("_inner").alias("_n"))
    by = Window.partitionBy(entity).orderBy(p)
    begins, before, base = F.row_number().over(by) == 1, F.lag("_to").over(by), F.lit(0)
    fresh = ~before.eqNullSafe(F.col("_from"))
    if last is None:
        fresh = begins | fresh
    else:
        each = each.join(last.select(entity, F.col("version_number").alias("_base"), h.alias("_last")), entity, "left")
        fresh = F.when(begins, ~F.col("_last").eqNullSafe(F.col("_from"))).otherwise(fresh)
        base = F.coalesce("_base", F.lit(0))
    each = each.withColumn("_fresh", fresh).withColumn("_n", F.col("_n") + F.col("_fresh").cast("long"))
    each = each.withColumns({"_start": base + F.sum("_n").over(by) - F.col("_n"), "_top": base + F.sum("_n").over(Window.partitionBy(entity))})
    each = each.select(F.col(entity).alias("_entity"), F.col(p).alias("_of"), "_fresh", "_start", "_top")
    kept = rows.hint("merge").join(each, F.col(entity).eqNullSafe(F.col("_entity")) & (F.col(p) == F.col("_of")))
    kept = kept.withColumn("_changed", F.col("_inner") | (F.col("_first") & F.col("_fresh")))
    kept = kept.withColumn("version_number", (F.col("_start") + F.count_if("_changed").over(w)).cast("int")).where("_changed")
    kept = kept.withColumn("is_current", F.col("version_number") == F.col("_top"))
    return kept.drop(p, "_of", "_entity", "_first", "_inner", "_changed", "_fresh", "_start", "_top")


def unseen_versions(rows: DataFrame, versions: DataFrame, entity: str, order: list, content_hash: str = "content_hash") -> DataFrame:
    """Rows whose content no version of their entity had, numbered on from its last."""
    new = first_wins(rows, [entity, content_hash], order).join(versions.select(entity, content_hash).distinct(), [entity, content_hash], "left_anti")
    top = versions.groupBy(entity).agg(F.max("version_number").alias("_top"))
    w = Window.partitionBy(entity).orderBy(*order)
    out = new.join(top, entity, "left").withColumn("version_number", (F.row_number().over(w) + F.coalesce("_top", F.lit(0))).cast("int"))
    return out.withColumn("is_current", F.lead(F.lit(1)).over(w).isNull()).drop("_top")


def appended(old: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """The version table after new versions: old rows of their entities are no longer current."""
    touched = new.select(entity).distinct().withColumn("_touched", F.lit(True))
    rest = old.join(touched, entity, "left").withColumn("is_current", F.col("is_current") & F.col("_touched").isNull()).drop("_touched")
    return rest.unionByName(new.select(old.columns))


#: A batch of diffs goes back to Spark once it has so many rows or characters.
DIFF_ROWS, DIFF_CHARS = 256, 1 << 20


@F.arrow_udf(StringType())
def unified_diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A unified diff with three lines of context; null for equal texts and if either is missing or empty before.

    Texts stay in Spark's Arrow batch (of 64 MB at most, unless the session or one text says more) and become Python's one row at a
    time; diffs go back in small batches, so that a worker's memory does not grow with the table.
    """
    for olds, news in batches:
        done, chars = [], 0
        for old, new in zip(olds, news, strict=True):
            a, b = old.as_py(), new.as_py()
            diff = None if not a or b is None or a == b else "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "previous", "current", n=3, lineterm=""))
            done.append(diff)
            chars += len(diff or "")
            if len(done) == DIFF_ROWS or chars >= DIFF_CHARS:
                yield pa.array(done, pa.string())
                done, chars = [], 0
        if done:
            yield pa.array(done, pa.string())


def with_diff(versions: DataFrame, entity: str, text: str = "text") -> DataFrame:
    before = F.lag(text).over(Window.partitionBy(entity).orderBy("version_number"))
    return versions.withColumn("_before", before).withColumn("diff", unified_diff("_before", text)).drop("_before")


def changed_lines(old: Column, new: Column) -> tuple[Column, Column]:
    """(distinct lines added, distinct lines removed), without Python."""
    a, b = (F.split(F.coalesce(c, F.lit("")), "\n") for c in (old, new))
    return F.size(F.array_except(b, a)), F.size(F.array_except(a, b))


def compare_versions(versions: DataFrame, entity: str, a: int, b: int, text: str = "text") -> DataFrame:
    """entity, diff between two version numbers: null if one is missing, empty if they are equal."""
    one, two = (versions.where(F.col("version_number") == n).select(entity, F.col(text).alias(c)) for n, c in ((a, "_a"), (b, "_b")))
    both = versions.select(entity).distinct().join(one, entity, "left").join(two, entity, "left")
    return both.select(entity, F.when(F.col("_a") == F.col("_b"), "").otherwise(unified_diff("_a", "_b")).alias("diff"))


def upsert(old: DataFrame, new: DataFrame, key: str, protect: list[str] | None = None, seeded: str = "source") -> DataFrame:
    """The snapshot after new rows by key; protected columns keep the old value unless the old row is SEED-sourced."""
    cols = [c for c in old.columns if c != key]
    o, n = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in cols)), new.select(key, *(F.col(c).alias(f"_n_{c}") for c in cols), F.lit(True).alias("_new"))
    j = o.join(n, key, "full_outer")

    def value(c):
        new_value, old_value = F.col(f"_n_{c}"), F.col(f"_o_{c}")
        picked = F.when(F.col("_new"), new_value).otherwise(old_value)
        if c in (protect or []):
            picked = F.when(F.col("_new") & old_value.isNotNull() & (F.coalesce(F.col(f"_o_{seeded}"), F.lit("")) != "SEED"), old_value).otherwise(picked)
        return picked.alias(c)

    return j.select(key, *(value(c) for c in cols))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(old.columns))


def provenance(old: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """key, first_seen, last_seen, first_run, last_run from two tables (key, at, run)."""
    return old.unionByName(seen).groupBy(*key).agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.min_by("run", F.struct("at", "run")).alias("first_run"), F.max_by("run", F.struct("at", "run")).alias("last_run"))


def evolve(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Additive schema change: missing columns with their default literals, nulls of old rows filled."""
    for c, v in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    return rows
