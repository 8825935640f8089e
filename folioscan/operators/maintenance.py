"""Status changes, overrides, write-backs, registries and retention as snapshot jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def set_status(rows: DataFrame, ids: DataFrame, key: str, status: str, at: Column) -> DataFrame:
    """Rows whose key is in ids get the status and its time; others are unchanged."""
    hit = rows.join(ids.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    return hit.withColumns({"status": F.when(F.col("_hit"), status).otherwise(F.col("status")), "status_at": F.when(F.col("_hit"), at).otherwise(F.col("status_at"))}).drop("_hit")


def mark_all(rows: DataFrame, status: str, becomes: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows with every row of a status changed, the number of changed rows)."""
    hit = F.col("status") == status
    changed = rows.agg(F.count_if(hit).alias("n_changed"))
    return rows.withColumns({"status_at": F.when(hit, at).otherwise(F.col("status_at")), "status": F.when(hit, becomes).otherwise(F.col("status"))}), changed


def set_done(rows: DataFrame, done: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """done: (key, kind, done); kinds: the flag column of each kind."""
    pick = [F.max(F.when(F.col("kind") == k, F.col("done"))).alias(f"_{c}") for k, c in kinds.items()]
    j = rows.join(done.groupBy(key).agg(*pick), key, "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in kinds.values()}).drop(*(f"_{c}" for c in kinds.values()))


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """One row for each (reference, action): the newest."""
    w = Window.partitionBy("reference", "action").orderBy(F.desc("created_at"), F.desc("override_id"))
    return overrides.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_overrides(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """EXCLUDE drops rows; SET_ICT and UNSET_ICT decide the topic flag, the newer of the two."""
    o = latest_overrides(overrides)
    flag = o.where(F.col("action").isin("SET_ICT", "UNSET_ICT")).groupBy("reference").agg(F.max_by("action", F.struct("created_at", "override_id")).alias("_a"))
    out = catalog.join(o.where("action = 'EXCLUDE'").select("reference"), "reference", "left_anti").join(flag, "reference", "left")
    return out.withColumn("topic", F.when(F.col("_a") == "SET_ICT", True).when(F.col("_a") == "UNSET_ICT", False).otherwise(F.col("topic"))).drop("_a")


def refresh_metadata(catalog: DataFrame, details: DataFrame) -> DataFrame:
    """Titles and topic flags of re-read details (reference, title, topic) for rows that aren't SEED-sourced, with a changed flag."""
    d = details.select("reference", F.col("title").alias("_t"), F.col("topic").alias("_k"))
    j = catalog.join(d, "reference", "left")
    may = (F.col("source") != "SEED") & F.col("_t").isNotNull()
    title, topic = may & ~F.col("_t").eqNullSafe(F.col("title")), may & F.col("_k") & ~F.col("topic")
    return j.withColumn("changed", F.coalesce(title | topic, F.lit(False))).withColumns({"topic": F.coalesce(topic, F.lit(False)) | F.col("topic"), "title": F.when(F.coalesce(title, F.lit(False)), F.col("_t")).otherwise(F.col("title"))}).drop("_t", "_k")


def reclassify(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """reference, topic, needs_review, outcome of the word rule on web-sourced rows; overrides win."""
    o = latest_overrides(overrides).where(F.col("action").isin("SET_ICT", "UNSET_ICT")).select("reference", "action")
    j = catalog.where("source = 'WEB'").join(o, "reference", "left")
    new = F.when(F.col("action") == "SET_ICT", True).when(F.col("action") == "UNSET_ICT", False).otherwise(T.topic_by_word(F.col("title"), F.coalesce("description", F.lit(""))))
    outcome = F.when(F.col("action").isNotNull(), "overridden").when(new & ~F.col("topic"), "set").when(~new & F.col("topic"), "unset").otherwise("same")
    return j.select("reference", outcome.alias("outcome"), new.alias("topic"), (~new).alias("needs_review"))


def classify_results(results: DataFrame, overrides: DataFrame, pillars: tuple[str, ...] = ("ICT_RISK", "INCIDENT", "TESTING", "THIRD_PARTY", "INFO_SHARING")) -> DataFrame:
    """Model classifications (reference, topic, confidence, pillar) as catalog values: overrides first, excluded skipped, low confidence to review."""
    o = latest_overrides(overrides)
    flag = o.where(F.col("action").isin("SET_ICT", "UNSET_ICT")).select("reference", "action")
    j = results.join(o.where("action = 'EXCLUDE'").select("reference"), "reference", "left_anti").join(flag, "reference", "left")
    topic = F.when(F.col("action") == "SET_ICT", True).when(F.col("action") == "UNSET_ICT", False).otherwise(F.col("topic"))
    return j.select("reference", topic.alias("topic"), (F.col("action").isNull() & (F.col("confidence") < 0.7)).alias("needs_review"), F.when(topic & F.col("pillar").isin(*pillars), F.col("pillar")).alias("pillar"))


def suggested(replies: DataFrame, catalog: DataFrame, overrides: DataFrame, kinds: tuple[str, ...], default: str) -> DataFrame:
    """Suggested rows (reference, kind) that are new and not excluded, each once; unknown kinds get the default."""
    r = replies.where(F.trim("reference") != "").groupBy(F.trim("reference").alias("reference")).agg(F.min("kind").alias("kind"))
    r = r.join(catalog.select("reference"), "reference", "left_anti").join(overrides.where("action = 'EXCLUDE'").select("reference"), "reference", "left_anti")
    return r.withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(default))


def refresh_catalog(catalog: DataFrame, results: DataFrame, replies: DataFrame, overrides: DataFrame, kinds: tuple[str, ...], default: str, cancelled: bool = False) -> DataFrame:
    """reference, topic, needs_review, pillar, kind, suggested: the catalog with all model classifications written back, then the rows
    that the model found missing, to be reviewed. A cancelled run has the classifications only."""
    c = classify_results(results, overrides).select("reference", F.col("topic").alias("_topic"), "needs_review", "pillar")
    known = catalog.join(c, "reference", "left").select(
        "reference", F.coalesce("_topic", "topic").alias("topic"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), "pillar", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("suggested")
    )
    if cancelled:
        return known
    new = suggested(replies, catalog, overrides, kinds, default)
    return known.unionByName(new.select("reference", F.lit(None).cast("boolean").alias("topic"), F.lit(True).alias("needs_review"), F.lit(None).cast("string").alias("pillar"), "kind", F.lit(True).alias("suggested")))


def write_back(catalog: DataFrame, current: DataFrame, analyses: DataFrame, overrides: DataFrame, resolved: DataFrame) -> DataFrame:
    """Catalog after analyses (entity_id, version_id, topic, deadline, relation, replaces) of current versions.

    An override decides the topic flag; the deadline is the transposition deadline of a directive whose relation is none, NEW,
    REPLACES or AMENDS, else the application date; a replaced entity (resolved: ref, target_id) gets replaced_by, never itself.
    """
    a = analyses.join(current.select("entity_id", "version_id"), ["entity_id", "version_id"], "left_semi")
    o = latest_overrides(overrides).where(F.col("action").isin("SET_ICT", "UNSET_ICT")).select("reference").distinct().withColumn("_o", F.lit(True))
    j = catalog.join(a.select("entity_id", F.col("topic").alias("_t"), F.col("deadline").alias("_d"), "relation"), "entity_id", "left").join(o, "reference", "left")
    directive = T.is_directive(F.col("kind"), F.col("celex_id")) & (F.col("relation").isNull() | F.col("relation").isin("NEW", "REPLACES", "AMENDS"))
    j = j.withColumns(
        {
            "topic": F.when(F.col("_o").isNull(), F.coalesce("_t", "topic")).otherwise(F.col("topic")),
            "transposition_deadline": F.when(directive, F.coalesce("_d", "transposition_deadline")).otherwise(F.col("transposition_deadline")),
            "application_date": F.when(~directive, F.coalesce("_d", "application_date")).otherwise(F.col("application_date")),
        }
    ).drop("_t", "_d", "_o", "relation")
    r = a.where("relation = 'REPLACES'").join(resolved, F.col("replaces") == F.col("ref")).where("target_id <> entity_id")
    r = r.groupBy(F.col("target_id").alias("entity_id")).agg(F.max("entity_id").alias("replaced_by"))
    return j.join(r, "entity_id", "left")


def sweep_runs(runs: DataFrame, cutoff: Column, status: str = "FAILED", note: str = "stopped: no progress") -> DataFrame:
    """RUNNING runs that began before the cutoff, or whose start is unknown, get the status and a note."""
    stale = (F.col("status") == "RUNNING") & F.coalesce(F.col("started_at") <= cutoff, F.lit(True))
    return runs.withColumns({"error": F.when(stale, F.concat_ws("\n", "error", F.lit(note))).otherwise(F.col("error")), "status": F.when(stale, status).otherwise(F.col("status"))})


def register(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New keys only; existing rows, active or not, stay as they are."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti").select(rows.columns))


def update_registry(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial updates: each column c changes where set_c is true, to null as well."""
    c = changes.select(key, *(F.col(x).alias(f"_{x}") for x in columns), *(F.col(f"set_{x}").alias(f"_set_{x}") for x in columns))
    j = rows.join(c, key, "left")
    out = j.withColumns({x: F.when(F.coalesce(f"_set_{x}", F.lit(False)), F.col(f"_{x}")).otherwise(F.col(x)) for x in columns})
    return out.select(rows.columns)


def patch_values(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """A legacy value of an array column by its new name."""
    return rows.withColumn(column, F.transform(column, lambda x: F.when(x == old, new).otherwise(x)))


def keep_newest(parents: DataFrame, children: DataFrame, key: str, order: list, group: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the n newest parents of each group, their children)."""
    kept = parents.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    return kept, children.join(kept.select(key), key, "left_semi")


def cascade(parents_gone: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return children.join(parents_gone.select(key).distinct(), key, "left_anti")


def replace_text(versions: DataFrame, supplied: DataFrame, at: Column) -> DataFrame:
    """Texts supplied by hand for versions (version_id, text): flagged and dated, the content hash stays."""
    s = supplied.select("version_id", F.col("text").alias("_new"))
    j = versions.join(s, "version_id", "left")
    given = F.col("_new").isNotNull()
    return j.withColumns({"manual": given | F.coalesce("manual", F.lit(False)), "fetched_at": F.when(given, at).otherwise(F.col("fetched_at")), "text": F.coalesce("_new", "text")}).drop("_new")


def admit(files: DataFrame, entities: DataFrame, most_bytes: int, nothing: Column | None = None) -> DataFrame:
    """Uploads (name, entity_id, n_bytes, extracted, raw) with reason (null: accepted) and the text to keep.

    That is the extracted text as it is, or the raw one of files in which the extraction found nothing: `nothing`, by default where extracted is blank.
    """
    nothing = F.coalesce(F.trim("extracted"), F.lit("")) == "" if nothing is None else F.coalesce(nothing, F.lit(False))
    j = files.join(entities.select("entity_id").distinct().withColumn("_known", F.lit(True)), "entity_id", "left")
    kind = F.lower(F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1))
    reason = F.when(~kind.isin(".pdf", ".html", ".htm"), "unsupported type").when(F.col("n_bytes") > most_bytes, "too large").when(F.col("_known").isNull(), "unknown entity")
    return j.withColumns({"reason": reason, "text": F.when(nothing, F.col("raw")).otherwise(F.col("extracted"))}).drop("_known")


def defaults_if_empty(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    return defaults.select(rows.columns) if rows.isEmpty() else rows


def last_visits(visits: DataFrame) -> DataFrame:
    """view, visited_at, previous: each visit and the one before it."""
    return visits.withColumn("previous", F.lag("visited_at").over(Window.partitionBy("view").orderBy("visited_at")))
