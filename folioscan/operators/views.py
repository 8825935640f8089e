"""Catalog, inbox, deadline and run views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V

STAGES = ("CONSULTATION", "PROPOSAL", "DRAFT_BILL", "ADOPTED_NOT_IN_FORCE", "IN_FORCE", "AMENDED", "REPEALED")


def applies_to(catalog: DataFrame, bridge: DataFrame, kind: str) -> DataFrame:
    """Catalog rows whose bridge (entity_id, kind) has the kind or BOTH; each once."""
    return catalog.join(bridge.where(F.col("kind").isin(kind, "BOTH")), "entity_id", "left_semi")


def catalog_filter(topic: bool | None = None, stages: list[str] | None = None, search: str | None = None) -> Column:
    out = F.lit(True)
    if topic is not None:
        out = out & (F.col("topic") == topic)
    if stages:
        out = out & F.col("stage").isin(stages)
    if search:
        like = "%" + search.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
        out = out & (F.col("reference").ilike(like) | F.col("title").ilike(like))
    return out


def stage_argument(value: str | None) -> list[str] | None:
    """None for all; a known stage alone; anything else means in force."""
    return None if value == "all" else [value] if value in STAGES else ["IN_FORCE"]


def inbox(events: DataFrame, mine: Column | None = None, show_all: bool = False, one_kind: str | None = None, source: str | None = None, severity: str | None = None) -> DataFrame:
    """NEW events, most severe first, then the newest."""
    out = events.where("status = 'NEW'").withColumn("source_name", T.display_name(F.col("source")))
    if source:
        out = out.where(F.col("source_name") == source)
    if severity:
        out = out.where(F.col("severity") == severity)
    if mine is not None and not show_all:
        out = out.where(V.overlaps_or_all(F.col("kinds"), mine))
    if one_kind:
        out = out.where(V.contains_or_all(F.col("entity_kinds"), one_kind))
    return out.orderBy(T.severity_rank(F.col("severity")), F.desc_nulls_last("published_at"))


def since(created: Column, cutoff: Column) -> Column:
    """New since the last visit; without a visit nothing is new."""
    return F.coalesce(created > cutoff, F.lit(False))


def deadlines(rows: DataFrame, as_of: Column, window: int, done: bool = False, kinds: tuple[tuple[str, str, str], ...] = (("TRANSPOSITION", "transposition_deadline", "transposition_done"), ("APPLICATION", "application_date", "application_done"))) -> DataFrame:
    """One row for each date of an entity: kind, due, days_until (negative: overdue), band; by days."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(d).cast("date").alias("due"), F.col(x).alias("done")) for k, d, x in kinds)))
    out = rows.select("*", each.alias("_d")).select(*rows.columns, "_d.kind", "_d.due", "_d.done").where("due is not null")
    out = out.withColumn("days_until", F.datediff("due", as_of)).where(F.col("days_until") <= window)
    out = out if done else out.where(~F.coalesce("done", F.lit(False)))
    return out.withColumn("band", D.band(F.col("days_until"))).orderBy("days_until")


def badges(events: DataFrame, catalog: DataFrame, cutoffs: dict[str, str | None], as_of: Column) -> DataFrame:
    """One row of counts: NEW events and catalog changes after each view's cutoff (none: 0), and open deadlines in 730 days."""
    at = lambda c: F.lit(cutoffs.get(c)).cast("timestamp")
    due = lambda c, d: F.datediff(F.col(c), as_of).between(-100000, 730) & ~F.coalesce(F.col(d), F.lit(False))
    e = events.agg(F.count_if((F.col("status") == "NEW") & since(F.col("fetched_at"), at("inbox"))).alias("inbox"))
    c = catalog.agg(
        F.count_if(since(F.col("created_at"), at("catalog"))).alias("catalog"),
        F.count_if(F.col("stage").isin("CONSULTATION", "PROPOSAL", "DRAFT_BILL") & since(F.col("created_at"), at("drafts"))).alias("drafts"),
        F.count_if(F.col("topic") & since(F.col("created_at"), at("topic"))).alias("topic"),
        F.count_if((due("transposition_deadline", "transposition_done") | due("application_date", "application_done")) & since(F.col("created_at"), at("deadlines"))).alias("deadlines"),
    )
    return e.join(c, F.lit(True))


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def freshness(entities: DataFrame, analyses: DataFrame, current: DataFrame) -> DataFrame:
    """never, failed, stale (the latest analysis isn't of the current version) or ok for each entity."""
    last = latest(analyses, "entity_id", [F.desc("created_at"), F.desc("analysis_id")]).select("entity_id", F.col("status").alias("_s"), F.col("version_id").alias("_v"))
    j = entities.join(last, "entity_id", "left").join(current.select("entity_id", F.col("version_id").alias("_c")), "entity_id", "left")
    return j.withColumn("freshness", F.when(F.col("_s").isNull(), "never").when(F.col("_s") == "FAILED", "failed").when(~F.col("_v").eqNullSafe(F.col("_c")), "stale").otherwise("ok")).drop("_s", "_v", "_c")


def analysis_status(items: DataFrame) -> DataFrame:
    """run_id, status, n_ok, n_failed, errors of analysis runs."""
    ok = F.count_if(F.col("status") == "SUCCESS")
    errors = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("analysis_id", "error"))), lambda x: x["error"]), "\n")
    return items.groupBy("run_id").agg(ok.alias("n_ok"), (F.count(F.lit(1)) - ok).alias("n_failed"), errors.alias("errors")).withColumn("status", F.when(F.col("n_failed") == 0, "SUCCESS").when(F.col("n_ok") == 0, "FAILED").otherwise("PARTIAL"))


def pipeline_status(items: DataFrame) -> DataFrame:
    """Totals of each run from one row for each source (run_id, source, n_events, n_versions, error), and its status."""
    per = items.groupBy("run_id").agg(F.sum("n_events").alias("n_events"), F.sum("n_versions").alias("n_versions"), F.sort_array(F.collect_list("source")).alias("attempted"), F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.col("source")))).alias("failed"))
    return per.withColumn("status", F.when(F.size("failed") == 0, "COMPLETED").when(F.size("failed") == F.size("attempted"), "ABORTED").otherwise("COMPLETED_WITH_ERRORS"))


def scope(catalog: DataFrame, bridge: DataFrame, mine: Column) -> DataFrame:
    """Catalog with its sorted kinds, whether they overlap mine, and whether it is in force."""
    kinds = bridge.groupBy("entity_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    j = catalog.join(kinds, "entity_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    return j.withColumns({"in_scope": F.arrays_overlap("kinds", mine), "in_force": F.col("stage") == "IN_FORCE"})


def document_url(stored: Column, pdf: Column, celex: Column, language: str = "EN") -> Column:
    """A stored PDF, else a parsed PDF link, else the address made from the identifier, else what is stored; null: no document."""
    made = F.concat(F.lit(f"https://eur-lex.europa.eu/legal-content/{language}/TXT/HTML/?uri=CELEX:"), celex)
    return F.coalesce(F.when(F.lower(stored).endswith(".pdf"), stored), pdf, made, F.nullif(stored, F.lit("")))


def page_url(ref: Column, source: Column, base: str) -> Column:
    """The detail page of web-sourced rows only: by reference slug, else by the reference itself."""
    return F.when(source == "WEB", F.concat(F.lit(base), F.coalesce(T.reference_slug(ref), ref), F.lit("/")))


def link_kinds(url: Column) -> tuple[Column, Column]:
    """(PDF address, source address): one of them."""
    pdf = F.when(F.lower(url).endswith(".pdf"), url)
    return pdf, F.when(pdf.isNull(), url)
