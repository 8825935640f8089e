"""Landed feeds and query results as tables of items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D

CONSULTATION_WORDS = ("consultation", "feedback", "call for evidence")
DOMAIN_WORDS = ("financ", "cssf", "investissement")
ITEM = "title string, link string, description string, pubDate string, updated string"
BINDINGS = "head struct<vars: array<string>>, results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Register fetch(spark, since, **options) -> DataFrame of items under a name, for fetch_sources()."""

    def add(f):
        if REGISTRY.get(name, f) is not f:
            raise ValueError(f"there is another source {name}")
        REGISTRY[name] = f
        return f

    return add


def fetch_sources(spark: SparkSession, since: Column, options: dict[str, dict], only: list[str] | None = None, groups: dict[str, list[str]] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """(items of the registered sources, errors by name): of all that options enables (its "enabled" is not false), or of those named in only.

    options holds each source's own arguments. A source that can't be fetched is an error by its name and the others go on; a
    name that nobody registered is an error of the call. Items are those not older than since, whatever a source gives, with its name as `source`.
    """
    own = {n: {k: v for k, v in o.items() if k != "enabled"} for n, o in options.items()}
    enabled = {n: o.get("enabled", True) for n, o in options.items()}
    names = selected(list(REGISTRY), enabled, only, groups)

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: REGISTRY[name](spark, since, **own.get(name, {})).where(F.col("published_at") >= since).withColumn("source", F.lit(name))

    return union_sources({n: reader(n) for n in names})


def read_rss(spark: SparkSession, path: str | list[str], now: Column, source_name: str) -> DataFrame:
    """title, link, description, published_at, feed, source of the items of landed XML feeds."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    return items.select("title", "link", "description", D.feed_date(F.col("pubDate"), F.col("updated"), now).alias("published_at"), F.col("_metadata.file_path").alias("feed"), F.lit(source_name).alias("source"))


@source("rss")
def fetch_rss(spark: SparkSession, since: Column, path: str | list[str], now: Column) -> DataFrame:
    """Items with a link of landed XML feeds, the first of each link."""
    items = recent(read_rss(spark, path, now, "rss"), since)
    return first_links(items, ["feed", "published_at", "title"]).select("title", "link", "published_at")


@source("sparql")
def fetch_sparql(spark: SparkSession, since: Column, path: str, prefix: str | None = None) -> DataFrame:
    """Acts of landed query results, by id prefix."""
    rows = read_sparql(spark, path, {"celex": ["celex"], "title": ["title"], "date": ["date"]})
    return acts(rows, since, prefix).select("title", "link", "published_at")


def recent(items: DataFrame, since: Column) -> DataFrame:
    """Items with a link that aren't older than since."""
    return items.where(F.col("link").isNotNull() & (F.trim("link") != "") & (F.col("published_at") >= since))


def first_links(items: DataFrame, order: list) -> DataFrame:
    """The first item of each link over all feeds, in feed and item order."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy("link").orderBy(*order))).where("_n = 1").drop("_n")


def with_words(items: DataFrame, words: tuple[str, ...] = CONSULTATION_WORDS) -> DataFrame:
    text, out = F.lower(F.concat_ws(" ", "title", "description")), F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return items.where(out)


def bindings(raw: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """A column for each name, from the first of its variables that a result row binds; raw has results.bindings."""
    rows = raw.select(F.explode("results.bindings").alias("b"))
    return rows.select(*(F.coalesce(*(F.col("b")[v]["value"] for v in vs)).alias(n) for n, vs in names.items()))


def read_sparql(spark: SparkSession, path: str, names: dict[str, list[str]]) -> DataFrame:
    return bindings(spark.read.schema(BINDINGS).option("multiLine", True).json(path), names)


def acts(rows: DataFrame, since: Column, prefix: str | None = None, ids: list[str] | None = None, most: int | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """Items from (celex, title, date): by id prefix or list, not older than since, newest first, most rows at most."""
    out = rows.withColumn("published_at", D.iso_timestamp(F.col("date"))).where(F.col("published_at") >= since)
    if prefix:
        out = out.where(F.startswith("celex", F.lit(prefix)))
    if ids:
        out = out.where(F.col("celex").isin(ids))
    if words:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower("title"), F.lit(w))
        out = out.where(hit)
    out = out.withColumn("link", F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), F.col("celex")))
    return out.orderBy(F.desc("published_at"), "celex").limit(most) if most else out


def select_sources(items: dict[str, DataFrame], enabled: dict[str, bool], only: list[str] | None = None, groups: dict[str, list[str]] | None = None) -> list[DataFrame]:
    """The tables of enabled sources, or of those named (or in a named group) alone."""
    return [items[n] for n in selected(list(items), enabled, only, groups)]


def selected(known: list[str], enabled: dict[str, bool], only: list[str] | None = None, groups: dict[str, list[str]] | None = None) -> list[str]:
    """The names of enabled sources, or those given (each may be a group), each once; unknown ones are an error."""
    names = [n for o in only or [] for n in (groups or {}).get(o, [o])] if only else [n for n, on in enabled.items() if on]
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown sources: {unknown}")
    return list(dict.fromkeys(names))


def union_sources(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(the union of all sources that can be read, the errors of the others by name)."""
    out, errors = None, {}
    for name, read in readers.items():
        try:
            one = read()
            one.schema  # noqa: B018  analysis happens here
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out, errors


SEED = "reference_number string, type string, celex_id string, eli_uri string, title string, issuing_authority string, is_ict boolean, url string, applicability string, aliases array<struct<pattern: string, kind: string>>"


def seed_tables(seed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, aliases, applicability) from nested seed rows."""
    kind = F.when(F.col("applicability") == "AIFM_ONLY", "AIFM").when(F.col("applicability") == "MANCO_ONLY", "CHAPTER15_MANCO").otherwise("BOTH")
    aliases = seed.select("reference_number", F.posexplode("aliases").alias("ord", "a")).select("reference_number", "ord", "a.pattern", "a.kind")
    return seed.drop("aliases", "applicability").withColumn("source", F.lit("SEED")), aliases, seed.select("reference_number", kind.alias("kind"))
