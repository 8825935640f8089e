"""Listing and detail pages of publications as rows: nodes are read from the page's tree, the rules over their texts are column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dates as D
from ..functions import text as T
from .html_tree import Node, tree

# The class names of the pages' elements, and how a page says that a document amends this one.
ITEM, ITEM_TITLE, ITEM_SUBTITLE, ITEM_DATE = "library-element", "library-element__title", "library-element__subtitle", "date--published"
TITLE, SUBTITLE, HEADER, ENTITIES = "single-news__title", "single-news__subtitle", "content-header-info", "entities-list"
RELATED_BOX, RELATED, OWN_FILES, RELATED_TITLE, RELATED_EXCERPT = "related-documents-container", "related-document", "no-heading", "related-document-title", "related-document-excerpt"
BODIES = ("single-news__content", "single-document__content", "entry-content")
AMENDING = ("amending", "amend circular")
REFERENCE = r"(?i)(?:Circular\s+)?(?:CSSF|IML)\s+\d{2,4}[/-]\d+"

LISTED = "raw_count int, rows array<struct<title:string,href:string,subtitle:string,date:string>>"
DETAIL = "title string, header string, entities array<string>, files array<string>, related array<struct<title:string,excerpt:string>>, subtitle string, paragraphs array<string>"


def _text(node: Node | None) -> str:
    return node.text() if node is not None else ""


def listed(html: str | None) -> dict:
    items = [n for n in tree(html).find("li") if ITEM in n.classes]
    rows = []
    for item in items:
        a = next((a for box in item.find(cls=ITEM_TITLE) for a in box.find("a")), None)
        if a is not None and a.attrs.get("href"):
            rows.append({"title": a.text(), "href": a.attrs["href"], "subtitle": _text(item.first(cls=ITEM_SUBTITLE)), "date": _text(item.first(cls=ITEM_DATE))})
    return {"raw_count": len(items), "rows": rows}


def detailed(html: str | None) -> dict:
    root = tree(html)
    title = next((n for n in root.find("h1") if TITLE in n.classes), None) or root.first("h1")
    header, subtitle = root.first(cls=HEADER), root.first(cls=SUBTITLE)
    own = next((n for n in root.find("li", RELATED) if OWN_FILES in n.classes), None)
    related = [n for box in root.find(cls=RELATED_BOX) for n in box.find("li", RELATED) if OWN_FILES not in n.classes]
    paragraphs = [p.text() for cls in BODIES for box in root.find(cls=cls) for p in box.find("p")] + [p.text() for box in root.find("article") for p in box.find("p")]
    return {
        "title": _text(title),
        "header": _text(header) if header is not None else root.text(),
        "entities": list(dict.fromkeys(t for box in root.find(cls=ENTITIES) for li in box.find("li") if (t := li.text()))),
        "files": [a.attrs["href"] for a in own.find("a") if a.attrs.get("href")] if own is not None else [],
        "related": [{"title": h.text(), "excerpt": _text(n.first(cls=RELATED_EXCERPT))} for n in related if (h := next((h for h in n.find("h4") if RELATED_TITLE in h.classes), None)) is not None],
        "subtitle": _text(subtitle and (subtitle.first("p") or subtitle)) if subtitle is not None else "",
        "paragraphs": paragraphs,
    }


def _read(find: Callable[[str | None], dict], schema: str):
    names = [f.name for f in StructType.fromDDL(schema).fields]

    @F.pandas_udf(schema)
    def read(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            yield pd.DataFrame([find(h) for h in s], columns=names)

    return read


def listing(pages: DataFrame, key: str, html: str, base: str = "", pattern: str = REFERENCE) -> DataFrame:
    """key, raw_count, pos, title, link, reference, subtitle, published_on for each element of a listing page with a reference in its title.

    raw_count is the number of elements, with or without one; a page without such rows has one row with a null pos, so that a page past
    the end (raw_count 0) shows.
    """
    p = pages.select(key, _read(listed, LISTED)(F.col(html)).alias("p")).select(key, "p.raw_count", F.col("p.rows").alias("rows"))
    fits = F.filter("rows", lambda r: r["title"].rlike(pattern))
    rows = p.select(key, "raw_count", F.posexplode_outer(fits).alias("pos", "r"))
    link = F.when(F.col("r.href").rlike("^[a-z]+:"), F.col("r.href")).otherwise(F.concat(F.lit(base), F.col("r.href")))
    return rows.select(key, "raw_count", "pos", F.col("r.title").alias("title"), link.alias("link"), T.canonical_reference(F.regexp_extract("r.title", pattern, 0)).alias("reference"), F.col("r.subtitle").alias("subtitle"), D.dotted_date(F.col("r.date")).alias("published_on"))


def detail(pages: DataFrame, key: str, html: str, pattern: str = REFERENCE) -> DataFrame:
    """key, reference, title, amended_by, amends, entities, pdf_en, pdf_fr, published_on, updated_on, description of detail pages.

    amends: the first reference of each related document but this one and those whose excerpt says that they amend it, in order.
    """
    p = pages.select(key, _read(detailed, DETAIL)(F.col(html)).alias("p")).select(key, "p.*")
    title, amended_by = T.split_amended(F.col("title"), pattern)
    first = lambda c: T.canonical_reference(F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")))
    p = p.withColumns({"clean": F.trim(F.regexp_replace(title, r"\s+", " ")), "amended": F.array_distinct(F.transform(amended_by, T.canonical_reference))})
    p = p.withColumn("reference", F.coalesce(first(F.col("clean")), first(F.col("title"))))
    labelled = F.transform("related", lambda r: F.struct(F.when(F.lower(r["excerpt"]).rlike("|".join(AMENDING)), "amended by").otherwise("related").alias("label"), first(r["title"]).alias("ref")))
    pdf_en, pdf_fr = T.pdf_links(F.col("files"))
    published, updated = D.header_dates(F.col("header"))
    amends = T.related_references(labelled, F.coalesce("reference", F.lit("")))
    return p.select(key, "reference", F.col("clean").alias("title"), F.col("amended").alias("amended_by"), amends.alias("amends"), "entities", pdf_en.alias("pdf_en"), pdf_fr.alias("pdf_fr"), published.alias("published_on"), updated.alias("updated_on"), T.description(F.col("subtitle"), F.col("paragraphs")).alias("description"))
