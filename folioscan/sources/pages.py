"""Landed web pages: main text, listing rows, detail fields, filter options, content routing."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import html_tree

SKIPPED = {"nav", "header", "footer", "script", "style", "aside", "form", "noscript", "head", "template"}
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}


def html_text(html: str | None) -> str:
    return html_tree.main_text(html, SKIPPED)


class _Items(HTMLParser):
    """Links with their text and the classes of the elements around them, and paragraphs, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.items, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in VOID:
            self.stack.append((tag, a.get("class") or ""))
        if tag in ("a", "p", "h1", "h2", "h3", "li", "time", "span"):
            item = {"tag": tag, "href": a.get("href"), "classes": " ".join(c for _, c in self.stack if c), "text": ""}
            self.items.append(item)
            self.open.append((len(self.stack), item))

    def handle_endtag(self, tag):
        while self.stack:
            top, _ = self.stack.pop()
            if top == tag:
                break
        while self.open and self.open[-1][0] > len(self.stack):
            self.open.pop()

    def handle_data(self, data):
        for _, item in self.open:
            item["text"] += data


ELEMENTS = ArrayType(StructType([StructField(c, StringType()) for c in ("tag", "href", "classes", "text")]))


@F.pandas_udf(StringType())
def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield s.map(html_text)


@F.pandas_udf(ELEMENTS)
def elements(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        out = []
        for html in s:
            p = _Items()
            p.feed(html or "")
            p.close()
            out.append([{**i, "text": " ".join(i["text"].split())} for i in p.items])
        yield pd.Series(out)


def listing_rows(pages: DataFrame, key: str, html: str, ref_pattern: str) -> DataFrame:
    """key, pos, link, title, reference of the page's headed links; rows without a reference keep null."""
    e = pages.select(key, F.posexplode(elements(html)).alias("pos", "e")).where("e.tag = 'a' and e.href is not null and e.text <> ''")
    return e.select(key, "pos", F.col("e.href").alias("link"), F.col("e.text").alias("title"), F.nullif(F.regexp_extract("e.text", ref_pattern, 0), F.lit("")).alias("reference"))


def detail(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, links, pdf_links, description (the first paragraph over 40 characters), n_paragraphs."""
    e = pages.select(key, elements(html).alias("e"))
    pick = lambda tag: F.filter("e", lambda x: x["tag"] == tag)
    links = F.transform(F.filter(pick("a"), lambda x: x["href"].isNotNull()), lambda x: x["href"])
    return e.select(
        key,
        F.get(pick("h1"), F.lit(0))["text"].alias("title"),
        links.alias("links"),
        F.filter(links, lambda x: F.lower(x).endswith(".pdf")).alias("pdf_links"),
        F.get(F.filter(pick("p"), lambda x: F.length(x["text"]) > 40), F.lit(0))["text"].alias("description"),
        F.size(pick("p")).alias("n_paragraphs"),
    )


def filter_options(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """key, value, label from a pattern of two groups; the first label of each value, by lower-case label."""
    values, labels = (F.regexp_extract_all(html, F.lit(pattern), F.lit(k)) for k in (1, 2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(values.alias("value"), labels.alias("label"))).alias("pos", "o")).select(key, "pos", "o.value", "o.label")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "value").orderBy("pos"))).where("_n = 1")
    return first.select(key, "value", "label").orderBy(F.lower("label"))


def route(pre_extracted: Column, url: Column, content: Column, content_type: Column) -> Column:
    """TEXT for items with text, PDF by suffix, magic bytes or type, else HTML."""
    is_pdf = F.lower(url).endswith(".pdf") | (F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary")) | F.coalesce(F.contains(F.lower(content_type), F.lit("application/pdf")), F.lit(False))
    return F.when(F.coalesce(pre_extracted, F.lit("")) != "", "TEXT").when(F.coalesce(is_pdf, F.lit(False)), "PDF").otherwise("HTML")
