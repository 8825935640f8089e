"""Dates of feeds and pages, deadlines and their bands. Today is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feed_date(published: Column, updated: Column, now: Column) -> Column:
    """RFC 822 dates (weekday optional, offset or GMT; none: UTC); published, else updated, else now."""

    def parse(c):
        c = F.regexp_replace(F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC|UT|Z)\s*$", " +0000")
        return F.coalesce(F.try_to_timestamp(c, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c, F.lit("d MMM yyyy HH:mm:ss")))

    return F.coalesce(parse(published), parse(updated), now)


def dotted_date(c: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), F.lit("")), "d.M.yyyy")


def worded_date(c: Column) -> Column:
    c = F.nullif(F.regexp_extract(c, r"(\d{1,2} [A-Za-z]+ \d{4})", 1), F.lit(""))
    return F.coalesce(F.try_to_date(c, "d MMMM yyyy"), F.try_to_date(c, "d MMM yyyy"))


def header_dates(c: Column) -> tuple[Column, Column]:
    """(published, updated) from a page header."""
    return tuple(worded_date(F.regexp_extract(c, rf"(?i){w} on\s+(\d{{1,2}} [A-Za-z]+ \d{{4}})", 1)) for w in ("published", "updated"))


def iso_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))


def band(days: Column) -> Column:
    return F.when(days < 0, "OVERDUE").when(days <= 30, "RED").when(days <= 180, "AMBER").when(days <= 730, "BLUE").otherwise("GREY")
