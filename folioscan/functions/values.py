"""JSON in noisy replies, typed values, vectors and rank scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(c: Column) -> Column:
    """The text from the first { to the last } if it is valid JSON, else null."""
    x = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    opened, closed = (F.length(x) - F.length(F.translate(x, c, "")) for c in "{}")
    return F.when(F.try_parse_json(x).isNotNull() & (opened == closed), x)  # the parser ignores what follows the object


def json_references(c: Column) -> Column:
    """array<struct<ref, context>> from the first [ to the last ], items with a ref only; empty if there is none."""
    x = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    items = F.from_json(x, "array<struct<ref: string, context: string>>")
    return F.coalesce(F.filter(items, lambda i: i["ref"].isNotNull() & (i["ref"] != "")), F.array().cast("array<struct<ref: string, context: string>>"))


def coerce(value: Column, kind: Column, choices: Column) -> tuple[Column, Column]:
    """(value as text in the form of its declared kind, error or null) for BOOL, DATE, LIST_TEXT, ENUM and text kinds."""
    v = F.trim(value)
    low = F.lower(v)
    flag = F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false")
    date = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd").cast("string"))
    items = F.array_join(F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != ""), ",")
    enum = F.when(F.array_contains(choices, F.upper(v)), F.upper(v))
    out = F.when(kind == "BOOL", flag).when(kind == "DATE", date).when(kind == "LIST_TEXT", items).when(kind == "ENUM", enum).otherwise(v)
    return out, F.when(value.isNotNull() & out.isNull(), F.concat(F.lit("not a "), F.lower(kind)))


def split_known(values: Column, known: list[str]) -> tuple[Column, Column]:
    """(known names, others) of a map of values."""
    return F.map_filter(values, lambda k, v: k.isin(known)), F.map_filter(values, lambda k, v: ~k.isin(known))


def l2_distance(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """For a rank that counts from 0."""
    return 1.0 / (k + rank + 1)


def result_score(rank: Column) -> Column:
    return 1.0 / (rank + 1)


def overlaps_or_all(values: Column, mine: Column) -> Column:
    """Null applies to everyone, as does ALL."""
    return values.isNull() | F.array_contains(values, "ALL") | F.arrays_overlap(values, mine)


def contains_or_all(values: Column, one: str) -> Column:
    """Null applies to no one."""
    return values.isNotNull() & (F.array_contains(values, one) | F.array_contains(values, "ALL"))
