"""Linking documents to catalog entities by alias patterns, identifiers, URIs and fuzzy references."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T

#: Patterns are broadcast in blocks of about so many rows and bytes; each block scans the texts once.
BLOCK_PATTERNS, BLOCK_BYTES = 500_000, 32 << 20
_automata: dict[str, object] = {}


def _blocks(patterns: DataFrame, column: str, find) -> DataFrame:
    """find(patterns) for all patterns, in as many blocks as their number and bytes need."""
    n, size = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    k = max(-(-n // BLOCK_PATTERNS), -(-size // BLOCK_BYTES), 1)
    parts = [patterns.where(F.pmod(F.xxhash64(*patterns.columns), F.lit(k)) == i) for i in range(k)] if k > 1 else [patterns]
    return reduce(DataFrame.unionByName, map(find, parts))


def folded(s: str) -> str:
    """A text in which letters that a case-insensitive pattern takes for one another are the same; other letters may be, too."""
    return s.casefold().replace("\u0307", "").replace("ı", "i")


def needed_literal(regex: str) -> str:
    """The longest run of plain letters, digits and spaces that each match of a regular expression holds; empty if none can be told.

    Groups, classes, escapes and what a quantifier follows end a run; with alternatives at the top there is none.
    """
    runs, now, depth, i = [], "", 0, 0
    while i < len(regex):
        c = regex[i]
        if c == "|" and not depth:
            return ""
        if c == "[" or c == "\\" or c in "()":
            runs, now = [*runs, now], ""
        if c == "\\":
            if regex[i + 1 : i + 2] in ("Q", "E", "x", "u", "p", "P", "k", "N", "c", "0"):
                return max(runs, key=len) if not depth and regex[i + 1 : i + 2] != "Q" else ""
            i += 2
            continue
        if c == "[":
            end = regex.find("]", i + 2 if regex[i + 1 : i + 2] != "^" else i + 3)
            if end < 0 or "[" in regex[i + 1 : end]:  # classes within classes: not told
                return ""
            i = end + 1
            continue
        depth += (c == "(") - (c == ")")
        if c == "(" and regex[i + 1 : i + 2] == "?" and "x" in regex[i + 2 : i + 2 + len(regex[i + 2 :].split(")")[0].split(":")[0])]:
            return ""  # white space may mean nothing
        if c in "?*{+":
            now = now[:-1] if c != "+" else now
            runs, now = [*runs, now], ""
            i = regex.find("}", i) + 1 if c == "{" and "}" in regex[i:] else i + 1
            continue
        if not depth and (c.isalnum() or c == " "):
            now += c
        elif c not in "()":
            runs, now = [*runs, now], ""
        i += 1
    return max([*runs, now], key=len)


def _automaton(name: str, words: list[str]):
    """This Python worker's Aho-Corasick automaton of a block's words, kept between tasks."""
    if name not in _automata:
        import ahocorasick

        _automata.clear()
        a, of = ahocorasick.Automaton(), {}
        for k, w in enumerate(words):
            of.setdefault(w, []).append(k)
        for w, ks in of.items():
            a.add_word(w, ks)
        a.make_automaton()
        _automata[name] = a
    return _automata[name]


def _with_hits(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """rows with `_hits`: the numbers of the words that a text may hold, case ignored; empty words are in all. One scan finds all words."""
    words = [folded(w) for w in words]
    name = hashlib.sha256("\0".join(words).encode()).hexdigest()
    always = [k for k, w in enumerate(words) if not w]
    at, schema = rows.columns.index(text), StructType([*rows.schema.fields, StructField("_hits", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(name, [w or "\0\0" for w in words]) if len(always) < len(words) else None
        for b in batches:
            hits = []
            for t in b.column(at).to_pylist():
                found = set(always) if t is not None else set()
                for _, ks in a.iter(folded(t)) if a is not None and t else ():
                    found.update(ks)
                hits.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.int32()))], [*b.schema.names, "_hits"])

    return rows.mapInArrow(run, schema)


def alias_pattern(pattern: Column, kind: Column) -> Column:
    """A case-insensitive regular expression for REGEX and EXACT aliases, else null."""
    return F.when(kind == "REGEX", F.concat(F.lit("(?iu)"), pattern)).when(kind == "EXACT", F.concat(F.lit(r"(?iu)\Q"), pattern, F.lit(r"\E")))


def link_aliases(docs: DataFrame, aliases: list[tuple[int, str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, entity_id, method, confidence, snippet: one hit for each document and entity, the first alias in order wins.

    aliases: (entity_id, pattern, kind); kinds but REGEX and EXACT are skipped. Patterns are literals in the plan, so each
    document is scanned once and nothing is joined.
    """
    hits = []
    for k, (entity, pattern, kind) in enumerate(aliases):
        if kind in ("REGEX", "EXACT"):
            regex = F.lit(f"(?iu){pattern}" if kind == "REGEX" else rf"(?iu)\Q{pattern}\E")
            hits.append(F.when(F.regexp_instr(F.col(text), regex) > 0, F.struct(F.lit(k).alias("ord"), F.lit(entity).cast("long").alias("entity_id"), T.snippet(F.col(text), regex).alias("snippet"))))
    if not hits:
        return docs.select(key, F.lit(None).cast("long").alias("entity_id"), F.lit("").alias("method"), F.lit(1.0).alias("confidence"), F.lit("").alias("snippet")).limit(0)
    found = docs.select(key, F.explode(F.array_compact(F.array(*hits))).alias("h"))
    best = found.groupBy(key, F.col("h.entity_id").alias("entity_id")).agg(F.min_by("h.snippet", "h.ord").alias("snippet"))
    return best.select(key, "entity_id", F.lit("REGEX_ALIAS").alias("method"), F.lit(1.0).alias("confidence"), "snippet")


def link_alias_table(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """link_aliases() for a table of any number of aliases (entity_id, pattern, kind, ord).

    An automaton finds the aliases whose pattern, or a literal that the pattern needs, is in a text; the regular expression
    then runs on these only. Aliases without such a literal run on every text. Snippets are cut at each hit, so that texts are not shuffled.
    """
    p = aliases.withColumn("regex", alias_pattern(F.col("pattern"), F.col("kind"))).where("regex is not null").select("entity_id", "pattern", "kind", "regex", "ord")

    def find(block: DataFrame) -> DataFrame:
        rows = block.collect()  # a block of bounded rows and bytes
        words = [r.pattern if r.kind == "EXACT" else needed_literal(r.pattern) for r in rows]
        table = docs.sparkSession.createDataFrame([(k, r.entity_id, r.ord, r.regex) for k, r in enumerate(rows)], "_k int, entity_id long, ord long, regex string")
        may = _with_hits(docs.select(key, text), text, words).select(key, text, F.explode("_hits").alias("_k"))
        hit = may.join(F.broadcast(table), "_k").where(F.rlike(F.col(text), F.col("regex")))
        return hit.select(key, "entity_id", "ord", T.snippet(F.col(text), F.col("regex")).alias("snippet"))

    best = _blocks(p, "regex", find).groupBy(key, "entity_id").agg(F.min_by("snippet", "ord").alias("snippet"))
    return best.select(key, "entity_id", F.lit("REGEX_ALIAS").alias("method"), F.lit(1.0).alias("confidence"), "snippet")


def link_ids(docs: DataFrame, catalog: DataFrame, pattern: str, id_column: str, method: str, trim: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifiers in the text that are in the catalog (entity_id, id_column): one row for each document and entity, at the first place."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    found = docs.select(key, text, F.posexplode(ids).alias("pos", "raw"))
    id_ = F.rtrim(F.col("raw"), F.lit(trim)) if trim else F.col("raw")
    found = found.select(key, "pos", id_.alias("id"), T.around(F.col(text), F.instr(F.col(text), F.col("raw")), F.length("raw")).alias("snippet"))
    hit = found.hint("merge").join(catalog.select("entity_id", F.col(id_column).alias("id")), "id")
    best = hit.groupBy(key, "entity_id").agg(F.min_by("snippet", "pos").alias("snippet"))
    return best.select(key, "entity_id", F.lit(method).alias("method"), F.lit(1.0).alias("confidence"), "snippet")


def combine(rules: DataFrame, docs: DataFrame, extract, key: str = "doc_id") -> DataFrame:
    """Rule hits, and for documents without any the hits that extract(unmatched docs) finds, at confidence 0.8."""
    rest = docs.join(rules.select(key).distinct(), key, "left_anti")
    found = extract(rest).withColumn("confidence", F.lit(0.8))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy(key, "entity_id").orderBy("pos"))).where("n = 1")
    return rules.unionByName(first.select(rules.columns))


def resolve_references(refs: DataFrame, catalog: DataFrame, ref: str = "ref") -> DataFrame:
    """ref, entity_id: exact on reference or identifier, else a fuzzy match if it is the only one, else null."""
    r = refs.select(F.trim(F.col(ref)).alias("ref")).where("ref <> ''").distinct()
    names = catalog.select("entity_id", F.col("reference").alias("ref")).unionByName(catalog.select("entity_id", F.col("celex_id").alias("ref"))).where("ref is not null")
    exact = r.hint("merge").join(names, "ref").groupBy("ref").agg(F.min("entity_id").alias("exact"))
    fuzzy = catalog.select("entity_id", T.fuzzy_reference(F.col("reference")).alias("k")).where("k <> ''").groupBy("k").agg(F.min("entity_id").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1")
    out = r.hint("merge").join(exact, "ref", "left").withColumn("k", T.fuzzy_reference(F.col("ref"))).hint("merge").join(fuzzy, "k", "left")
    return out.select("ref", F.coalesce("exact", "only").alias("entity_id"))


def match_labels(labels: DataFrame, patterns: DataFrame, key: str, label: str) -> DataFrame:
    """key, slugs: the slugs (sorted) of all patterns that a label contains, case ignored; an automaton finds them in one scan of the labels."""

    def find(block: DataFrame) -> DataFrame:
        rows = [r for r in block.collect() if r.pattern is not None]  # a block of bounded rows and bytes
        table = labels.sparkSession.createDataFrame([(k, r.pattern, r.slug) for k, r in enumerate(rows)], "_k int, pattern string, slug string")
        may = _with_hits(labels.select(key, F.col(label).alias("_label")), "_label", [r.pattern for r in rows]).select(key, "_label", F.explode("_hits").alias("_k"))
        hit = may.join(F.broadcast(table), "_k").where(F.contains(F.lower(F.trim("_label")), F.lower("pattern")))
        return hit.select(key, "slug")

    hit = _blocks(patterns.select("pattern", "slug"), "pattern", find)
    return hit.groupBy(key).agg(F.sort_array(F.collect_set("slug")).alias("slugs"))
