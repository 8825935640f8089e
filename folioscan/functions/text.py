"""Scalar text functions as Column expressions: hashing, references, headings, flags, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and labels that results depend on.
CELEX = r"\b[1-9]\d{4}[A-Z]\d{4}\b"
ELI = r"(?i)https?://data\.(?:europa\.eu|legilux\.public\.lu)/eli/[^\s)\]]+"
PREFIX_TOKENS = ("circular", "directive", "regulation", "règlement", "reglement", "richtlinie", "verordnung", "act", "law", "loi", "gesetz", "eba", "esma", "cssf", "eu")
TOPIC_SUBSTRINGS = ("dora", "ict", "cyber", "operational resilience", "outsourcing", "tlpt", "third-party provider", "third party provider", "incident reporting", "digital operational resilience")
TOPIC_WORDS = ("ict", "dora", "cloud", "nis2", "cybersecurity", "cyber-security")
TOPIC_PHRASES = ("information security", "cyber security", "operational resilience", "outsourcing", "third party risk", "third-party risk", "it governance", "business continuity", "nis 2", "security risk management")
AMENDMENT_MARKERS = ("amend", "amending", "repeal", "replacing", "supersede")
CONSULTATION_PHRASES = ("consultation paper", "discussion paper", "feedback on", "call for evidence")
SOURCE_NAMES = {"cssf_rss": "CSSF", "cssf_consultation": "CSSF", "eurlex_cellar": "EUR-Lex", "eurlex_proposal": "EUR-Lex", "legilux_sparql": "Legilux", "legilux_parliamentary": "Legilux", "esma_rss": "ESMA", "eba_rss": "EBA", "ec_fisma_rss": "EC FISMA"}
HEADING_TOP = r"(?i)^\s*(?:(?:Title|Titre|Titel|Part|Partie|Teil)\s+[IVXLCM0-9]+\b|(?:(?:Sub[- ]?)?Chapter|Chapitre|Kapitel|Section|Abschnitt)\s+[IVXLCM0-9]+(?:\.\d+)*\b)"
HEADING_ARTICLE = r"^\s*(?:(?i:Article|Artikel|Art\.?)\s+\d+[a-z]?\b|§\s*\d+[a-z]?\b)"
CROSS_REF = r"(?i)(?:Article|Artikel|Art\.?)\s+(\d+(?:\(\d+\))?(?:\([a-z]\))?)|§\s*(\d+[a-z]?)"
DEFINITION = r"(?iuU)\bD[eé]finitions?\b|\bBegriffs?bestimmung"
STOP_WORDS = {"de": ("der", "die", "und", "das", "den", "von", "mit", "ist", "im", "zu"), "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with"), "es": ("el", "los", "las", "que", "del", "por", "con", "una", "es", "y"), "fr": ("le", "les", "des", "et", "une", "du", "dans", "pour", "qui", "sur")}


def body_text(pdf: Column, html: Column) -> Column:
    """The text of a document; an empty string counts as missing."""
    return F.coalesce(F.nullif(pdf, F.lit("")), F.nullif(html, F.lit("")), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def canonical_reference(c: Column) -> Column:
    """Upper case without a leading "Circular", one space, and "/" between numbers."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\bcircular\s+", ""), r"\s+", " ")
    return F.upper(F.regexp_replace(F.trim(c), r"(\d)-(\d)", "$1/$2"))


def fuzzy_reference(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[-_]+", "/"), r"\s+", " ")
    tokens = "|".join(PREFIX_TOKENS)
    c = F.regexp_replace(c, rf"^(?:(?:{tokens})(?: |$))+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " ", "/"), "/+", "/"), "^/|/$", "")


def reference_slug(c: Column) -> Column:
    """A page slug for references such as "ABC 22/806", else null."""
    kind, year, n = (F.regexp_extract(c, r"^([A-Za-z]+)\s+(\d{2,4})[/-](\d+)$", k) for k in (1, 2, 3))
    return F.when(kind != "", F.lower(F.concat_ws("-", kind, year, n)))


def synthetic_reference(url: Column, prefix: Column) -> Column:
    """An id from the last part of a page address, with the prefix unless it starts with it."""
    slug = F.upper(F.regexp_extract(url, r"/([^/?#]+)/?(?:[?#].*)?$", 1))
    return F.when(slug == "", None).when(F.startswith(slug, F.upper(prefix)), slug).otherwise(F.concat_ws("-", F.upper(prefix), slug))


def snippet(text: Column, pattern: Column, radius: int = 60) -> Column:
    """The first match with so many characters on either side, trimmed; null without a match."""
    return around(text, F.regexp_instr(text, pattern), F.length(F.regexp_substr(text, pattern)), radius)


def around(text: Column, start: Column, size: Column, radius: int = 60) -> Column:
    """So many characters on either side of a place (from 1) and the place itself, trimmed; null for place 0."""
    low = F.greatest(start - radius, F.lit(1)).cast("int")
    return F.when(start > 0, strip(text.substr(low, (start + size + radius - low).cast("int"))))


def match_query(c: Column) -> Column:
    """A full-text query: the words of c (letters of any script, digits, marks and _), quoted and joined by OR."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}_]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def compose_title(clean: Column, ref: Column, subtitle: Column, listing: Column) -> Column:
    clean, ref, subtitle, listing = (F.trim(F.coalesce(c, F.lit(""))) for c in (clean, ref, subtitle, listing))
    bare = (ref != "") & ((F.lower(clean) == F.lower(F.concat(F.lit("Circular "), ref))) | (clean == ref))
    return (
        F.when((clean != "") & ~bare, clean)
        .when((ref != "") & (subtitle != ""), F.concat(F.lit("Circular "), ref, F.lit(" "), subtitle))
        .when(ref == "", F.coalesce(F.nullif(clean, F.lit("")), listing))
        .when((listing != "") & (listing != clean), listing)
        .otherwise(F.coalesce(F.nullif(clean, F.lit("")), ref))
    )


AMENDED_BY = r"(?i)\s*\(as amended by ([^)]*)\)"


def split_amended(title: Column, ref_pattern: str) -> tuple[Column, Column]:
    """(title without "(as amended by ...)", the references in it in order)."""
    inner = F.regexp_extract(title, AMENDED_BY, 1)
    return F.trim(F.regexp_replace(title, AMENDED_BY, "")), F.array_distinct(F.regexp_extract_all(inner, F.lit(ref_pattern), F.lit(0)))


def related_references(related: Column, own: Column, amending_label: str = "amended by") -> Column:
    """From array<struct<label, ref>>: the references the document amends, without amending ones and itself, in order."""
    fits = F.filter(related, lambda r: (F.lower(r["label"]) != amending_label) & r["ref"].isNotNull() & (r["ref"] != own))
    return F.array_distinct(F.transform(fits, lambda r: r["ref"]))


def pdf_links(links: Column) -> tuple[Column, Column]:
    """(the first link on an English PDF, the first other PDF)."""
    pdf = F.filter(links, lambda x: F.lower(x).endswith(".pdf"))
    english = F.filter(pdf, lambda x: F.lower(x).endswith("eng.pdf"))
    other = F.filter(pdf, lambda x: ~F.lower(x).endswith("eng.pdf"))
    return F.get(english, F.lit(0)), F.get(other, F.lit(0))


def description(subtitle: Column, paragraphs: Column, least: int = 40) -> Column:
    return F.coalesce(F.nullif(F.trim(subtitle), F.lit("")), F.get(F.filter(paragraphs, lambda p: F.length(F.trim(p)) > least), F.lit(0)))


def heading_level(line: Column) -> Column:
    return F.when(line.rlike(HEADING_TOP), 0).when(line.rlike(HEADING_ARTICLE), 1)


def token_count(c: Column) -> Column:
    """Tokens by the usual four characters each."""
    return F.ceil(F.length(c) / 4).cast("long")


def cross_references(c: Column) -> Column:
    a, b = (F.regexp_extract_all(c, F.lit(CROSS_REF), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y)), lambda r: r != ""))


def is_definition(path: Column, body: Column, whole: bool = False) -> Column:
    return F.exists(path, lambda h: h.rlike(DEFINITION)) | (body if whole else F.substring(body, 1, 200)).rlike(DEFINITION)


def embed_text(meta: Column, path: Column, body: Column) -> Column:
    head = F.concat_ws(", ", F.nullif(meta, F.lit("")), F.nullif(F.array_join(path, ", "), F.lit("")))
    return F.concat(F.when(head == "", "").otherwise(F.concat(head, F.lit(":\n"))), body)


def article_heading(path: Column) -> Column:
    return F.get(F.filter(F.reverse(path), lambda h: h.rlike(HEADING_ARTICLE)), F.lit(0))


def language(c: Column, chars: int = 2000) -> Column:
    """The language with the most stop words in the first characters, as the detector it stands for; null if none occurs."""
    words = F.split(F.lower(F.substring(c, 1, chars)), r"[^\p{L}]+")
    # an array of one, so that the words are found once and not for each use
    counts = F.transform(F.array(words), lambda w: F.array(*(F.struct(F.size(F.array_intersect(w, F.array(*map(F.lit, v)))).alias("n"), F.lit(-k).alias("order")) for k, v in enumerate(STOP_WORDS.values()))))
    best = F.array_max(F.get(counts, F.lit(0)))
    return F.when(best["n"] > 0, F.get(F.array(*map(F.lit, STOP_WORDS)), -best["order"]))


def topic_by_substring(c: Column) -> Column:
    out = F.lit(False)
    for w in TOPIC_SUBSTRINGS:
        out = out | F.contains(F.lower(c), F.lit(w))
    return out


def topic_by_word(title: Column, text: Column) -> Column:
    c = F.lower(F.concat_ws(" ", title, text))
    out = c.rlike(r"\b(?:" + "|".join(TOPIC_WORDS) + r")\b")
    for p in TOPIC_PHRASES:
        out = out | F.contains(c, F.lit(p))
    return out


def lifecycle(title: Column, celex: Column, url: Column, application: Column, as_of: Column) -> Column:
    consult = F.lit(False)
    for p in CONSULTATION_PHRASES:
        consult = consult | F.contains(F.lower(title), F.lit(p))
    return (
        F.when(celex.rlike(r"^5\d{4}P[CP]\d{4}$"), "PROPOSAL")
        .when(celex.rlike(r"^3\d{4}[A-Z]\d{4}$"), F.when(application > as_of, "ADOPTED_NOT_IN_FORCE").otherwise("IN_FORCE"))
        .when(url.rlike(r"(?i)data\.legilux\.public\.lu/eli/etat/projet-de-loi/"), "DRAFT_BILL")
        .when(consult, "CONSULTATION")
        .otherwise("IN_FORCE")
    )


def severity(title: Column, topic: Column, in_force: Column) -> Column:
    amends = F.lit(False)
    for m in AMENDMENT_MARKERS:
        amends = amends | F.contains(F.lower(title), F.lit(m))
    return F.when(amends & in_force, F.when(topic, "CRITICAL").otherwise("MATERIAL")).when(amends | in_force, "MATERIAL").otherwise("INFORMATIONAL")


def severity_rank(c: Column) -> Column:
    return F.when(c == "CRITICAL", 0).when(c == "MATERIAL", 1).when(c == "INFORMATIONAL", 2).otherwise(3)


def payload_description(payload: Column) -> Column:
    text = strip(F.get_json_object(payload, "$.description"))
    return F.when(F.length(text) > 10, F.substring(text, 1, 500))


def is_directive(kind: Column, celex: Column) -> Column:
    return F.coalesce(kind == "EU_DIRECTIVE", F.lit(False)) | F.coalesce(F.substring(celex, 6, 1) == "L", F.lit(False))


def truncate(c: Column, max_tokens: int, overhead: int) -> tuple[Column, Column]:
    """(text cut to the token budget, whether it was cut)."""
    chars = 4 * max(max_tokens - overhead, 500)
    return F.substring(c, 1, chars), F.length(c) > chars


def bullets(c: Column) -> Column:
    items = F.from_json(F.translate(c, "'", '"'), "array<string>")
    return F.when(items.isNull(), c).otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def valid_slug(c: Column) -> Column:
    """Capitals, digits and _, 3 to 40 of them, from a capital to a capital or digit."""
    return c.rlike(r"\A[A-Z][A-Z0-9_]{1,38}[A-Z0-9]\z")


def valid_name(c: Column) -> Column:
    return c.rlike(r"^[a-z][a-z0-9_]*$")


def archive_path(published: Column, sha: Column, title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.date_format(published, "yyyy/MM"), F.lit("/"), F.substring(sha, 1, 8), F.lit("-"), F.substring(slug, 1, 60), F.lit(".pdf"))


def display_name(source: Column) -> Column:
    pairs = [F.lit(x) for kv in SOURCE_NAMES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[source], source)
