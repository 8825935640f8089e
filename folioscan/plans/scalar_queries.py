"""Queries for scalar functions and projections (F*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V
from ..operators import views
from .registry import query

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
BODY = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN text END AS pdf, CASE WHEN doc_id % 2 = 0 THEN text END AS html FROM {documents}"


@query("P1_F1_F2_content_hash", f"SELECT doc_id, sha256({STRIP.format('b')}) AS content_hash, length(b) AS n FROM (SELECT doc_id, coalesce(nullif(pdf, ''), nullif(html, ''), '') AS b FROM $body)", body=BODY)
def content_hash(t):
    b = T.body_text(F.col("pdf"), F.col("html"))
    return t.rows(BODY).select("doc_id", T.content_hash(b).alias("content_hash"), F.length(b).cast("long").alias("n"))


REFS = "SELECT p_partkey, concat(CASE WHEN p_partkey % 2 = 0 THEN 'Circular  ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'cssf  ' ELSE 'EBA ' END, CAST(p_size + 10 AS VARCHAR(9)), CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '/' END, CAST(p_partkey AS VARCHAR(9))) AS ref FROM {part}"


@query(
    "F3_F4_F5_references",
    r"""SELECT p_partkey, upper(regexp_replace(trim(regexp_replace(regexp_replace(ref, '\bcircular\s+', '', 'gi'), '\s+', ' ', 'g')), '(\d)-(\d)', '\1/\2', 'g')) AS canonical,
    concat(CAST(p_size + 10 AS VARCHAR), '/', CAST(p_partkey AS VARCHAR)) AS fuzzy,
    CASE WHEN p_partkey % 2 = 1 AND p_size + 10 BETWEEN 10 AND 9999 THEN lower(concat(CASE WHEN p_partkey % 3 = 0 THEN 'cssf' ELSE 'eba' END, '-', CAST(p_size + 10 AS VARCHAR), '-', CAST(p_partkey AS VARCHAR))) END AS slug
    FROM (SELECT r.*, p.p_size FROM $refs r JOIN part p USING (p_partkey))""",
    refs=REFS,
)
def references(t):
    return t.rows(REFS).select("p_partkey", T.canonical_reference(F.col("ref")).alias("canonical"), T.fuzzy_reference(F.col("ref")).alias("fuzzy"), T.reference_slug(F.col("ref")).alias("slug"))


@query("F6_synthetic_reference", "SELECT page_id, CASE WHEN s = '' THEN NULL WHEN starts_with(s, 'NEWS') THEN s ELSE concat('NEWS-', s) END AS ref FROM (SELECT page_id, upper(regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1)) AS s FROM pages)")
def synthetic(t):
    return t.pages.select("page_id", T.synthetic_reference(F.col("url"), F.lit("news")).alias("ref"))


@query(
    "F7_snippet",
    rf"SELECT doc_id, CASE WHEN m <> '' THEN {STRIP.format('substring(text, greatest(strpos(text, m) - 60, 1), strpos(text, m) + length(m) + 60 - greatest(strpos(text, m) - 60, 1))')} END AS snippet FROM (SELECT doc_id, text, regexp_extract(text, '(?i)th[a-z]+ing', 0) AS m FROM documents)",
)
def snippet(t):
    return t.documents.select("doc_id", T.snippet(F.col("text"), F.lit(r"(?i)th[a-z]+ing")).alias("snippet"))


@query("F8_match_query", r"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(substring(text, 1, 200), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: '"' || w || '"'), ' OR ') AS q FROM documents""")
def match_query(t):
    """A query of each document's opening, which has letters with accents."""
    return t.documents.select("doc_id", T.match_query(F.substring("text", 1, 200)).alias("q"))


TITLES = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN concat('Circular ', p_brand) WHEN p_partkey % 4 = 1 THEN p_name ELSE NULL END AS clean, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS ref, CASE WHEN p_partkey % 5 > 1 THEN p_type END AS sub, CASE WHEN p_partkey % 7 > 1 THEN concat(p_brand, ' ', p_type) END AS listing FROM {part}"


@query(
    "F9_compose_title",
    """SELECT p_partkey, CASE WHEN c <> '' AND NOT (r <> '' AND (lower(c) = lower('Circular ' || r) OR c = r)) THEN c WHEN r <> '' AND s <> '' THEN 'Circular ' || r || ' ' || s
    WHEN r = '' THEN coalesce(nullif(c, ''), l) WHEN l <> '' AND l <> c THEN l ELSE coalesce(nullif(c, ''), r) END AS title
    FROM (SELECT p_partkey, coalesce(clean, '') AS c, coalesce(ref, '') AS r, coalesce(sub, '') AS s, coalesce(listing, '') AS l FROM $titles)""",
    titles=TITLES,
)
def title(t):
    return t.rows(TITLES).select("p_partkey", T.compose_title(*(F.col(c) for c in ("clean", "ref", "sub", "listing"))).alias("title"))


AMENDED = "SELECT p_partkey, concat(p_name, ' (as amended by Circulars CSSF ', CAST(p_size AS VARCHAR(9)), '/', CAST(p_partkey AS VARCHAR(9)), ', CSSF 22/806 and CSSF ', CAST(p_size AS VARCHAR(9)), '/', CAST(p_partkey AS VARCHAR(9)), ')') AS title FROM {part}"


@query("F10_W15_split_amended", r"SELECT p_partkey, p_name AS clean, list_distinct_ordered AS refs FROM (SELECT p_partkey, p_name, CASE WHEN a = b THEN [a] ELSE [a, b] END AS list_distinct_ordered FROM (SELECT p_partkey, p_name, concat('CSSF ', CAST(p_size AS VARCHAR), '/', CAST(p_partkey AS VARCHAR)) AS a, 'CSSF 22/806' AS b FROM part))")
def amended(t):
    clean, refs = T.split_amended(F.col("title"), r"CSSF \d+/\d+")
    return t.rows(AMENDED).select("p_partkey", clean.alias("clean"), refs.alias("refs"))


@query("F11_related_references", """SELECT l_orderkey, list_sort(list_distinct(list(ref) FILTER (WHERE label <> 'amended by' AND ref <> CAST(l_orderkey AS VARCHAR)))) AS amends FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'amended by' ELSE 'related' END AS label, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem) GROUP BY 1""")
def related(t):
    r = t.lineitem.select("l_orderkey", F.struct(F.when(F.col("l_linenumber") % 3 == 0, "Amended by").otherwise("Related").alias("label"), F.col("l_partkey").cast("string").alias("ref")).alias("r"))
    g = r.groupBy("l_orderkey").agg(F.collect_list("r").alias("related"))
    out = F.sort_array(T.related_references(F.col("related"), F.col("l_orderkey").cast("string")))
    return g.select("l_orderkey", F.when(F.size(out) > 0, out).alias("amends"))


LINKS = "SELECT p_partkey, array_agg(link) AS links FROM (SELECT p_partkey, concat('/f/', CAST(p_partkey AS VARCHAR(9)), x.e) AS link FROM {part} CROSS JOIN (SELECT '.html' AS e UNION ALL SELECT 'eng.pdf' UNION ALL SELECT '_fra.PDF') x WHERE p_partkey % 3 > 0 OR x.e <> 'eng.pdf') GROUP BY p_partkey"


@query("F12_pdf_links", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN concat('/f/', CAST(p_partkey AS VARCHAR), 'eng.pdf') END AS english, concat('/f/', CAST(p_partkey AS VARCHAR), '_fra.PDF') AS other FROM part")
def pdf_links(t):
    english, other = T.pdf_links(F.col("links"))
    return t.rows(LINKS).select("p_partkey", english.alias("english"), other.alias("other"))


HEADS = "SELECT p_partkey, concat(CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'Chapter ' WHEN 1 THEN 'Article ' WHEN 2 THEN 'Kapitel ' WHEN 3 THEN '§ ' WHEN 4 THEN 'Sub-chapter ' WHEN 5 THEN 'Art. ' WHEN 6 THEN 'Titre ' ELSE 'Note ' END, CAST(p_size AS VARCHAR(9)), CASE WHEN p_partkey % 9 = 0 THEN 'a' ELSE '' END, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN ' Definitions of ' WHEN 1 THEN ' DÉFINITIONS: ' WHEN 2 THEN ' BEGRIFFSBESTIMMUNGEN ' WHEN 3 THEN ' redefinitions of ' WHEN 4 THEN ' prédéfinition ' WHEN 5 THEN ' definition, ' ELSE ' scope of ' END, p_name) AS line FROM {part}"


@query(
    "F14_F20_F21_headings",
    r"""SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 2, 4, 6) AND p_partkey % 9 <> 0 THEN 0 WHEN p_partkey % 8 IN (1, 3, 5) THEN 1 END AS level,
    CASE WHEN p_partkey % 8 IN (1, 5) THEN [CAST(p_size AS VARCHAR)] WHEN p_partkey % 8 = 3 THEN [concat(CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 9 = 0 THEN 'a' ELSE '' END)] ELSE [] END AS refs, p_partkey % 7 IN (0, 1, 2, 5) AS is_definition FROM part""",
)
def headings(t):
    c = F.col("line")
    return t.rows(HEADS).select("p_partkey", T.heading_level(c).alias("level"), T.cross_references(c).alias("refs"), T.is_definition(F.array().cast("array<string>"), c).alias("is_definition"))


@query("F18_F31_budget", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, length(substring(text, 1, 4 * 900)) AS n_cut, length(text) > 4 * 900 AS cut FROM documents")
def budget(t):
    text, cut = T.truncate(F.col("text"), 1000, 100)
    return t.documents.select("doc_id", T.token_count(F.col("text")).alias("tokens"), F.length(text).cast("long").alias("n_cut"), cut.alias("cut"))


STOP = " UNION ALL ".join(f"SELECT '{k}' AS lang, '{w}' AS w" for k, v in T.STOP_WORDS.items() for w in v)


@query(
    "F24_language",
    rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(substring(text, 1, 2000)), '[^\p{{L}}]+')) AS w FROM documents),
    s AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN ({STOP}) USING (w) GROUP BY 1, 2), b AS (SELECT doc_id, arg_min(lang, (-n, lang)) AS detected FROM s GROUP BY 1)
    SELECT d.lang, detected, count(*) AS n FROM documents d LEFT JOIN b USING (doc_id) GROUP BY 1, 2""",
)
def language(t):
    return t.documents.groupBy("lang", T.language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


TOPIC = "SELECT doc_id, concat(CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'On jurisdiction: ' WHEN 1 THEN 'ICT risk ' WHEN 2 THEN 'Outsourcing of ' WHEN 3 THEN 'Cloud amending ' WHEN 4 THEN 'Repeal of ' WHEN 5 THEN 'Consultation Paper on ' ELSE 'About ' END, source) AS title, text, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '52022PC0123' WHEN 1 THEN '32022R2554' WHEN 2 THEN '32016L0097' END AS celex, CASE WHEN doc_id % 11 = 0 THEN 'http://data.legilux.public.lu/eli/etat/projet-de-loi/1' ELSE 'http://x' END AS url, CASE WHEN doc_id % 2 = 0 THEN DATE '2025-01-17' ELSE DATE '2023-01-01' END AS applies FROM {documents}"
SUB = " OR ".join(f"contains(lower(title || ' ' || text), '{w}')" for w in T.TOPIC_SUBSTRINGS)
EDGE = r"[^\p{L}\p{N}_]"  # letters of any script are part of a word, which \b of this dialect doesn't know
WRD = rf"regexp_matches(lower(title || ' ' || text), '(?:^|{EDGE})(?:" + "|".join(T.TOPIC_WORDS) + rf")(?:$|{EDGE})') OR " + " OR ".join(f"contains(lower(title || ' ' || text), '{w}')" for w in T.TOPIC_PHRASES)
AMD = " OR ".join(f"contains(lower(title), '{w}')" for w in T.AMENDMENT_MARKERS)


@query(
    "F25_F26_F27_F28_F30_classify",
    rf"""SELECT doc_id, s AS by_substring, w AS by_word, CASE WHEN doc_id % 7 = 0 THEN 'PROPOSAL' WHEN doc_id % 7 IN (1, 2) THEN CASE WHEN doc_id % 2 = 0 THEN 'ADOPTED_NOT_IN_FORCE' ELSE 'IN_FORCE' END
    WHEN doc_id % 11 = 0 THEN 'DRAFT_BILL' WHEN doc_id % 9 = 5 THEN 'CONSULTATION' ELSE 'IN_FORCE' END AS stage,
    CASE WHEN a AND doc_id % 3 = 0 THEN CASE WHEN w THEN 'CRITICAL' ELSE 'MATERIAL' END WHEN a OR doc_id % 3 = 0 THEN 'MATERIAL' ELSE 'INFORMATIONAL' END AS severity, doc_id % 7 = 2 AS directive
    FROM (SELECT *, ({SUB}) AS s, ({WRD}) AS w, ({AMD}) AS a FROM $topic)""",
    topic=TOPIC,
)
def classify(t):
    c = {n: F.col(n) for n in ("title", "text", "celex", "url", "applies")}
    word = T.topic_by_word(c["title"], c["text"])
    return t.rows(TOPIC).select(
        "doc_id",
        T.topic_by_substring(F.concat_ws(" ", "title", "text")).alias("by_substring"),
        word.alias("by_word"),
        T.lifecycle(c["title"], c["celex"], c["url"], c["applies"], F.lit("2024-06-01").cast("date")).alias("stage"),
        T.severity(c["title"], word, F.col("doc_id") % 3 == 0).alias("severity"),
        T.is_directive(F.lit(None).cast("string"), c["celex"]).alias("directive"),
    )


@query("F13_F22_F23_F29_text", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE 'this second paragraph is long enough to be taken as one' END AS description,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', Chapter I, Article ' || p_size || ':' || chr(10) || p_name ELSE 'Chapter I, Article ' || p_size || ':' || chr(10) || p_name END AS embed, 'Article ' || p_size AS article,
  CASE WHEN length(p_name) > 10 THEN p_name END AS payload FROM part""")
def texts(t):
    path = F.array(F.lit("Chapter I"), F.concat(F.lit("Article "), F.col("p_size").cast("string")))
    return t.part.select(
        "p_partkey",
        T.description(F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")), F.array(F.lit("short"), F.lit("this second paragraph is long enough to be taken as one"))).alias("description"),
        T.embed_text(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), path, F.col("p_name")).alias("embed"),
        T.article_heading(path).alias("article"),
        T.payload_description(F.to_json(F.struct(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("description")))).alias("payload"),
    )


@query("F32_F33_F35_small", """SELECT p_partkey, '- ' || p_type || chr(10) || '- ' || p_size AS bullets, p_partkey % 6 IN (0, 1) AS slug_ok, regexp_matches(p_name, '^[a-z][a-z0-9_]*$') AS name_ok,
  '2024/03/' || substring(sha256(p_name), 1, 8) || '-' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.pdf' AS path FROM part""")
def small(t):
    # fine, fine, too long, _ at the end, two characters, a line feed at the end
    k = F.col("p_partkey") % 6
    slug = F.when(k == 0, "AB_9").when(k == 1, F.rpad(F.lit("A"), 40, "B")).when(k == 2, F.rpad(F.lit("A"), 41, "B")).when(k == 3, "AB_").when(k == 4, "AB").otherwise("ABC\n")
    as_list = F.concat(F.lit("['"), F.col("p_type"), F.lit("', '"), F.col("p_size").cast("string"), F.lit("']"))
    return t.part.select("p_partkey", T.bullets(as_list).alias("bullets"), T.valid_slug(slug).alias("slug_ok"), T.valid_name(F.col("p_name")).alias("name_ok"), T.archive_path(F.lit("2024-03-05").cast("date"), F.sha2("p_name", 256), F.col("p_name")).alias("path"))


@query(
    "F40_feed_dates",
    "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '2030-01-01' WHEN event_id % 5 = 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS published_at FROM events",
)
def feed_dates(t):
    f = F.date_format("ts", "dd MMM yyyy HH:mm:ss")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Mon, "), f, F.lit(" GMT"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Tue, "), f, F.lit(" +0200"))).when(F.col("event_id") % 5 == 2, f)
    return t.events.select("event_id", D.feed_date(raw, F.when(F.col("event_id") % 5 == 3, f), F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("published_at"))


@query(
    "F41_F42_F43_F44_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dotted, CAST(o_orderdate AS DATE) AS worded, CAST(o_orderdate AS DATE) AS header, CAST(NULL AS DATE) AS updated, o_orderdate AS iso, CAST(NULL AS DATE) AS wrong FROM orders",
)
def dates(t):
    published, updated = D.header_dates(F.concat(F.lit("Published on "), F.date_format("o_orderdate", "d MMM yyyy")))
    return t.orders.select(
        "o_orderkey",
        D.dotted_date(F.concat(F.lit("of "), F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("dotted"),
        D.worded_date(F.date_format("o_orderdate", "d MMMM yyyy")).alias("worded"),
        published.alias("header"),
        updated.alias("updated"),
        D.iso_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"),
        D.dotted_date(F.lit("31.02.2024")).alias("wrong"),
    )


NOISY = "SELECT event_id, concat('Sure! ```json\n', props, '\n``` done ', CASE WHEN event_id % 4 = 0 THEN '}' ELSE '' END) AS reply, props FROM {events}"


@query("F50_noisy_json", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS obj, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def noisy(t):
    o = V.json_object(F.col("reply"))
    return t.rows(NOISY).select("event_id", o.alias("obj"), F.get_json_object(o, "$.k").cast("long").alias("k"))


@query("F51_noisy_references", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1 ELSE 2 END AS n, CASE WHEN event_id % 3 > 0 THEN 'r' || user_id END AS first_ref FROM events")
def noisy_refs(t):
    one = F.concat(F.lit('{"ref": "r'), F.col("user_id").cast("string"), F.lit('", "context": "c"}'))
    reply = F.when(F.col("event_id") % 3 == 0, "none found").when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: ["), one, F.lit(', {"context": "x"}] ok'))).otherwise(F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
    r = V.json_references(reply)
    return t.events.select("event_id", F.size(r).alias("n"), F.get(r, F.lit(0))["ref"].alias("first_ref"))


VALUES = "SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'BOOL' WHEN 1 THEN 'DATE' WHEN 2 THEN 'LIST_TEXT' WHEN 3 THEN 'ENUM' ELSE 'TEXT' END AS kind, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'maybe' END WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-29' ELSE '2026' END WHEN 2 THEN ' a, b ,,c' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'odd' END ELSE ' x ' END AS value FROM {orders}"


@query(
    "F52_coerce",
    """SELECT o_orderkey, kind, CASE kind WHEN 'BOOL' THEN CASE WHEN value = 'Yes' THEN 'true' END WHEN 'DATE' THEN CASE WHEN length(value) = 10 THEN value END WHEN 'LIST_TEXT' THEN 'a,b,c' WHEN 'ENUM' THEN CASE WHEN value = 'new' THEN 'NEW' END ELSE 'x' END AS v,
    CASE WHEN kind IN ('BOOL', 'DATE', 'ENUM') AND o_orderkey % 2 = 1 THEN 'not a ' || lower(kind) END AS e FROM $vals""",
    vals=VALUES,
)
def coerce(t):
    v, e = V.coerce(F.col("value"), F.col("kind"), F.array(F.lit("NEW"), F.lit("AMENDS")))
    return t.rows(VALUES).select("o_orderkey", "kind", v.alias("v"), e.alias("e"))


@query("F53_split_known", "SELECT event_id, 1 AS n_core, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_custom FROM events")
def split_known(t):
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.col("props"), F.lit("other"), F.col("event_type"))).otherwise(F.create_map(F.lit("k"), F.col("props")))
    core, custom = V.split_known(m, ["k"])
    return t.events.select("event_id", F.size(core).alias("n_core"), F.size(custom).alias("n_custom"))


@query("F55_l2_distance", "SELECT a.label, round(avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1")
def l2(t):
    e = t.embeddings
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o")), "vec_id")
    return j.groupBy("label").agg(F.round(F.avg(V.l2_distance(F.col("embedding"), F.col("o"))), 6).alias("d"))


@query("F56_F57_rank_scores", "SELECT l_linenumber, round(sum(1.0 / (60 + l_linenumber + 1)), 6) AS rrf, round(sum(1.0 / (l_linenumber + 1)), 6) AS score FROM lineitem GROUP BY 1")
def rank_scores(t):
    r = F.col("l_linenumber")
    return t.lineitem.groupBy("l_linenumber").agg(F.round(F.sum(V.rrf_term(r)), 6).alias("rrf"), F.round(F.sum(V.result_score(r)), 6).alias("score"))


@query("P2_P3_T2_catalog_filter", "SELECT p_partkey, p_brand AS reference, p_name AS title FROM part WHERE p_partkey % 2 = 0 AND p_type IN ('ECONOMY', 'PROMO') AND (p_brand ILIKE '%ring%' OR p_name ILIKE '%ring%')")
def catalog_filter(t):
    c = t.part.select("p_partkey", F.col("p_brand").alias("reference"), F.col("p_name").alias("title"), F.col("p_type").alias("stage"), (F.col("p_partkey") % 2 == 0).alias("topic"))
    return c.where(views.catalog_filter(topic=True, stages=["ECONOMY", "PROMO"], search="Ring")).select("p_partkey", "reference", "title").orderBy("reference", "p_partkey")


@query("P4_stage_argument", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def stage_argument(t):
    stages = views.stage_argument("nonsense")
    c = t.orders.withColumn("stage", F.when(F.col("o_orderstatus") == "F", "IN_FORCE").otherwise("PROPOSAL"))
    return c.where(F.col("stage").isin(stages)).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("P10_display_names", "SELECT DISTINCT CASE WHEN source = 'src0' THEN 'ESMA' WHEN source = 'src1' THEN 'EUR-Lex' ELSE source END AS name FROM documents")
def names(t):
    s = F.when(F.col("source") == "src0", "esma_rss").when(F.col("source") == "src1", "eurlex_proposal").otherwise(F.col("source"))
    return t.documents.select(T.display_name(s).alias("name")).distinct()


@query("P11_P12_P13_urls", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '/a.PDF' WHEN p_partkey % 4 = 1 THEN '/b.pdf' WHEN p_partkey % 4 = 2 THEN 'https://eur-lex.europa.eu/legal-content/EN/TXT/HTML/?uri=CELEX:3X' ELSE '/c.html' END AS doc,
  CASE WHEN p_partkey % 3 = 0 THEN 'http://p/abc-22-' || p_partkey || '/' WHEN p_partkey % 3 = 1 THEN 'http://p/' || p_name || '/' END AS page, CASE WHEN p_partkey % 4 = 0 THEN '/a.PDF' END AS pdf, CASE WHEN p_partkey % 4 > 0 THEN '/c.html' END AS src FROM part""")
def urls(t):
    k = F.col("p_partkey") % 4
    stored = F.when(k == 0, "/a.PDF").otherwise("/c.html")
    pdf, src = views.link_kinds(stored)
    ref = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ABC 22/"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    page = views.page_url(ref, F.when(F.col("p_partkey") % 3 < 2, "WEB").otherwise("SEED"), "http://p/")
    return t.part.select("p_partkey", views.document_url(stored, F.when(k == 1, "/b.pdf"), F.when(k == 2, "3X")).alias("doc"), page.alias("page"), pdf.alias("pdf"), src.alias("src"))
