"""Queries for chunking, retrieval, pages, feeds, streams and models (F14-F23, T6-T9, A10-A15, J13-J16, S*, ST*, UD*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, index_store, indexing, inference, languages, quarantine, retrieval
from ..sources import feeds, pages, publications
from ..streaming import ingest, persist
from .registry import query

LEGAL = "SELECT doc_id, concat('Intro ', source, chr(10), chr(10), 'Chapter I Scope', chr(10), 'Article 1 Definitions', chr(10), replace(text, chr(10), ' '), '.', chr(10), 'Article 2 Rules, see Article 1', chr(10), 'of ', lang, chr(10), 'Chapter II Rest', chr(10), 'end ', source) AS text FROM {documents}"


@query(
    "F15_W8_W9_W11_segments",
    """SELECT doc_id, path, body FROM (SELECT doc_id, [] AS path, 'Intro ' || source AS body FROM documents UNION ALL SELECT doc_id, ['Chapter I Scope', 'Article 1 Definitions'], 'Article 1 Definitions' || chr(10) || replace(text, chr(10), ' ') || '.' FROM documents
    UNION ALL SELECT doc_id, ['Chapter I Scope', 'Article 2 Rules, see Article 1'], 'Article 2 Rules, see Article 1' || chr(10) || 'of ' || lang FROM documents UNION ALL SELECT doc_id, ['Chapter II Rest'], 'Chapter II Rest' || chr(10) || 'end ' || source FROM documents)""",
)
def segments(t):
    d = t.rows(LEGAL.replace("'Chapter II Rest', chr(10), 'end '", "chr(10), 'Chapter II Rest', chr(10), 'end '").replace("'Chapter I Scope', chr(10), 'Article 1", "'Chapter I Scope', chr(10), chr(10), 'Article 1").replace("'.', chr(10), 'Article 2", "'.', chr(10), chr(10), 'Article 2"))
    s = chunking.segments(d, "doc_id")
    return s.select("doc_id", "path", "body")


@query("F14_W8_heading_lines", "SELECT level, heading, count(*) AS n FROM documents CROSS JOIN (SELECT * FROM (VALUES (0, 'Chapter I Scope'), (1, 'Article 1 Definitions'), (1, 'Article 2 Rules, see Article 1')) v(level, heading)) GROUP BY 1, 2 UNION ALL SELECT 0, 'Chapter II Rest', count(*) FROM documents WHERE length(lang) < 2 HAVING count(*) > 0")
def heading_lines(t):
    d = t.rows(LEGAL.replace("'Chapter I Scope', chr(10)", "'Chapter I Scope', chr(10), 'a.', chr(10)"))
    return chunking.headings(d, "doc_id").groupBy("level", "heading").agg(F.count(F.lit(1)).alias("n"))


VERSIONS = "SELECT doc_id AS version_id, doc_id % 40 AS entity_id, text, doc_id % 17 = 0 AS protected FROM {documents}"
INDEXED = "SELECT DISTINCT entity_id, CASE WHEN entity_id % 3 = 0 THEN 'IN_FORCE' ELSE 'REPEALED' END AS stage, entity_id % 2 = 0 AS topic, CASE WHEN entity_id % 5 > 0 THEN 'AIFM' END AS kind FROM (SELECT doc_id % 40 AS entity_id FROM {documents})"


def _catalog(t):
    return t.rows(INDEXED).withColumn("kinds", F.when(F.col("kind").isNotNull(), F.array("kind")))


WORDS = r"SELECT version_id, entity_id, unnest(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM $v WHERE NOT protected"
CHANGED = "CASE WHEN entity_id % 4 = 0 THEN concat('amended version ', text) ELSE text END"
PER_TERM = "SELECT term, count(*) AS n, count(DISTINCT version_id) AS n_versions FROM ({0}) GROUP BY 1"


def _per_term(t, root):
    """Of each term of a stored index, how often it occurs, in how many versions."""
    b = index_store.live(t.spark, root, "postings")  # a live block for each term and version
    n = F.aggregate("tfs", F.lit(0).cast("long"), lambda n, tf: n + tf)
    return b.groupBy("term").agg(F.sum(n).alias("n"), F.count("version_id").alias("n_versions"))


@query("M25_index_build", r"SELECT version_id, stage, topic, kind, true AS vectors FROM $v JOIN $c USING (entity_id) WHERE NOT protected AND regexp_matches(text, '\S')", v=VERSIONS, c=INDEXED)
def index_build(t):
    """The catalog values on the chunks of every version, and whether each of its chunks has its vector."""
    root = t.folder("index")
    index_store.build(root, t.rows(VERSIONS), _catalog(t), inference.hash_embedding, 0, overlap=0)
    c, v = (index_store.live(t.spark, root, name) for name in ("chunks", "vectors"))
    c = c.hint("merge").join(v.select("chunk_id", F.size("embedding").alias("dims")), "chunk_id", "left")
    per = c.groupBy("version_id", "stage", "topic", F.col("kinds")[0].alias("kind")).agg(F.every(F.col("dims") == 8).alias("vectors"))
    return per.select("version_id", "stage", "topic", "kind", "vectors")


@query("M25_postings", PER_TERM.format(WORDS.format("text")), v=VERSIONS.replace("{documents}", "documents"))
def index_postings(t):
    """The text index of all versions, term by term."""
    root = t.folder("index")
    index_store.build(root, t.rows(VERSIONS), _catalog(t), inference.hash_embedding, 0, overlap=0)
    return _per_term(t, root)


@query("M17_reindex", PER_TERM.format(WORDS.format(CHANGED)), v=VERSIONS.replace("{documents}", "documents"))
def reindex(t):
    """Versions of every fourth entity change and are built again, twice; the merged index is that of all texts as they are now."""
    root, merged = t.folder("index"), t.folder("merged")
    v, c = t.rows(VERSIONS), _catalog(t)
    index_store.build(root, v, c, inference.hash_embedding, 0, overlap=0)
    again = v.where("entity_id % 4 = 0").withColumn("text", F.concat(F.lit("amended version "), "text"))
    chosen = again.select("entity_id").distinct()
    index_store.reindex(root, again.withColumn("text", F.lit("draft")), c, chosen, inference.hash_embedding, overlap=0)
    index_store.reindex(root, again, c, chosen, inference.hash_embedding, overlap=0)
    index_store.merge(t.spark, root, merged)
    return _per_term(t, merged)


@query(
    "T7_stored_index",
    r"""WITH t AS (SELECT version_id AS chunk_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM $v WHERE NOT protected AND regexp_matches(text, '\S')), c AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM t),
    q AS (SELECT DISTINCT item_id AS question_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark), p AS (SELECT chunk_id, term, n_terms, count(*) AS tf FROM (SELECT chunk_id, len(w) AS n_terms, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT question_id, chunk_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / avg_len))), 6) AS score FROM p JOIN df USING (term) JOIN q USING (term), c GROUP BY 1, 2),
    r AS (SELECT question_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC) - 1 AS r FROM s) SELECT question_id, CAST(r AS INT) AS sparse_rank, count(*) AS n FROM r WHERE r < 30 GROUP BY 1, 2""",
    v=VERSIONS.replace("{documents}", "documents"),
)
def stored_search(t):
    """BM25 over a stored index whose chunks are whole versions; how many chunks each rank of a question has (ids of chunks are hashes)."""
    root = t.folder("index")
    index_store.build(root, t.rows(VERSIONS), _catalog(t), inference.hash_embedding, 0, tokens=1 << 20, overlap=0)
    hits = index_store.search(t.spark, root, t.benchmark.select(F.col("item_id").alias("question_id"), "text"), 30)
    return hits.groupBy("question_id", "sparse_rank").agg(F.count(F.lit(1)).alias("n"))


@query("F24_language_profiles", "SELECT lang, count(*) AS n, true AS accurate FROM documents WHERE doc_id % 2 = 1 GROUP BY 1")
def language_profiles(t):
    """Profiles learned from the documents with an even id, kept as a table, and how the others fare: at least 98 of 100 in each language."""
    path = t.folder("profiles")
    languages.learn(t.documents.where("doc_id % 2 = 0")).write.parquet(path)
    known = languages.load(t.spark, path)
    rest = t.documents.where("doc_id % 2 = 1").select("lang", languages.detect(F.col("text"), known).alias("found"))
    return rest.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("lang").eqNullSafe(F.col("found")).cast("int")) >= 0.98).alias("accurate"))


@query("F16_F17_M25_chunks")
def chunks(t):
    d = t.rows(LEGAL).withColumn("meta", F.lit("doc"))
    return chunking.chunk(d, "doc_id", meta="meta", tokens=200, overlap=20).withColumn("language", T.language(F.col("text")))


@query("A15_W10_chunk_totals", "SELECT count(*) AS n_versions FROM documents")
def chunk_totals(t):
    c = chunking.chunk(t.rows(LEGAL), "doc_id", tokens=200, overlap=20)
    per = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("top"))
    return per.where("n = top + 1").agg(F.count(F.lit(1)).alias("n_versions"))


Q_DENSE = "SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6), b.vec_id) - 1 AS r FROM embeddings a CROSS JOIN embeddings b WHERE $asked"


def _vectors(t):
    """Every vector as a chunk, and every vector as a possible question."""
    c = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return c, c.withColumnRenamed("chunk_id", "question_id")


@query("T6_W12_dense", f"SELECT question_id, chunk_id, CAST(r AS INT) AS dense_rank FROM ({Q_DENSE.replace('$asked', 'a.vec_id % 100 = 0')}) WHERE r < 30")
def dense(t):
    """The query set of a search: every vector whose id is divisible by 100, against all vectors."""
    c, q = _vectors(t)
    return retrieval.dense(c, q.where("question_id % 100 = 0"), 30)


TOK = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
BM25 = f"""t AS (SELECT doc_id AS chunk_id, {TOK.format('text')} AS w FROM documents), c AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM t),
  q AS (SELECT DISTINCT item_id AS question_id, unnest({TOK.format('text')}) AS term FROM benchmark), p AS (SELECT chunk_id, term, n_terms, count(*) AS tf FROM (SELECT chunk_id, len(w) AS n_terms, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT question_id, chunk_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / avg_len))), 6) AS score FROM p JOIN df USING (term) JOIN q USING (term), c GROUP BY 1, 2),
  r AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1 AS r FROM s)"""


def _texts(t):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), t.benchmark.select(F.col("item_id").alias("question_id"), "text")


@query("T7_A12_bm25", f"WITH {BM25} SELECT question_id, chunk_id, CAST(r AS INT) AS sparse_rank FROM r WHERE r < 30")
def bm25(t):
    return retrieval.sparse(*_texts(t), 30)


@query("A12_corpus_statistics", f"SELECT count(*) AS n_docs, count(DISTINCT w) AS n_terms, round(sum(n) / count(DISTINCT doc_id), 4) AS avg_len FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({TOK.format('text')}) AS w FROM documents) GROUP BY 1, 2)")
def corpus(t):
    p = retrieval.postings(_texts(t)[0])
    return p.agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("term").alias("n_terms"), F.round(F.sum("tf") / F.countDistinct("chunk_id"), 4).alias("avg_len"))


@query(
    "A11_T9_U5_fusion",
    f"""WITH {BM25}, d AS ({Q_DENSE.replace('$asked', 'a.vec_id IN (SELECT item_id FROM benchmark)')}), u AS (SELECT question_id, chunk_id, min(dr) AS dr, min(sr) AS sr FROM (SELECT question_id, chunk_id, r AS dr, NULL AS sr FROM d WHERE r < 30 UNION ALL SELECT question_id, chunk_id, NULL, r FROM r WHERE r < 30) GROUP BY 1, 2)
    SELECT question_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + dr + 1), 0) + coalesce(1.0::DOUBLE / (60 + sr + 1), 0), 9) AS rrf, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + dr + 1), 0) + coalesce(1.0::DOUBLE / (60 + sr + 1), 0), 9) DESC, dr ASC NULLS LAST, sr ASC NULLS LAST, chunk_id) - 1 AS INT) AS fused_rank FROM u""",
)
def fusion(t):
    docs, q = _texts(t)
    c, v = _vectors(t)
    return retrieval.fuse(retrieval.dense(c, v.join(q, "question_id", "left_semi"), 30), retrieval.sparse(docs, q, 30)).select("question_id", "chunk_id", "rrf", "fused_rank")


def _chunks(t):
    """Every document as a chunk, with a vector where there is one, a version of five chunks, and a heading path."""
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    art = F.concat(F.lit("Article "), (F.col("doc_id") % 3).cast("string"))
    return t.documents.join(v, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), "text", "embedding", F.floor(F.col("doc_id") / 5).cast("long").alias("version_id"), (F.col("doc_id") % 5).cast("int").alias("chunk_index"), (F.col("doc_id") % 40).alias("entity_id"),
        F.when(F.col("doc_id") % 4 > 0, F.array(F.lit("Chapter I"), art)).otherwise(F.array(F.lit("Chapter I"))).alias("heading_path"), (F.col("doc_id") % 5 == 4).alias("is_definition"), (F.col("doc_id") % 2 == 0).alias("topic"), F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("AIFM"))).alias("kinds"),
    )


def _questions(t):
    b = t.benchmark.select(F.col("item_id").alias("question_id"), "text")
    return b.join(t.embeddings.select(F.col("vec_id").alias("question_id"), "embedding"), "question_id", "left")


def _core(t):
    return retrieval.retrieve(_chunks(t), _questions(t), k=10, condition=retrieval.chunk_filter(topic=True, kind="AIFM"))


@query("P9_T8_J13_F57_retrieve")
def retrieve(t):
    return _core(t).select("question_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


@query("P9_chunk_filter", "SELECT entity_id, count(*) AS n FROM (SELECT doc_id % 40 AS entity_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 > 0 AND doc_id % 40 IN (2, 4, 6)) GROUP BY 1")
def chunk_filter(t):
    return _chunks(t).where(retrieval.chunk_filter(topic=True, entities=[2, 4, 6], versions=[], kind="AIFM")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("A10_T8_pool_size", "SELECT count(*) AS scoped, greatest(2 * count(*), 60, 100) AS pool FROM documents WHERE doc_id % 2 = 0")
def pool(t):
    n = F.count(F.lit(1))
    return _chunks(t).where(retrieval.chunk_filter(topic=True)).agg(n.alias("scoped"), F.greatest(2 * n, F.lit(60).cast("long"), F.lit(100).cast("long")).alias("pool"))


CORE = "SELECT q, c AS chunk_id, CAST(floor(c / 5) AS BIGINT) AS version_id, c % 4 > 0 AS has, c % 3 AS art FROM (SELECT DISTINCT vec_id AS q, vec_id * 11 % (SELECT max(doc_id) + 1 FROM documents) AS c FROM embeddings) WHERE c IN (SELECT doc_id FROM documents)"


def _hits(t, chunks):
    """A chunk for every vector as a question."""
    n = (chunks.agg(F.max("chunk_id")).first()[0] or 0) + 1
    return t.embeddings.select(F.col("vec_id").alias("question_id"), (F.col("vec_id") * 11 % n).alias("chunk_id")).join(chunks, "chunk_id")


@query(
    "J16_expand",
    f"""WITH core AS ({CORE}), d AS (SELECT doc_id, CAST(floor(doc_id / 5) AS BIGINT) AS version_id FROM documents),
    more AS (SELECT q, doc_id FROM core JOIN d USING (version_id) WHERE has AND doc_id <> chunk_id AND ((doc_id % 4 > 0 AND doc_id % 3 = art) OR doc_id % 5 = 4))
    SELECT q AS question_id, chunk_id, false AS is_context FROM core UNION ALL SELECT q, doc_id, true FROM more""",
)
def expand(t):
    c = _chunks(t)
    core = _hits(t, c).withColumns({"rank": F.lit(0), "score": F.lit(1.0)})
    return retrieval.expand(core, c).select("question_id", "chunk_id", "is_context")


@query("J14_citations", f"WITH core AS ({CORE}) SELECT q AS question_id, '[' || CASE WHEN chunk_id % 40 < 20 THEN 'R' || chunk_id % 40 ELSE 'reg ' || chunk_id % 40 END || ' · Chapter I' || CASE WHEN has THEN ', Article ' || art ELSE '' END || ']' AS citations FROM core")
def citations(t):
    core = _hits(t, _chunks(t)).withColumn("rank", F.lit(0))
    twice = core.unionByName(core.withColumn("rank", F.lit(1)))
    return retrieval.citations(twice, t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.concat(F.lit("R"), "n_nationkey").alias("reference")))


@query("UD8_F34_answers")
def answers(t):
    core, c = _core(t), _chunks(t)
    hits = retrieval.expand(core, c).hint("merge").join(c.select("chunk_id", "text", "entity_id", "heading_path"), "chunk_id")
    return inference.answer(retrieval.prompts(hits, _questions(t)), inference.echo_provider)


# Pages


@query("S14_filter_options", r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"/]+)">([^<]+)</a>', 1) AS v, regexp_extract_all(html, '<a href="/([^"/]+)">([^<]+)</a>', 2) AS l FROM pages), x AS (SELECT page_id, unnest(v) AS value, unnest(l) AS label, unnest(range(len(v))) AS pos FROM r) SELECT page_id, value, arg_min(label, pos) AS label FROM x GROUP BY 1, 2""")
def options(t):
    return pages.filter_options(t.pages, "page_id", "html", r'<a href="/([^"/]+)">([^<]+)</a>')


@query("S12_listing_rows")
def listing(t):
    return pages.listing_rows(t.pages, "page_id", "html", r"[A-Z][a-z]+")


@query("S13_F13_detail")
def detail(t):
    return pages.detail(t.pages, "page_id", "html")


PUBLISHED = "SELECT p_partkey, p_size, p_name, p_type, p_brand, concat('CSSF ', CAST(p_size + 10 AS VARCHAR(9)), '/', CAST(p_partkey AS VARCHAR(9))) AS ref FROM {part}"
DAY = "CAST(p_size % 28 + 1 AS VARCHAR(9))"
LIST_PAGE = f"""SELECT p_partkey, concat('<html><nav><a href="/x">no</a><ul>', CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat('<li class="library-element top"><p class="library-element__type">Circular<p class="library-element__dates"><span class="date--published">Published on ', {DAY}, '.03.2024</span>',
  '<div class="library-element__main"><h3 class="library-element__title"><a href="/en/', CAST(p_partkey AS VARCHAR(9)), '">Circular  ', ref, ' <b>on</b> ', p_name, '</a></h3><div class="library-element__subtitle"><p>', p_type, '<br>&amp; more</div></div>',
  '<li class=library-element><h3 class="library-element__title"><a href="https://else.where/', p_brand, '">Circular ', ref, '9</a></h3>', '<li class="library-element"><h3 class="library-element__title"><a href="/y">No reference</a></h3>') END, '</ul></nav><ul><li><a href="/z">Circular CSSF 1/1</a></ul>') AS html FROM ({PUBLISHED})"""
DETAIL_PAGE = f"""SELECT p_partkey, concat('<body><h1>Site</h1><h1 class="single-news__title">Circular ', ref, ' ', p_name, CASE WHEN p_partkey % 4 = 0 THEN ' (as amended by Circular CSSF 30/1, and CSSF 30/2 and CSSF  30/1)' ELSE '' END, '</h1><div class="content-header-info">Published on ', {DAY}, ' March 2024 Updated on ', {DAY}, ' Apr 2024 Share</div>',
  '<ul class="entities-list"><li>Banks<li>Funds<li>Banks</ul><div class="single-news__content"><p>Short.<p>', p_type, ' applies to all entities under supervision from now on.</div>', CASE WHEN p_partkey % 3 = 0 THEN concat('<div class="single-news__subtitle"><p>', p_brand, '</p>and more</div>') ELSE '' END,
  '<div class="related-documents-container"><ul><li class="related-document no-heading"><a href="/f/', CAST(p_partkey AS VARCHAR(9)), '.pdf">FR</a><a href="/f/', CAST(p_partkey AS VARCHAR(9)), 'ENG.pdf">EN</a><li class="related-document"><h4 class="related-document-title">Circular CSSF 12/552</h4><p class="related-document-excerpt">on governance',
  '<li class="related-document"><h4 class="related-document-title">Circular CSSF 40/1</h4><div class="related-document-excerpt">Amending Circular x</div><li class="related-document"><h4 class="related-document-title">', ref, '</h4><li class="related-document"><h4 class="related-document-title">Note without</h4></ul></div>') AS html FROM ({PUBLISHED})"""


@query(
    "S12_listing_fields",
    f"""WITH p AS (SELECT *, CAST('2024-03-01' AS DATE) + CAST(p_size % 28 AS INT) AS d FROM ({PUBLISHED.replace("{part}", "part")}))
    SELECT p_partkey, 0 AS raw_count, CAST(NULL AS INT) AS pos, NULL AS title, NULL AS link, NULL AS reference, NULL AS subtitle, CAST(NULL AS DATE) AS published_on FROM p WHERE p_partkey % 9 = 0
    UNION ALL SELECT p_partkey, 3, 0, concat('Circular ', ref, ' on ', p_name), concat('https://x/en/', p_partkey), ref, concat(p_type, ' & more'), d FROM p WHERE p_partkey % 9 > 0
    UNION ALL SELECT p_partkey, 3, 1, concat('Circular ', ref, '9'), concat('https://else.where/', p_brand), concat(ref, '9'), '', NULL FROM p WHERE p_partkey % 9 > 0""",
)
def listing_fields(t):
    """Listing pages with elements that are never closed, a class without quotes, and links outside the list."""
    return publications.listing(t.rows(LIST_PAGE, part=t.spread("part", "p_partkey")), "p_partkey", "html", "https://x")


@query(
    "S13_detail_fields",
    f"""SELECT p_partkey, ref AS reference, concat('Circular ', ref, ' ', p_name) AS title, CASE WHEN p_partkey % 4 = 0 THEN ['CSSF 30/1', 'CSSF 30/2'] ELSE [] END AS amended_by, ['CSSF 12/552'] AS amends, ['Banks', 'Funds'] AS entities,
    concat('/f/', p_partkey, 'ENG.pdf') AS pdf_en, concat('/f/', p_partkey, '.pdf') AS pdf_fr, CAST('2024-03-01' AS DATE) + CAST(p_size % 28 AS INT) AS published_on, CAST('2024-04-01' AS DATE) + CAST(p_size % 28 AS INT) AS updated_on,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE concat(p_type, ' applies to all entities under supervision from now on.') END AS description FROM ({PUBLISHED.replace("{part}", "part")})""",
)
def detail_fields(t):
    return publications.detail(t.rows(DETAIL_PAGE, part=t.spread("part", "p_partkey")), "p_partkey", "html")


MESSY = "SELECT page_id, concat('<head><title>t</title></head><nav>menu ', CAST(page_id AS VARCHAR(9)), '</nav><script>var x = 1;</script><div>first <b>line</b></div><form><p>', url, '<table><tr><td>a<td>', CAST(page_id AS VARCHAR(9)), '<tr><td>b</table><footer>gone</footer>end &amp; rest') AS html FROM {pages}"


@query("S16_main_text_of_messy_pages", "SELECT page_id, concat('first line', chr(10), url, chr(10), 'a | ', page_id, chr(10), 'b', chr(10), 'end & rest') AS text FROM pages")
def messy_text(t):
    """Pages with elements that are never closed, a form among them."""
    return t.rows(MESSY).select("page_id", pages.main_text("html").alias("text"))


@query("S16_main_text")
def main_text(t):
    return t.pages.select("page_id", pages.main_text("html").alias("text"))


@query("S15_routing", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'TEXT' WHEN page_id % 5 IN (1, 2, 3) THEN 'PDF' ELSE 'HTML' END AS kind FROM pages")
def routing(t):
    k = F.col("page_id") % 5
    url = F.when(k == 1, F.concat("url", F.lit(".PDF"))).otherwise(F.lit("http://x"))
    body = F.when(k == 2, F.concat(F.lit("%PDF-1.7"), "html")).otherwise(F.col("html")).cast("binary")
    return t.pages.select("page_id", pages.route(F.when(k == 0, "text"), url, body, F.when(k == 3, "Application/PDF; x").otherwise("text/html")).alias("kind"))


# Feeds: landed files are written from the driver's tables first.


@query(
    "S1_S2_S3_S4_W1_feed_items",
    """SELECT 'http://x/' || k AS link, arg_min(event_type, (user_id % 3, event_id)) AS title, count(*) AS n FROM (SELECT *, CASE WHEN event_id % 17 > 0 THEN event_id % 500 END AS k FROM events) WHERE k IS NOT NULL AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY k""",
)
def feed_items(t):
    e = t.events.select(
        F.col("event_type").alias("title"), F.when(F.col("event_id") % 17 > 0, F.concat(F.lit("http://x/"), (F.col("event_id") % 500).cast("string"))).alias("link"), F.col("event_id").cast("string").alias("description"),
        F.date_format("ts", "'Mon, 'dd MMM yyyy HH:mm:ss' GMT'").alias("pubDate"), (F.col("user_id") % 3).alias("f"),
    )
    root = t.folder("feeds")
    e.write.format("xml").option("rowTag", "item").option("rootTag", "channel").partitionBy("f").save(root)
    items = feeds.recent(feeds.read_rss(t.spark, root, F.lit("2030-01-01").cast("timestamp"), "feed"), F.lit("2024-01-10").cast("timestamp"))
    items = items.withColumn("f", F.regexp_extract("feed", r"f=(\d)", 1).cast("int")).withColumn("n", F.col("description").cast("long"))
    per = items.groupBy("link").agg(F.count(F.lit(1)).alias("n_items"))
    first = feeds.first_links(items, ["f", "n"])
    return first.join(per, "link").select("link", "title", F.col("n_items").alias("n"))


@query("S2_consultations", "SELECT doc_id FROM documents WHERE contains(lower(text), 'consultation') OR contains(lower(text), 'feedback') OR contains(lower(text), 'call for evidence') OR doc_id % 10 = 0")
def consultations(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "Call for Evidence").otherwise("x").alias("title"), F.col("text").alias("description"))
    return feeds.with_words(d).select("doc_id")


ACTS = "SELECT concat(CASE WHEN o_orderkey % 3 = 0 THEN '5' ELSE '3' END, CAST(2000 + o_orderkey % 25 AS VARCHAR), 'R', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')) AS celex, CASE WHEN o_orderkey % 2 = 0 THEN 'Loi financière ' ELSE 'Other ' END || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey FROM orders"


#: Result rows of a landed file, about; an endpoint gives its results in pages.
PAGE_ROWS = 10_000


def _land_results(rows, key: str, root: str) -> None:
    """Write rows (key, b: a result row's map of bindings) as query results, a file for each page. Lines are sorted and written one by one, so no task holds a page."""
    n = max(1, -(-rows.count() // PAGE_ROWS))
    w = Window.partitionBy("file").orderBy(key)
    pages = rows.select(key, F.to_json("b").alias("b"), F.pmod(F.xxhash64(key), F.lit(n)).alias("file"))
    begin, end = F.when(F.row_number().over(w) == 1, '{"results":{"bindings":[').otherwise(","), F.when(F.lead(F.lit(1)).over(w).isNull(), "]}}").otherwise("")
    lines = pages.select("file", key, F.concat(begin, "b", end).alias("line")).sortWithinPartitions("file", key)
    lines.select("line", "file").write.partitionBy("file").text(root)


def _acts(t):
    k = F.col("o_orderkey")
    celex = F.concat(F.when(k % 3 == 0, "5").otherwise("3"), (2000 + k % 25).cast("string"), F.lit("R"), F.lpad((k % 10000).cast("string"), 4, "0"))
    title = F.concat(F.when(k % 2 == 0, "Loi financière ").otherwise("Other "), k.cast("string"))
    rows = t.orders.select(celex.alias("celex"), title.alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), k.cast("string").alias("work"), F.when(k % 4 == 0, F.concat(F.lit("eli/"), k)).alias("eli"), k.alias("k"))
    cell = lambda c: F.struct(F.lit("literal").alias("type"), F.col(c).alias("value"))
    binding = F.map_filter(F.create_map(*(x for c in ("celex", "title", "date", "work", "eli") for x in (F.lit(c), cell(c)))), lambda n, v: v["value"].isNotNull())
    root = t.folder("sparql")
    _land_results(rows.select("k", binding.alias("b")), "k", root)
    return feeds.read_sparql(t.spark, root, {"celex": ["celex"], "title": ["title"], "date": ["date"], "eli": ["eli", "work"]})


@query("S5_S7_S8_bindings", f"SELECT celex, title, date, CASE WHEN o_orderkey % 4 = 0 THEN 'eli/' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS eli FROM ({ACTS})")
def bindings(t):
    return _acts(t)


@query("S6_proposals", f"SELECT celex, title FROM ({ACTS}) WHERE celex LIKE '5%' AND date >= '1996-01-01'")
def proposals(t):
    return feeds.acts(_acts(t), F.lit("1996-01-01").cast("timestamp"), prefix="5").select("celex", "title")


@query("S7_S9_newest_acts", f"SELECT celex, title FROM ({ACTS}) WHERE contains(lower(title), 'financ') AND date >= '1996-01-01' ORDER BY date DESC, celex, title LIMIT 200")
def newest(t):
    return feeds.acts(_acts(t), F.lit("1996-01-01").cast("timestamp"), words=feeds.DOMAIN_WORDS).orderBy(F.desc("date"), "celex", "title").limit(200).select("celex", "title")


@query("S10_U1_sources", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src5') GROUP BY 1")
def sources(t):
    items = {s: t.documents.where(F.col("source") == s) for s in ("src1", "src2", "src3", "src5")}
    chosen = feeds.select_sources(items, {}, only=["pair", "src5"], groups={"pair": ["src1", "src2"]})
    readers = {str(k): (lambda d=d: d) for k, d in enumerate(chosen)} | {"broken": lambda: t.spark.read.parquet("/nowhere")}
    out, errors = feeds.union_sources(readers)
    assert set(errors) == {"broken"}
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "UD3_registered_sources",
    """SELECT 'rss' AS source, 'http://x/' || event_id AS link, date_trunc('second', ts) AS published_at FROM events WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00'
    UNION ALL SELECT 'sparql', 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:5' || lpad(CAST(p_partkey AS VARCHAR), 6, '0'), TIMESTAMP '2024-02-01 00:00:00' FROM part WHERE p_partkey % 2 = 0""",
)
def registered_sources(t):
    """Two registered sources over landed files; a third one, whose files are missing, is an error and not the end."""
    rss, results = t.folder("rss"), t.folder("results")
    e = t.events.select(F.col("event_type").alias("title"), F.concat(F.lit("http://x/"), F.col("event_id").cast("string")).alias("link"), F.date_format("ts", "dd MMM yyyy HH:mm:ss' GMT'").alias("pubDate"))
    e.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(rss)
    cell = lambda c: F.struct(F.lit("literal").alias("type"), c.alias("value"))
    celex = F.concat(F.when(F.col("p_partkey") % 2 == 0, "5").otherwise("3"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    b = t.part.select(F.create_map(F.lit("celex"), cell(celex), F.lit("title"), cell(F.col("p_name")), F.lit("date"), cell(F.lit("2024-02-01"))).alias("b"), "p_partkey")
    _land_results(b, "p_partkey", results)
    feeds.REGISTRY.setdefault("missing", lambda spark, since: spark.read.parquet(f"{rss}-nowhere"))
    options = {"rss": {"path": rss, "now": F.lit("2030-01-01").cast("timestamp")}, "sparql": {"path": results, "prefix": "5"}, "missing": {}}
    items, errors = feeds.fetch_sources(t.spark, F.lit("2024-01-10").cast("timestamp"), options)
    return items.where(F.lit(set(errors) == {"missing"})).select("source", "link", "published_at")


@query("S11_seed_tables", "SELECT p_partkey, a.pattern, a.kind, CASE WHEN p_partkey % 3 = 0 THEN 'AIFM' WHEN p_partkey % 3 = 1 THEN 'CHAPTER15_MANCO' ELSE 'BOTH' END AS applies FROM (SELECT p_partkey, unnest([{'pattern': p_name, 'kind': 'EXACT'}, {'pattern': p_brand, 'kind': 'REGEX'}]) AS a FROM part)")
def seed(t):
    alias = lambda c, k: F.struct(F.col(c).alias("pattern"), F.lit(k).alias("kind"))
    k = F.col("p_partkey") % 3
    s = t.part.select(F.col("p_partkey").cast("string").alias("reference_number"), F.when(k == 0, "AIFM_ONLY").when(k == 1, "MANCO_ONLY").otherwise("ANY").alias("applicability"), F.array(alias("p_name", "EXACT"), alias("p_brand", "REGEX")).alias("aliases"))
    _, aliases, applies = feeds.seed_tables(s)
    return aliases.hint("merge").join(applies.withColumnRenamed("kind", "applies"), "reference_number").select(F.col("reference_number").cast("long").alias("p_partkey"), "pattern", "kind", "applies")


# Streams


def _landed(t) -> str:
    root = t.folder("landed")
    t.documents.select("doc_id", "source", F.md5("text").alias("content_hash"), F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("at")).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(root)
    return root


ITEM = "doc_id long, source string, content_hash string, at timestamp"


@query("ST1_ST2_stream_dedup", "SELECT md5(text) AS content_hash, count(DISTINCT md5(text)) AS n FROM documents GROUP BY 1")
def stream_dedup(t):
    out = t.folder("out")
    ingest.run(ingest.without_copies(ingest.landed(t.spark, _landed(t), ITEM, files=1)), t.folder("state"), ingest.to_folder(out))
    return t.spark.read.parquet(out).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ST4_stream_persist",
    """WITH first AS (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1),
    e AS (SELECT d.doc_id, d.text, f.h AS content_hash FROM documents d JOIN first f USING (doc_id)),
    l AS (SELECT doc_id, content_hash, unnest(list_distinct([doc_id % 5, length(text) % 13])) AS entity_id FROM e)
    SELECT entity_id, doc_id, content_hash, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY doc_id) AS INT) AS version_number,
           doc_id = max(doc_id) OVER (PARTITION BY entity_id) AS is_current,
           count(*) OVER (PARTITION BY doc_id) AS n_links, (SELECT count(*) FROM e) AS n_events FROM l""",
)
def stream_persist(t):
    """Documents land four times and each time the stream takes up where it was; the last batch then runs once more, which changes nothing."""
    root, landed, state, again = (t.folder(x) for x in ("persist", "landed", "state", "again"))
    items = t.documents.select("doc_id", "text", F.md5("text").alias("content_hash"))
    top = items.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]

    def link(events):
        entities = F.array_compact(F.array_distinct(F.array(F.col("doc_id") % 5, (F.length("text") % 13).cast("long"))))
        return events.select("doc_id", "content_hash", F.explode(entities).alias("entity_id"))

    for k in range(4):
        items.where(F.floor(F.col("doc_id") * 4 / top) == k).write.mode("append").parquet(landed)
        persist.run(ingest.landed(t.spark, landed, "doc_id long, text string, content_hash string"), root, state, link, ["doc_id"])
    batch = persist.committed(t.spark, root, "ledger").agg(F.max("batch")).first()[0]
    persist.committed(t.spark, root, "events").where(F.col("batch") == batch).drop("batch").write.parquet(again)
    persist.batch_writer(root, link, ["doc_id"])(t.spark.read.parquet(again), batch)
    n = persist.committed(t.spark, root, "ledger").agg(F.sum("n_events").alias("n_events"))
    links = persist.committed(t.spark, root, "links").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    versions = persist.current_versions(t.spark, root).drop("batch")
    return versions.hint("merge").join(links, "doc_id").crossJoin(F.broadcast(n))


@query("ST3_stream_late_items", "SELECT count(*) AS n FROM documents WHERE doc_id >= 100")
def stream_late(t):
    out = t.folder("out")
    since = F.lit("2024-01-01 00:01:40").cast("timestamp")
    ingest.run(ingest.not_late(ingest.landed(t.spark, _landed(t), ITEM), "at", since, "1 day"), t.folder("state"), ingest.to_folder(out))
    return t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))


@query("ST5_stream_versions", "WITH c AS (SELECT source, doc_id, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) SELECT source AS entity, count(*) AS n_versions FROM c WHERE b IS NULL OR b <> h GROUP BY 1")
def stream_versions(t):
    out = t.folder("out")
    items = ingest.landed(t.spark, _landed(t), ITEM).withColumnRenamed("source", "entity")
    ingest.run(ingest.versions(items), t.folder("state"), ingest.to_folder(out))
    return t.spark.read.parquet(out).groupBy("entity").agg(F.max("version_number").cast("long").alias("n_versions"))


# Models


@query("UD1_UD5_UD6_inference", "SELECT item_id, substring(sha256(text), 1, 16) AS reply FROM benchmark")
def infer(t):
    return inference.infer(t.benchmark, "text", inference.echo_provider).where("error is null").select("item_id", "reply")


@query("UD2_embedding", "SELECT item_id, 8 AS dims FROM benchmark")
def embedding(t):
    return inference.embed(t.benchmark, "text", inference.hash_embedding).select("item_id", F.size("embedding").alias("dims"))


def _too_long(prompts: list[str]) -> list[str]:
    if len(prompts[0]) > 1000:
        raise ValueError("too long")
    return [str(len(prompts[0]))]


@query("UD4_extract_fields", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, doc_id % 9 > 0 AND length(text) > 1000 AS truncated, CASE WHEN doc_id % 9 = 0 THEN 'no text' END AS error FROM documents")
def extract(t):
    """Every ninth document counts as one without text; cuts are reported for those of positive ids that are no ninth."""
    done = inference.extract_fields(t.documents, "text", _too_long, "doc_id", missing=F.col("doc_id") % 9 == 0)
    return done.select("doc_id", "status", ((F.col("doc_id") % 9 > 0) & F.col("truncated")).alias("truncated"), "error")


def _failing(prompts: list[str]) -> list[str]:
    if "e" not in prompts[0][:40]:
        raise RuntimeError("model is gone")
    return [str(len(prompts[0]))]


@query(
    "UD6_quarantined_calls",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'no text' WHEN NOT contains(substring(text, 1, 40), 'e') THEN 'call failed' END AS reason FROM documents)
    SELECT doc_id, reason, count(*) OVER (PARTITION BY reason) AS n_reason, (SELECT count(*) FROM r) AS n_rows FROM r WHERE reason IS NOT NULL""",
)
def quarantined_calls(t):
    """Calls to a model that fail for some texts: these rows go to quarantine with a reason, the others go on."""
    replies = inference.extract_fields(t.documents, "text", _failing, "doc_id", missing=F.col("doc_id") % 9 == 0)
    none = F.coalesce(F.col("error") == "no text", F.lit(False))
    _, rejected, n = quarantine.split(replies, {"no text": none, "call failed": (F.col("status") == "FAILED") & ~none}, t.folder("calls"))
    counts = F.create_map(*(F.lit(x) for kv in n.items() for x in kv))
    reason = F.get("reasons", F.lit(0))
    return rejected.select("doc_id", reason.alias("reason"), counts[reason].cast("long").alias("n_reason"), F.lit(n["rows"]).cast("long").alias("n_rows"))


@query("UD7_F52_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 'not a date' END AS e FROM events")
def fields(t):
    kinds = t.spark.createDataFrame([("k", "TEXT", []), ("d", "DATE", [])], "name string, kind string, choices array<string>")
    raw = t.events.select("event_id", F.regexp_replace("props", r"\}$", ', "d": "2026"}').alias("raw"))
    c = inference.coerced(raw, kinds, "event_id")
    return c.select("event_id", F.col("values")["k"].alias("k"), F.col("errors")["d"].alias("e"))


@query("UD7_F34_field_lines", "SELECT string_agg('- ' || s_name || ' (TEXT' || CASE WHEN s_suppkey % 2 = 0 THEN ': a|b' ELSE '' END || ')', chr(10) ORDER BY s_suppkey, s_name) AS lines FROM supplier WHERE s_suppkey % 3 = 0")
def field_lines(t):
    f = t.supplier.select(F.col("s_suppkey").alias("display_order"), F.col("s_name").alias("name"), F.lit("TEXT").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("choices"), (F.col("s_suppkey") % 3 == 0).alias("active"))
    return inference.field_lines(f)
