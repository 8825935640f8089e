"""Queries for linking, versions, reconciliation and graphs (J*, W*, M*, U*, G*, A*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, linking, reconcile, versions
from .registry import query

ALIASES = [(1, r"the\s+and", "REGEX"), (2, "tion", "EXACT"), (1, "ing the", "EXACT"), (3, r"\b(?:une|des)\b", "REGEX"), (4, "ignored", "CELEX"), (5, "ung. D", "EXACT"), (6, "É", "EXACT"), (7, r"ü\w", "REGEX")]
#: The aliases for a database whose \b and \s are ASCII alone: words of any script have edges, with marks as part of the letter before, as in Java.
EDGE, END = r"(?:^|[^\p{L}\p{Nd}\p{Mn}_]|(?:^|[^\p{L}\p{Nd}\p{Mn}])\p{Mn}+)", r"(?:$|[^\p{L}\p{Nd}\p{Mn}_])"
RE2 = [r"the[\t\n\v\f\r ]+and", "t[iİı]on", "[iİı]ng the", f"{EDGE}(?:une|des){END}", None, "ung[.] D", "[Éé]", r"[Üü]\w"]
HITS = " UNION ALL ".join(f"SELECT doc_id, {e} AS entity_id, {k} AS ord FROM documents WHERE regexp_matches(text, '{RE2[k]}', 'i')" for k, (e, _, kind) in enumerate(ALIASES) if kind != "CELEX")


@query("J2_alias_links", f"SELECT DISTINCT doc_id, entity_id, 'REGEX_ALIAS' AS method, 1.0::DOUBLE AS confidence FROM ({HITS})")
def alias_links(t):
    return linking.link_aliases(t.documents, ALIASES).select("doc_id", "entity_id", "method", "confidence")


@query("J2_alias_table", f"SELECT DISTINCT doc_id, entity_id FROM ({HITS})")
def alias_table(t):
    rows = [(k, *a) for k, a in enumerate(ALIASES)]
    return linking.link_alias_table(t.documents, t.spark.createDataFrame(rows, "ord int, entity_id long, pattern string, kind string")).select("doc_id", "entity_id")


SLICE = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id) AS rn FROM documents),
  h AS (SELECT doc_id, count(DISTINCT entity_id) AS n_links FROM ({HITS}) GROUP BY 1)
  SELECT n.doc_id, h.n_links, CASE WHEN contains(lower(text), 'amend') OR h.n_links > 2 THEN 'MATERIAL' ELSE 'INFORMATIONAL' END AS severity FROM n JOIN h USING (doc_id) WHERE rn = 1"""


@query("J2_link_and_rank", SLICE)
def link_and_rank(t):
    """New documents, the entities they mention, and how severe they are."""
    new = versions.first_wins(t.documents.withColumn("h", T.content_hash(F.col("text"))), ["h"], ["doc_id"])
    n = linking.link_aliases(new, ALIASES).groupBy("doc_id").agg(F.countDistinct("entity_id").alias("n_links"))
    j = new.select("doc_id", "text").join(n, "doc_id")
    s = T.severity(F.col("text"), F.lit(False), F.col("n_links") > 2)
    out = j.select("doc_id", "n_links", s.alias("severity"))
    return out.withColumn("severity", F.when(F.col("severity") == "CRITICAL", "MATERIAL").otherwise(F.col("severity"))).orderBy(T.severity_rank(F.col("severity")), "doc_id")


ID = "concat('3', CAST(1000 + CAST(floor({0} / 10000) AS INT) AS VARCHAR(9)), 'R', lpad(CAST({0} % 10000 AS VARCHAR(9)), 4, '0'))"
ID_DOCS = f"SELECT o_orderkey AS doc_id, concat('see ', {ID.format('(o_custkey * 3 % 2500)')}, ' and (', {ID.format('(o_orderkey % 3000)')}, '). X', {ID.format('o_custkey')}, ' near ', replace({ID.format('(o_orderkey % 2000 + 1)')}, 'R', 'PC'), ' or ', {ID.format('(o_orderkey % 2000 + 1)')}, '9') AS text FROM {{orders}}"
ID_CATALOG = f"SELECT p_partkey AS entity_id, {ID.format('p_partkey')} AS celex_id, concat('http://data.europa.eu/eli/reg/', CAST(p_partkey AS VARCHAR(9)), '/oj') AS eli_uri FROM {{part}}"


@query("J3_identifier_links", "SELECT DISTINCT o_orderkey AS doc_id, p_partkey AS entity_id FROM orders JOIN part ON p_partkey = o_custkey * 3 % 2500 OR p_partkey = o_orderkey % 3000")
def id_links(t):
    return linking.link_ids(t.rows(ID_DOCS), t.rows(ID_CATALOG), T.CELEX, "celex_id", "CELEX_ID").select("doc_id", "entity_id")


@query("J4_uri_links", "SELECT o_orderkey AS doc_id, p_partkey AS entity_id, 'ELI_URI' AS method FROM orders JOIN part ON p_partkey = o_orderkey % 3000")
def uri_links(t):
    d = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("at (http://data.europa.eu/eli/reg/"), (F.col("o_orderkey") % 3000).cast("string"), F.lit("/oj).")).alias("text"))
    return linking.link_ids(d, t.rows(ID_CATALOG), T.ELI, "eli_uri", "ELI_URI", trim=".,;)").select("doc_id", "entity_id", "method")


@query(
    "J5_combined_links",
    f"WITH r AS (SELECT DISTINCT doc_id, entity_id FROM ({HITS}) WHERE entity_id <> 2) SELECT doc_id, entity_id, 1.0::DOUBLE AS confidence FROM r UNION ALL SELECT doc_id, doc_id % 7, 0.8::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)",
)
def combined(t):
    rules = linking.link_aliases(t.documents, [a for a in ALIASES if a[0] != 2]).select("doc_id", "entity_id", "confidence")

    def extract(rest):
        return rest.select("doc_id", F.explode(F.array(F.struct((F.col("doc_id") % 7).alias("entity_id"), F.lit(0).alias("pos")), F.struct((F.col("doc_id") % 7).alias("entity_id"), F.lit(1).alias("pos")))).alias("x")).select("doc_id", "x.entity_id", "x.pos")

    return linking.combine(rules, t.documents, extract)


@query("J1_applies_to", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey IN (1, 2))")
def applies_to(t):
    from ..operators import views

    bridge = t.nation.select(F.col("n_nationkey").alias("entity_id"), F.when(F.col("n_regionkey") == 1, "AIFM").when(F.col("n_regionkey") == 2, "BOTH").otherwise("OTHER").alias("kind"))
    return views.applies_to(t.supplier.withColumn("entity_id", F.col("s_nationkey")), bridge.unionByName(bridge), "AIFM").select("s_suppkey")


@query(
    "J12_resolve_references",
    """SELECT ref, CASE WHEN k % 3 = 0 THEN p WHEN k % 3 = 1 AND n = 1 THEN p END AS entity_id FROM (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'EBA 1/' || p_partkey WHEN p_partkey % 3 = 1 THEN 'Circular  eba 1-' || (p_partkey - p_partkey % 2) ELSE 'none ' || p_partkey END AS ref,
    p_partkey % 3 AS k, CASE WHEN p_partkey % 3 = 1 THEN p_partkey - p_partkey % 2 ELSE p_partkey END AS p, CASE WHEN (p_partkey - p_partkey % 2) % 4 = 0 THEN 2 ELSE 1 END AS n FROM part)""",
)
def resolve(t):
    p = F.col("p_partkey").cast("string")
    even = (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string")
    refs = t.part.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("EBA 1/"), p)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Circular  eba 1-"), even)).otherwise(F.concat(F.lit("none "), p)).alias("ref"))
    one = t.part.select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("EBA 1/"), p).alias("reference"), F.lit(None).cast("string").alias("celex_id"))
    twin = t.part.where("p_partkey % 4 = 0").select((F.col("p_partkey") + 10**9).alias("entity_id"), F.concat(F.lit("eba  1/"), p).alias("reference"), F.lit(None).cast("string").alias("celex_id"))
    return linking.resolve_references(refs, one.unionByName(twin))


@query("J15_match_labels", "SELECT p_partkey, list_sort(list_distinct(list(slug))) AS slugs FROM part JOIN (SELECT 'ring' AS p, 'RING' AS slug UNION ALL SELECT 'red', 'RED' UNION ALL SELECT 'RED W', 'RED' UNION ALL SELECT 'small', 'SMALL') ON contains(lower(p_name), lower(p)) GROUP BY 1")
def labels(t):
    patterns = t.spark.createDataFrame([("ring", "RING"), ("red", "RED"), ("RED W", "RED"), ("small", "SMALL")], "pattern string, slug string")
    return linking.match_labels(t.part, patterns, "p_partkey", "p_name")


CHAIN = "SELECT source AS entity, doc_id, md5(text) AS content_hash FROM {documents}"


@query(
    "W3_W4_version_chain",
    "WITH c AS (SELECT entity, doc_id, content_hash, lag(content_hash) OVER (PARTITION BY entity ORDER BY doc_id) AS before FROM $chain) SELECT entity, doc_id, CAST(row_number() OVER w AS INT) AS version_number, lead(doc_id) OVER w IS NULL AS is_current FROM c WHERE before IS NULL OR before <> content_hash WINDOW w AS (PARTITION BY entity ORDER BY doc_id)",
    chain=CHAIN,
)
def chain(t):
    return versions.version_chain(t.rows(CHAIN), "entity", ["doc_id"]).select("entity", "doc_id", "version_number", "is_current")


@query("W3_continued_chain", "WITH c AS (SELECT entity, doc_id, content_hash, lag(content_hash) OVER (PARTITION BY entity ORDER BY doc_id) AS before FROM $chain), v AS (SELECT entity, doc_id, CAST(row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS INT) AS version_number FROM c WHERE before IS NULL OR before <> content_hash) SELECT entity, doc_id, version_number FROM v WHERE doc_id > (SELECT max(doc_id) // 2 FROM documents)", chain=CHAIN)
def continued(t):
    """All documents above half of the greatest doc_id, as continuations of the chains of all others."""
    rows = t.rows(CHAIN)
    half = (rows.agg(F.max("doc_id")).first()[0] or 0) // 2
    old = versions.version_chain(rows.where(F.col("doc_id") <= half), "entity", ["doc_id"])
    last = old.where("is_current").select("entity", "version_number", "content_hash")
    return versions.version_chain(rows.where(F.col("doc_id") > half), "entity", ["doc_id"], last=last).select("entity", "doc_id", "version_number")


@query("W1_W2_first_wins", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def first_wins(t):
    d = t.documents.withColumn("h", F.sha2("text", 256))
    n = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return versions.first_wins(d, ["h"], ["doc_id"]).join(n, "h").select("doc_id", "n")


NEW = "SELECT h AS content_hash, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS h FROM documents) WHERE doc_id % 2 = 1 AND h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1"


@query("M2_new_events", NEW)
def new_events(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return versions.new_events(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), ["doc_id"]).select("content_hash", "doc_id")


@query("M2_event_links", f"SELECT n.doc_id, h.entity_id FROM ({NEW}) n JOIN (SELECT DISTINCT doc_id, entity_id FROM ({HITS})) h USING (doc_id)")
def event_links(t):
    d = t.documents.withColumn("content_hash", F.sha2("text", 256))
    new = versions.new_events(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), ["doc_id"])
    refs = linking.link_aliases(new, ALIASES).groupBy("doc_id").agg(F.collect_list(F.struct("entity_id", "method")).alias("references"))
    return refs.select("doc_id", F.explode("references").alias("r")).select("doc_id", "r.entity_id")


@query(
    "M3_M4_unseen_versions",
    """WITH o AS (SELECT DISTINCT source AS entity, md5(text) AS h FROM documents WHERE doc_id % 3 = 0), c AS (SELECT source AS entity, md5(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 > 0 GROUP BY 1, 2),
    b AS (SELECT entity, count(*) AS n FROM o GROUP BY 1) SELECT entity, doc_id, CAST(n + row_number() OVER (PARTITION BY entity ORDER BY doc_id) AS INT) AS version_number FROM c JOIN b USING (entity) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.entity = c.entity AND o.h = c.h)""",
)
def unseen(t):
    rows = t.rows(CHAIN)
    old = versions.first_wins(rows.where("doc_id % 3 = 0"), ["entity", "content_hash"], ["doc_id"])
    old = old.withColumn("version_number", F.row_number().over(Window.partitionBy("entity").orderBy("doc_id"))).withColumn("is_current", F.lit(True))
    new = versions.unseen_versions(rows.where("doc_id % 3 > 0"), old, "entity", ["doc_id"])
    assert set(versions.appended(old, new, "entity").columns) == set(old.columns)
    return new.select("entity", "doc_id", "version_number")


@query(
    "W5_F19_diff_counts",
    """WITH v AS (SELECT source, doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(string_split(coalesce(before, ''), chr(10)), x)))) AS INT) AS added,
    CAST(len(list_distinct(list_filter(string_split(coalesce(before, ''), chr(10)), lambda x: NOT list_contains(string_split(text, chr(10)), x)))) AS INT) AS removed FROM v""",
)
def diff_counts(t):
    before = F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    v = t.documents.withColumn("before", before)
    added, removed = versions.changed_lines(F.col("before"), F.col("text"))
    return v.select("doc_id", added.alias("added"), removed.alias("removed"))


@query("F19_unified_diff")
def unified(t):
    v = versions.version_chain(t.documents.select(F.col("source").alias("entity"), "doc_id", "text", F.md5("text").alias("content_hash")), "entity", ["doc_id"])
    return versions.with_diff(v, "entity").select("entity", "version_number", "diff")


@query("J11_compare_versions", "SELECT source AS entity, count(*) FILTER (WHERE n = 2) > 0 AS has_two FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY 1")
def compare(t):
    v = t.documents.select(F.col("source").alias("entity"), "text", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("version_number"))
    return versions.compare_versions(v, "entity", 1, 2).select("entity", F.col("diff").isNotNull().alias("has_two"))


UPSERT = "SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.k IS NULL THEN o.flag WHEN o.k IS NOT NULL AND o.source <> 'SEED' THEN o.flag ELSE n.flag END AS flag FROM (SELECT p_partkey AS k, p_name AS title, p_size > 20 AS flag, CASE WHEN p_partkey % 5 = 0 THEN 'SEED' ELSE 'WEB' END AS source FROM part WHERE p_partkey % 3 > 0) o FULL JOIN (SELECT p_partkey AS k, p_brand AS title, p_size > 30 AS flag FROM part WHERE p_partkey % 2 = 0) n ON o.k = n.k"


@query("M1_upsert", UPSERT)
def upsert(t):
    p = t.part
    old = p.where("p_partkey % 3 > 0").selectExpr("p_partkey AS k", "p_name AS title", "p_size > 20 AS flag", "CASE WHEN p_partkey % 5 = 0 THEN 'SEED' ELSE 'WEB' END AS source")
    new = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS k", "p_brand AS title", "p_size > 30 AS flag", "'WEB' AS source")
    return versions.upsert(old, new, "k", protect=["flag"]).select("k", "title", "flag")


@query("M1_replace_children", "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 2 > 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def children(t):
    new = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return versions.replace_children(t.lineitem.select("l_orderkey"), new, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("M8_provenance", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(event_id, (ts, event_id)) AS first_run, arg_max(event_id, (ts, event_id)) AS last_run FROM events GROUP BY 1, 2")
def provenance(t):
    e = t.events.select("user_id", "event_type", F.col("ts").alias("at"), F.col("event_id").alias("run"))
    return versions.provenance(e.where("run % 3 = 0"), e.where("run % 3 > 0"), ["user_id", "event_type"])


@query("M21_evolve", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS brand, 0 AS level FROM part")
def evolve(t):
    old, new = t.part.where("p_partkey % 2 = 1").select("p_partkey"), t.part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_brand").alias("brand"))
    return versions.evolve(old.unionByName(new, allowMissingColumns=True), {"brand": "none", "level": 0})


# Snapshots: documents of the first half are the catalog, labels the crawl.
LISTING = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS reference, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 11 = 0 THEN 404 WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 500 ELSE 200 END AS status, CASE WHEN o_orderkey % 7 = 0 THEN array('A', 'B') ELSE array('A') END AS amended_by FROM {orders} WHERE o_orderkey % 3 > 0"
CATALOG = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS reference, o_orderpriority AS title, CASE WHEN o_orderkey % 19 = 0 THEN 'REPEALED' ELSE 'IN_FORCE' END AS stage, array('A') AS amended_by, CASE WHEN o_orderkey % 4 = 0 THEN 'SEED' ELSE 'WEB' END AS source, o_orderkey AS entity_id FROM {orders} WHERE o_orderkey % 2 = 0"
EXCLUDED = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS reference FROM {orders} WHERE o_orderkey % 23 = 0"


@query(
    "J9_J10_U2_reconcile",
    """SELECT CAST(k AS VARCHAR) AS reference, CASE WHEN k % 11 = 0 AND k % 2 = 0 THEN 'WITHDRAWN' WHEN k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 THEN 'FAILED' WHEN k % 2 = 1 THEN 'NEW' WHEN k % 7 = 0 THEN 'AMENDED' WHEN k % 5 = 0 OR k % 19 = 0 THEN 'UPDATED_METADATA' ELSE 'UNCHANGED' END AS outcome,
    coalesce(k % 2 = 0 AND k % 19 = 0 AND k % 11 > 0 AND k % 13 > 0 AND k % 17 > 0, false) AS reactivated FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 23 > 0)""",
)
def reconciled(t):
    r = reconcile.reconcile(t.rows(LISTING), t.rows(CATALOG), t.rows(EXCLUDED))
    return r.select("reference", "outcome", F.coalesce("reactivated", F.lit(False)).alias("reactivated"))


@query("J7_J8_retire", "SELECT CAST(o_orderkey AS VARCHAR) AS reference FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 4 > 0 AND o_orderkey % 19 > 0 AND o_orderkey % 3 = 0 AND o_orderkey % 23 > 0")
def retire(t):
    return reconcile.retire(t.rows(CATALOG), t.rows(LISTING), t.rows(EXCLUDED))


@query("J7_retired_catalog", "SELECT CASE WHEN o_orderkey % 19 = 0 OR (o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 AND o_orderkey % 23 > 0) THEN 'REPEALED' ELSE 'IN_FORCE' END AS stage, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def retired(t):
    c = t.rows(CATALOG)
    return reconcile.retired(c, reconcile.retire(c, t.rows(LISTING), t.rows(EXCLUDED))).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


ITEMS = "SELECT user_id AS run_id, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'NEW' WHEN 1 THEN 'AMENDED' WHEN 2 THEN CASE WHEN user_id % 3 = 0 THEN 'FAILED' ELSE 'UNCHANGED' END WHEN 3 THEN CASE WHEN user_id % 10 = 1 THEN 'ERROR' ELSE 'WITHDRAWN' END WHEN 4 THEN 'UPDATED_METADATA' ELSE 'UNCHANGED' END AS outcome, event_type AS entity_type, CASE WHEN event_id % 4 > 0 THEN substring(props, 1, 4) END AS content_type FROM {events}"


@query(
    "A4_A5_run_status",
    """SELECT *, status = 'SUCCESS' AND NOT (n_new + n_amended + n_updated + n_unchanged < 60) AND run_id % 7 > 0 AS may_retire FROM (SELECT run_id, n_new, n_amended, n_updated, n_unchanged, n_withdrawn, n_failed, n_error, CASE WHEN n_error > 0 AND ok > 0 THEN 'PARTIAL' WHEN n_error > 0 THEN 'FAILED' WHEN n_failed > 0 AND ok = 0 THEN 'FAILED' WHEN n_failed > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status
    FROM (SELECT *, n_new + n_amended + n_updated + n_unchanged AS ok FROM (SELECT run_id, count(*) FILTER (outcome = 'NEW') AS n_new, count(*) FILTER (outcome = 'AMENDED') AS n_amended, count(*) FILTER (outcome = 'UPDATED_METADATA') AS n_updated, count(*) FILTER (outcome = 'UNCHANGED') AS n_unchanged, count(*) FILTER (outcome = 'WITHDRAWN') AS n_withdrawn, count(*) FILTER (outcome = 'FAILED') AS n_failed, count(*) FILTER (outcome = 'ERROR') AS n_error FROM $items GROUP BY 1)))""",
    items=ITEMS,
)
def run_status(t):
    r = reconcile.run_status(t.rows(ITEMS)).withColumns({"dry_run": F.col("run_id") % 7 == 0, "restricted": F.lit(False)})
    return reconcile.retire_gate(r, 60).drop("note", "dry_run", "restricted")


@query("A6_cells", "SELECT entity_type, coalesce(content_type, '') AS content_type, count(*) FILTER (outcome = 'NEW') AS new, count(*) FILTER (outcome = 'AMENDED') AS amended, count(*) FILTER (outcome = 'UPDATED_METADATA') AS updated_metadata, count(*) FILTER (outcome = 'UNCHANGED') AS unchanged, count(*) FILTER (outcome = 'FAILED') AS failed FROM $items GROUP BY 1, 2", items=ITEMS)
def cells(t):
    return reconcile.cells(t.rows(ITEMS))


@query("W14_until_known", "SELECT source, count(*) AS n FROM documents d WHERE doc_id > (SELECT max(doc_id) FROM documents k WHERE k.source = d.source AND k.doc_id % 9 = 0) GROUP BY 1")
def until_known(t):
    r = t.documents.withColumn("known", F.col("doc_id") % 9 == 0)
    return reconcile.until_known(r, "source", [F.desc("doc_id")]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("J17_crawl_matrix", "SELECT n_name, t.kind FROM nation CROSS JOIN (SELECT unnest(['circular', 'regulation', 'law']) AS kind) t WHERE n_regionkey > 0")
def matrix(t):
    kinds = t.spark.createDataFrame([("circular",), ("regulation",), ("law",)], "kind string")
    return t.nation.where("n_regionkey > 0").select("n_name").crossJoin(F.broadcast(kinds))


REFS = "SELECT CAST(p_partkey AS VARCHAR(9)) AS reference, array(CAST(p_partkey + 7 AS VARCHAR(9)), CAST(p_partkey AS VARCHAR(9))) AS amended_by, CASE WHEN p_partkey % 3 = 0 THEN array(CAST(p_partkey * 2 AS VARCHAR(9))) ELSE array('') END AS amends, array(CAST(p_partkey + 1 AS VARCHAR(9))) AS supersedes FROM {part}"


@query("U4_stubs", "WITH m AS (SELECT max(p_partkey) AS m FROM part) SELECT DISTINCT CAST(k AS VARCHAR) AS reference FROM (SELECT p_partkey + 7 AS k FROM part UNION ALL SELECT p_partkey * 2 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + 1 FROM part), m WHERE k > m")
def stubs(t):
    return reconcile.stubs(t.rows(REFS), t.part.select(F.col("p_partkey").cast("string").alias("reference")))


@query("U6_J19_edges", "WITH m AS (SELECT max(p_partkey) AS m FROM part), e AS (SELECT p_partkey + 7 AS src, p_partkey AS dst, 'AMENDS' AS relation FROM part UNION SELECT p_partkey, p_partkey * 2, 'AMENDS' FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey, p_partkey + 1, 'REPEALS' FROM part) SELECT src, dst, relation FROM e, m WHERE src <= m AND dst <= m AND src <> dst AND NOT (src % 5 = 0 AND relation = 'REPEALS')")
def edges(t):
    c = t.part.select(F.col("p_partkey").cast("string").alias("reference"), F.col("p_partkey").alias("entity_id"))
    known = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit("REPEALS").alias("relation"))
    return reconcile.edges(t.rows(REFS), c, known)


@query("J19_neighbours", "WITH e AS (SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst, CASE WHEN p_partkey % 4 = 0 THEN 'REPEALS' ELSE 'AMENDS' END AS relation FROM part WHERE p_partkey > 0), n AS (SELECT src AS node, relation, dst AS other FROM e UNION ALL SELECT dst, 'BY', src FROM e WHERE relation = 'AMENDS') SELECT node, coalesce(list_sort(list_distinct(list(other) FILTER (relation = 'BY'))), []) AS amended_by, coalesce(list_sort(list_distinct(list(other) FILTER (relation = 'AMENDS'))), []) AS amends, coalesce(list_sort(list_distinct(list(other) FILTER (relation = 'REPEALS'))), []) AS repeals FROM n GROUP BY 1")
def neighbours(t):
    return graph.neighbours(_edges(t))


def _edges(t):
    return t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).cast("long").alias("dst"), F.when(F.col("p_partkey") % 4 == 0, "REPEALS").otherwise("AMENDS").alias("relation"), F.col("p_partkey").alias("link_id"))


WALK = "WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 AND p_partkey % 4 > 0 AND floor(p_partkey / 3) % 10 <> 9 THEN CAST(floor(p_partkey / 3) AS BIGINT) END AS parent FROM part), w AS (SELECT node, node AS here FROM p UNION ALL SELECT w.node, p.parent FROM w JOIN p ON p.node = w.here WHERE p.parent IS NOT NULL), top AS (SELECT node, min(here) AS top FROM w GROUP BY 1)"


def _tops(t):
    nodes = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 10 == 9).alias("repealed"))
    return graph.effective_parents(nodes, graph.first_parents(_edges(t), nodes))


@query("G1_G2_effective_parents", WALK + " SELECT node, top FROM top")
def tops(t):
    return _tops(t)


@query("A9_children", WALK + " SELECT top, count(*) AS n, list_sort(list(node)) AS members FROM top WHERE node <> top GROUP BY 1")
def below(t):
    return graph.children(_tops(t))


@query("J21_direct_parent", "SELECT p_partkey AS node, CAST(floor(p_partkey / 3) AS BIGINT) AS parent, floor(p_partkey / 3) % 10 = 9 AS repealed FROM part WHERE p_partkey > 0 AND p_partkey % 4 > 0")
def direct_parent(t):
    first = _edges(t).where("relation = 'AMENDS'").groupBy(F.col("src").alias("node")).agg(F.min_by("dst", "link_id").alias("parent"))
    nodes = t.part.select(F.col("p_partkey").alias("parent"), (F.col("p_partkey") % 10 == 9).alias("repealed"))
    return first.join(nodes, "parent").select("node", "parent", "repealed")


@query("U3_missing_references", "SELECT DISTINCT o_custkey + 500 AS k FROM orders WHERE o_custkey + 500 NOT IN (SELECT c_custkey FROM customer)")
def missing(t):
    return t.orders.select((F.col("o_custkey") + 500).alias("k")).distinct().join(t.customer.select(F.col("c_custkey").alias("k")), "k", "left_anti")
