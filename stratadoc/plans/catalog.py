"""Registered queries over the driver tables, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratadoc.functions.tables import stage
from stratadoc.operators import graph, lint, packet, reconcile, reports, retrieval, state
from stratadoc.plans import vault as V
from stratadoc.sources.files import DOMAIN_COLORS
from stratadoc.streaming.activity import sessions

FLAGSHIP = "ingest_packet"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Shared parts of the oracles.
INVENTORY = "inv AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, text, sha256(text) AS sha256, length(text) AS length FROM documents)"
MANIFEST = INVENTORY + """, man AS (
  SELECT CASE WHEN doc_id % 13 = 0 THEN 'old/' || doc_id || '.md' ELSE path END AS old_path,
         CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256 END AS old_sha256 FROM inv WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'gone/' || doc_id, sha256('gone' || doc_id) FROM inv WHERE doc_id % 17 = 0)"""
DELTA = MANIFEST + """, j AS (SELECT path, sha256, old_path, old_sha256 FROM inv FULL JOIN man ON path = old_path),
  n AS (SELECT path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS r FROM j WHERE old_path IS NULL),
  g AS (SELECT old_path, old_sha256, row_number() OVER (PARTITION BY old_sha256 ORDER BY old_path) AS r FROM j WHERE path IS NULL),
  delta AS (
    SELECT path, sha256, old_path, old_sha256, CASE WHEN sha256 = old_sha256 THEN 'unchanged' ELSE 'changed' END AS change_type FROM j WHERE path IS NOT NULL AND old_path IS NOT NULL
    UNION ALL SELECT path, sha256, old_path, old_sha256, CASE WHEN path IS NULL THEN 'deleted' WHEN old_path IS NULL THEN 'new' ELSE 'moved' END
    FROM n FULL JOIN g ON sha256 = old_sha256 AND n.r = g.r)"""
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
DIM = "cast('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64"


def fused(left: str, right: str, l_id: str, r_id: str) -> str:
    """``cand``: the best right rows of each left row, by the terms that both have and by their hashed vectors."""
    tokens = TOKENS.format("text")
    vector = lambda key, of: f"(SELECT {key}, {DIM} AS dim, count(*)::DOUBLE AS w FROM (SELECT {key}, unnest({tokens}) AS term FROM {of}) GROUP BY ALL)"
    return f"""pt AS (SELECT {r_id}, unnest(list_distinct({tokens})) AS term FROM {right}),
  pdf AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
  st AS (SELECT {l_id}, unnest(list_distinct({tokens})) AS term FROM {left}),
  sc AS (SELECT {l_id}, {r_id}, round(sum(ln(1 + (SELECT count(*) FROM {right})::DOUBLE / df)), 4) AS score FROM st JOIN pt USING (term) JOIN pdf USING (term) GROUP BY ALL),
  lv AS {vector(l_id, left)}, ln_ AS (SELECT {l_id}, sqrt(sum(w * w)) AS l_norm FROM lv GROUP BY ALL),
  rv AS {vector(r_id, right)}, rn_ AS (SELECT {r_id}, sqrt(sum(w * w)) AS r_norm FROM rv GROUP BY ALL),
  dots AS (SELECT {l_id}, {r_id}, sum(lv.w * rv.w) AS dot FROM lv JOIN rv USING (dim) GROUP BY ALL),
  cs AS (SELECT {l_id}, {r_id}, round(dot / l_norm / r_norm, 6) AS cosine FROM dots JOIN ln_ USING ({l_id}) JOIN rn_ USING ({r_id})),
  r1 AS (SELECT {l_id}, {r_id}, row_number() OVER (PARTITION BY {l_id} ORDER BY score DESC, {r_id}) AS r FROM sc QUALIFY r <= 50),
  r2 AS (SELECT {l_id}, {r_id}, row_number() OVER (PARTITION BY {l_id} ORDER BY cosine DESC, {r_id}) AS r FROM cs QUALIFY r <= 50),
  fu AS (SELECT {l_id}, {r_id}, round(coalesce(1 / (60.0 + r1.r)::DOUBLE, 0) + coalesce(1 / (60.0 + r2.r)::DOUBLE, 0), 8) AS fused FROM r1 FULL JOIN r2 USING ({l_id}, {r_id})),
  cand AS (SELECT {l_id}, {r_id}, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY {l_id} ORDER BY fused DESC, {r_id}) AS rank
           FROM fu LEFT JOIN sc USING ({l_id}, {r_id}) QUALIFY rank <= 5)"""


PACKET = DELTA + ", src AS (SELECT doc_id, text FROM inv WHERE path IN (SELECT path FROM delta WHERE change_type IN ('new', 'changed'))), " + fused("src", "benchmark", "doc_id", "item_id")
BESIDE = """pe AS (SELECT item_id AS src, item_id // 2 AS dst FROM benchmark), pb AS (SELECT src, dst FROM pe WHERE src <> dst UNION SELECT dst, src FROM pe WHERE src <> dst),
  beside AS (SELECT doc_id, dst AS item_id, arg_min(src, rank) AS via FROM cand JOIN pb ON src = item_id WHERE (doc_id, dst) NOT IN (SELECT (doc_id, item_id) FROM cand) GROUP BY doc_id, dst)"""


@query(f"WITH {INVENTORY} SELECT path, sha256, length FROM inv")
def source_hashes(spark, d):
    return V.inventory(spark, d)


@query(f"WITH {DELTA} SELECT * FROM delta")
def source_delta(spark, d):
    return V.delta(spark, d)


@query(f"WITH {DELTA} SELECT old_path, old_sha256 FROM delta WHERE change_type = 'deleted'")
def deleted_sources(spark, d):
    return V.delta(spark, d).filter("change_type = 'deleted'").select("old_path", "old_sha256")


@query(f"WITH {DELTA} SELECT old_path, path, sha256 FROM delta WHERE change_type = 'moved'")
def moved_sources(spark, d):
    return V.delta(spark, d).filter("change_type = 'moved'").select("old_path", "path", "sha256")


@query(f"WITH {DELTA} SELECT path, sha256 FROM delta WHERE change_type IN ('new', 'changed')")
def proceeding_sources(spark, d):
    return state.proceeding(V.delta(spark, d)).select("path", "sha256")


@query(f"""WITH {DELTA}, rev AS (SELECT * FROM delta WHERE change_type IN ('new', 'changed'))
SELECT old_path AS path, old_sha256 AS sha256 FROM man WHERE old_path NOT IN (SELECT old_path FROM rev WHERE old_path IS NOT NULL)
UNION ALL SELECT path, sha256 FROM rev""")
def accepted_manifest(spark, d):
    return state.accepted(V.manifest(spark, d), state.proceeding(V.delta(spark, d)))


@query("""SELECT o_custkey AS run_id, o_orderkey AS stage_no, o_orderstatus <> 'P' AS ok,
  coalesce(bool_and(o_orderstatus <> 'P') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS may_run FROM orders""")
def gate_status(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("stage_no"), (F.col("o_orderstatus") != "P").alias("ok"))
    return state.gates(o)


@query("""SELECT collection, count(*) AS n_items, sum(length(text))::BIGINT AS n_chars FROM (
  SELECT 'data' AS collection, text FROM documents UNION ALL SELECT 'level-knowledge', html FROM pages UNION ALL SELECT 'level-playbook', text FROM benchmark) GROUP BY ALL""")
def collection_status(spark, d):
    return retrieval.index_status(V.collections(spark, d))


@query(f"WITH {MANIFEST} SELECT path, sha256, length FROM inv WHERE NOT EXISTS (SELECT 1 FROM man WHERE old_path = path AND old_sha256 = sha256)")
def stale_index(spark, d):
    return retrieval.stale(V.inventory(spark, d), V.manifest(spark, d))


def bm25_sql(docs: str = "documents", x: str = "") -> str:
    """``s`` + x: (item_id, doc_id, score) of all texts of ``docs`` and questions of ``benchmark`` with a common term."""
    tokens = TOKENS.format("text")
    return f"""tf{x} AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens}) AS term FROM {docs}) GROUP BY ALL),
  dl{x} AS (SELECT doc_id, sum(tf) AS dl FROM tf{x} GROUP BY ALL), df{x} AS (SELECT term, count(*) AS df FROM tf{x} GROUP BY ALL),
  c{x} AS (SELECT count(*) AS n, (SELECT sum(dl)::DOUBLE FROM dl{x}) AS total FROM {docs}),
  q{x} AS (SELECT item_id, unnest(list_distinct({tokens})) AS term FROM benchmark),
  s{x} AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n))))), 4) AS score
        FROM q{x} JOIN tf{x} USING (term) JOIN df{x} USING (term) JOIN dl{x} USING (doc_id), c{x} GROUP BY ALL)"""


BM25 = bm25_sql()


@query(f"WITH {BM25} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5")
def bm25_search(spark, d):
    return V.search(spark, d, retrieval.bm25)


@query("""SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""")
def vector_search(spark, d):
    e = V.table(spark, d, "embeddings")
    return retrieval.nearest(e, e.filter("vec_id % 100 = 0"))


@query(f"""WITH {BM25}, h AS (SELECT doc_id, {DIM} AS dim, sum(tf)::DOUBLE AS w FROM tf GROUP BY ALL), hn AS (SELECT doc_id, sqrt(sum(w * w)) AS d_norm FROM h GROUP BY ALL),
  qt AS (SELECT item_id, {DIM} AS dim, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
  qn AS (SELECT item_id, sqrt(sum(w * w)) AS q_norm FROM qt GROUP BY ALL),
  dots AS (SELECT item_id, doc_id, sum(h.w * qt.w) AS dot FROM qt JOIN h USING (dim) GROUP BY ALL),
  cs AS (SELECT item_id, doc_id, round(dot / d_norm / q_norm, 6) AS cosine FROM dots JOIN hn USING (doc_id) JOIN qn USING (item_id)),
  r1 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 50),
  r2 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS r FROM cs QUALIFY r <= 50),
  u AS (SELECT item_id, doc_id, round(coalesce(1 / (60.0 + r1.r)::DOUBLE, 0) + coalesce(1 / (60.0 + r2.r)::DOUBLE, 0), 8) AS score FROM r1 FULL JOIN r2 USING (item_id, doc_id))
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM u QUALIFY rank <= 5""")
def hybrid_search(spark, d):
    return V.search(spark, d, retrieval.hybrid)


# Titles of pages as the catalog: each page has a confidence and claims a language.
TITLES = r"""titles AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS text, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)"""


@query(f"""WITH {TITLES}, {bm25_sql("titles", "_t")}, {BM25},
  t1 AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s_t QUALIFY rank <= 5),
  fl AS (SELECT item_id, bool_or(rank = 1 AND doc_id % 3 = 0) OR item_id % 7 = 0 OR min(lang) < max(lang) AS raw FROM t1 JOIN titles USING (doc_id) GROUP BY item_id),
  t2 AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE item_id NOT IN (SELECT item_id FROM fl WHERE NOT raw) QUALIFY rank <= 5)
SELECT *, 'catalog' AS tier FROM t1 UNION ALL SELECT *, 'raw' FROM t2""")
def question_evidence(spark, d):
    return V.answers(spark, d)


@query(f"WITH {PACKET}, {BESIDE} SELECT doc_id, item_id, score, rank, 'search' AS origin FROM cand UNION ALL SELECT doc_id, item_id, NULL, NULL, 'graph' FROM beside")
def ingest_packet(spark, d):
    return packet.with_graph(stage(V.candidates(spark, d), "packet"), V.page_edges(spark, d))


@query(f"""WITH {PACKET}, l AS (SELECT *, lead(score) OVER (PARTITION BY doc_id ORDER BY rank) AS next_score FROM cand),
  m AS (SELECT *, CASE WHEN score > 0 THEN round((score - next_score) / score, 6) ELSE 0.0 END AS margin FROM l WHERE rank = 1 AND next_score IS NOT NULL)
SELECT * FROM m WHERE margin < 0.05""")
def packet_ambiguities(spark, d):
    return packet.ambiguities(V.candidates(spark, d).drop("fused"))


@query(f"""WITH {PACKET}, best AS (SELECT doc_id, score FROM cand WHERE rank = 1)
SELECT src.doc_id, coalesce(score, 0.0) AS score, CASE WHEN score >= 60 THEN 'enrich' WHEN score > 10 THEN 'none' ELSE 'create' END AS action FROM src LEFT JOIN best USING (doc_id)""")
def page_actions(spark, d):
    return packet.page_action(V.delta_documents(spark, d).select("doc_id"), V.candidates(spark, d), 60.0, 10.0)


@query(f"""SELECT doc_id, lower(p_brand_word) AS tag, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents) t
JOIN (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS p_brand_word FROM benchmark) v ON term = lower(p_brand_word) GROUP BY ALL""")
def taxonomy_cues(spark, d):
    vocabulary = V.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("tag")).distinct()
    return packet.cues(V.table(spark, d, "documents"), vocabulary)


ROUTED = r"""r AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9a-f]{40}') THEN 'Assets' WHEN contains(text, '|') THEN 'Resources' WHEN contains(text, '@') THEN 'Meetings'
  WHEN contains(text, '!!') THEN 'Personal' WHEN contains(text, chr(10)) THEN 'Knowledge' END AS target FROM documents)"""


@query(f"WITH {ROUTED} SELECT doc_id, target FROM r WHERE target IS NOT NULL")
def inbox_routing(spark, d):
    return packet.routed(V.table(spark, d, "documents")).filter("target is not null").select("doc_id", "target")


@query(f"WITH {ROUTED} SELECT doc_id FROM r WHERE target IS NULL")
def blocked_items(spark, d):
    return packet.blocked(packet.routed(V.table(spark, d, "documents"))).select("doc_id")


@query(r"""SELECT doc_id, rule, n::BIGINT AS n FROM (
  SELECT doc_id, 'email' AS rule, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS n FROM documents
  UNION ALL SELECT doc_id, 'ipv4', len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) FROM documents
  UNION ALL SELECT doc_id, 'phone', len(regexp_extract_all(text, '\+[0-9][0-9() .-]{7,}[0-9]')) FROM documents
  UNION ALL SELECT doc_id, 'key', len(regexp_extract_all(text, '[0-9a-f]{32,}')) FROM documents) WHERE n > 0""")
def redaction_findings(spark, d):
    return packet.redactions(V.table(spark, d, "documents"))


@query(f"""WITH {INVENTORY}, b AS (SELECT path, doc_id, coalesce(right(text, 100), '') AS notes FROM inv)
SELECT path, sha256(notes) AS before, sha256(notes || '!') AS after FROM b WHERE doc_id % 23 = 0""")
def notes_protected(spark, d):
    before = V.table(spark, d, "documents").select(V.path().alias("path"), "doc_id", F.expr("right(text, 100)").alias("notes"))
    after = before.withColumn("notes", F.when(F.col("doc_id") % 23 == 0, F.concat("notes", F.lit("!"))).otherwise(F.col("notes")))
    return packet.touched_notes(before, after)


LINKS = r"""site AS (SELECT p.page_id, p.url, p.html || CASE WHEN q.url IS NULL THEN '' ELSE '<a href="' || q.url || '">' END AS html FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id // 2 AND p.page_id % 3 <> 0),
  l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM site),
  links AS (SELECT page_id, url, href, regexp_replace(CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END, '[#?].*$', '') AS target FROM l),
  addr AS (SELECT DISTINCT regexp_replace(url, '[#?].*$', '') AS target FROM pages)"""


@query(f"WITH {LINKS} SELECT page_id, url, href, target FROM links")
def page_links(spark, d):
    return V.links(spark, d)


@query(f"WITH {LINKS} SELECT page_id, url, href, target FROM links WHERE target NOT IN (SELECT target FROM addr)")
def broken_links(spark, d):
    return graph.broken(V.links(spark, d), V.table(spark, d, "pages"))


@query(f"WITH {LINKS} SELECT page_id, url FROM pages WHERE regexp_replace(url, '[#?].*$', '') NOT IN (SELECT target FROM links WHERE regexp_replace(url, '[#?].*$', '') <> target)")
def orphan_pages(spark, d):
    return graph.orphans(V.links(spark, d), V.table(spark, d, "pages"))


@query(r"SELECT substr(md5(name), 1, 16) AS entity_id, name, count(*) AS n_pages FROM (SELECT trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS name FROM pages) WHERE name <> '' GROUP BY ALL")
def entity_registry(spark, d):
    return graph.registry(V.table(spark, d, "pages"))


@query(f"""WITH {LINKS}, {INVENTORY} SELECT DISTINCT regexp_replace(url, '[#?].*$', '') AS src, target AS dst, 'link' AS edge_type FROM links
UNION SELECT regexp_replace(url, '[#?].*$', ''), path, 'reference' FROM pages JOIN inv ON doc_id = page_id""")
def dependency_edges(spark, d):
    paths = V.table(spark, d, "documents").select("doc_id", V.path().alias("path"))
    cited = V.table(spark, d, "pages").select("page_id", graph.address(F.col("url")).alias("page")).join(paths, F.col("doc_id") == F.col("page_id"))
    return graph.dependencies(V.links(spark, d), cited)


@query(rf"""WITH {LINKS}, e AS (SELECT DISTINCT regexp_replace(url, '[#?].*$', '') AS src, target AS dst FROM links)
SELECT 'duplicate_id' AS "check", (SELECT count(*) FROM (SELECT page_id FROM pages GROUP BY page_id HAVING count(*) > 1)) AS n
UNION ALL SELECT 'dangling_target', count(*) FROM e WHERE dst NOT IN (SELECT target FROM addr)
UNION ALL SELECT 'dangling_source', count(*) FROM e WHERE src NOT IN (SELECT target FROM addr)
UNION ALL SELECT 'missing_file', count(*) FROM addr WHERE target NOT IN (SELECT regexp_replace(url, '[#?].*$', '') FROM pages WHERE page_id % 10 <> 0)""")
def metadata_validation(spark, d):
    pages = V.table(spark, d, "pages")
    address = graph.address(F.col("url"))
    nodes = pages.select(address.alias("node")).distinct()
    files = pages.filter("page_id % 10 <> 0").select(address.alias("path"))
    return graph.validate(pages.select(F.col("page_id").alias("entity_id")), graph.dependencies(V.links(spark, d)), nodes, files)


@query(f"""WITH {LINKS}, e AS (SELECT DISTINCT regexp_replace(url, '[#?].*$', '') AS src, target AS dst FROM links),
  b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
  s AS (SELECT DISTINCT regexp_replace(url, '[#?].*$', '') AS node FROM pages WHERE page_id % 50 = 0),
  one AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM s)),
  two AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM one) AND dst NOT IN (SELECT node FROM s UNION SELECT node FROM one))
SELECT node, 0 AS hops FROM s UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""")
def impact_set(spark, d):
    seeds = V.table(spark, d, "pages").filter("page_id % 50 = 0").select(graph.address(F.col("url")).alias("node"))
    return graph.impact(graph.dependencies(V.links(spark, d)), seeds)


SIMILAR = f"""nd AS (SELECT min(doc_id) AS doc_id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)),
  tt AS (SELECT doc_id, unnest(list_distinct({TOKENS.format("text")})) AS term FROM nd),
  sz AS (SELECT doc_id, count(*) AS n FROM tt GROUP BY ALL),
  pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM tt x JOIN tt y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL),
  sim AS (SELECT a, b, round(shared::DOUBLE / (p.n + q.n - shared), 6) AS score FROM pr JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b),
  similar_pairs AS (SELECT a, b, score, CASE WHEN score >= 0.9 THEN 'confirmed' ELSE 'review' END AS status FROM sim WHERE score >= 0.7)"""
CLUSTERS = SIMILAR + """, lk AS (SELECT a, b FROM similar_pairs WHERE status = 'confirmed'
    UNION SELECT min(doc_id) OVER (PARTITION BY sha256(text)), doc_id FROM documents WHERE text IS NOT NULL QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY sha256(text))),
  ud AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
  reach AS (SELECT a AS node, a AS other FROM ud UNION SELECT node, ud.b FROM reach JOIN ud ON ud.a = other),
  clusters AS (SELECT node, min(other) AS label FROM reach GROUP BY node)"""


@query(f"WITH {SIMILAR} SELECT * FROM similar_pairs")
def similar_sources(spark, d):
    return V.similar(spark, d)


@query(f"""WITH {SIMILAR} SELECT a, b, score, status, x.source AS folder_a, y.source AS folder_b FROM similar_pairs
JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE status = 'confirmed' AND x.source <> y.source AND (a + b) % 3 <> 0""")
def hidden_links(spark, d):
    pairs = stage(V.similar(spark, d), "similar")
    explicit = pairs.filter("(a + b) % 3 = 0").select("a", "b")  # links that the documents are taken to have
    return graph.hidden(pairs, V.table(spark, d, "documents").select("doc_id", F.col("source").alias("folder")), explicit)


@query(f"WITH {SIMILAR} SELECT a, b, score FROM similar_pairs WHERE status = 'review'")
def uncertain_links(spark, d):
    return V.similar(spark, d).filter("status = 'review'").select("a", "b", "score")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT node, label FROM clusters")
def source_clusters(spark, d):
    return V.clusters(spark, d)


@query(f"""WITH RECURSIVE {CLUSTERS}, g AS (SELECT label, count(DISTINCT node) AS n_members, round(avg(quality), 6) AS mean_quality, round(sum(exp(-ln(2.0) * (node % 365) / 90)), 6) AS weight
  FROM clusters LEFT JOIN labels ON node = doc_id GROUP BY label)
SELECT *, CASE WHEN weight >= 1.5 THEN 'high' WHEN weight >= 0.75 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def cluster_confidence(spark, d):
    members = V.clusters(spark, d).join(V.table(spark, d, "labels").select(F.col("doc_id").alias("node"), "quality"), "node", "left")
    return graph.consolidated(members.withColumn("age_days", F.col("node") % 365))


@query(f"""WITH RECURSIVE {CLUSTERS}, m AS (SELECT label, d.source, l.quality, l.toxic FROM clusters JOIN documents d ON node = d.doc_id LEFT JOIN labels l ON node = l.doc_id),
  cl AS (SELECT label AS entity, a.attribute, a.value FROM m, LATERAL (SELECT 'quality' AS attribute, quality::VARCHAR AS value UNION ALL SELECT 'toxic', toxic::VARCHAR UNION ALL SELECT 'source', source) a WHERE a.value IS NOT NULL)
SELECT entity, attribute, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, ',' ORDER BY value) AS found FROM cl GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def contradictions(spark, d):
    """What the members of a cluster claim of themselves: a label, and the source that it is from."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("node"), "source")
    claims = V.clusters(spark, d).join(docs, "node").join(V.table(spark, d, "labels").withColumnRenamed("doc_id", "node"), "node", "left")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in ("quality", "toxic", "source")])).alias("c")
    return lint.contradictions(claims.select(F.col("label").alias("entity"), each).select("entity", "c.attribute", "c.value"))


WIKI = r"""wiki AS (SELECT page_id AS page, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  regexp_extract(html, '<meta name="author" content="([^"]*)"', 1) AS author, DATE '2024-12-31' - (page_id % 200)::INT AS updated, page_id % 200 AS age_days FROM pages)"""
ISSUES = f"""{LINKS}, {WIKI}, issues AS (
  SELECT DISTINCT 'broken_link' AS rule, 3 AS severity, page_id::VARCHAR AS page, href AS detail FROM links WHERE target NOT IN (SELECT target FROM addr)
  UNION ALL SELECT 'orphan', 1, page_id::VARCHAR, url FROM pages WHERE regexp_replace(url, '[#?].*$', '') NOT IN (SELECT target FROM links WHERE regexp_replace(url, '[#?].*$', '') <> target)
  UNION ALL SELECT 'missing_metadata', 2, page::VARCHAR, k FROM (SELECT page, 'title' AS k, title AS v FROM wiki UNION ALL SELECT page, 'lang', lang FROM wiki UNION ALL SELECT page, 'author', author FROM wiki) WHERE v = ''
  UNION ALL SELECT 'stale', 1, page::VARCHAR, age_days::VARCHAR FROM wiki WHERE age_days > 90),
  plan AS (SELECT row_number() OVER (ORDER BY severity DESC, rule, page, detail) AS issue_no, * FROM issues)"""


@query(f"WITH {WIKI} SELECT page, updated, age_days FROM wiki WHERE age_days > 90")
def stale_pages(spark, d):
    return lint.stale(V.wiki(spark, d), V.AS_OF)


@query(f"WITH {WIKI} SELECT page, k AS missing FROM (SELECT page, 'title' AS k, title AS v FROM wiki UNION ALL SELECT page, 'lang', lang FROM wiki UNION ALL SELECT page, 'author', author FROM wiki) WHERE v = ''")
def missing_metadata(spark, d):
    return lint.missing_metadata(V.wiki(spark, d), ["title", "lang", "author"])


@query(f"WITH {ISSUES} SELECT rule, severity, count(*) AS n, count(DISTINCT page) AS n_pages FROM issues GROUP BY ALL")
def lint_summary(spark, d):
    return lint.summary(V.issues(spark, d))


@query(f"WITH {ISSUES} SELECT * FROM plan")
def numbered_plan(spark, d):
    return lint.plan(V.issues(spark, d))


@query(f"WITH {ISSUES} SELECT * FROM plan WHERE issue_no IN (1, 3, 5, 999999999)")
def selected_fixes(spark, d):
    return lint.selected(lint.plan(V.issues(spark, d)), [1, 3, 5, 999999999])


@query(f"""WITH {ISSUES}, prev AS (SELECT rule, page, detail FROM issues WHERE page::BIGINT % 3 <> 0 UNION ALL SELECT 'stale', (page::BIGINT + 1000000)::VARCHAR, detail FROM issues WHERE rule = 'stale' AND page::BIGINT % 7 = 0)
SELECT rule, page, detail, CASE WHEN p.page IS NULL THEN 'new' WHEN i.page IS NULL THEN 'resolved' ELSE 'open' END AS state FROM prev p FULL JOIN issues i USING (rule, page, detail)""")
def issue_lifecycle(spark, d):
    now = V.issues(spark, d)
    number = F.col("page").cast("long")
    solved = now.filter((F.col("rule") == "stale") & (number % 7 == 0)).withColumn("page", (number + 1000000).cast("string"))
    return lint.lifecycle(now.filter(number % 3 != 0).unionByName(solved), now)


@query(f"""WITH {DELTA}, ch AS (SELECT doc_id FROM inv WHERE path IN (SELECT path FROM delta WHERE change_type IN ('new', 'changed'))),
  o AS (SELECT doc_id, coalesce(quality, 1) AS cr, doc_id % 365 AS age FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM ch)
        ORDER BY cr, age DESC, cast('0x' || substr(md5(doc_id || '/2024-12-31'), 1, 8) AS BIGINT), doc_id LIMIT 10)
SELECT doc_id, 'risk' AS reason FROM o UNION ALL SELECT doc_id, 'changed' FROM ch""")
def risk_rotation(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels"), "doc_id", "left")
    docs = docs.select("doc_id", F.coalesce("quality", F.lit(1)).alias("confidence_rank"), (F.col("doc_id") % 365).alias("age_days"))
    return lint.rotation(docs, V.delta_documents(spark, d).select("doc_id"), f"/{V.AS_OF}")


COLORS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in DOMAIN_COLORS.items()) + ") AS t(domain, color)"


@query(f"""WITH w AS (SELECT 'path:' || domain AS q, color AS new_color FROM {COLORS}
    UNION ALL SELECT 'tag:#' || p_brand, '#' || substr(md5(p_brand), 1, 6) FROM (SELECT DISTINCT p_brand FROM part)),
  a AS (SELECT * FROM (SELECT 'path:' || domain AS query, CASE WHEN domain < 'd' THEN color ELSE '#000000' END AS old_color, 'domain' AS origin FROM {COLORS} WHERE domain <> 'tools')
    UNION ALL SELECT 'path:gone', '#111111', 'domain' UNION ALL SELECT 'file:mine', '#222222', 'manual')
SELECT coalesce(query, q) AS query, old_color, CASE WHEN old_color IS NOT NULL AND new_color IS NULL AND origin <> 'domain' THEN old_color ELSE new_color END AS new_color,
  CASE WHEN old_color IS NULL THEN 'add' WHEN new_color IS NULL AND origin = 'domain' THEN 'remove' WHEN new_color IS NULL OR old_color = new_color THEN 'keep' ELSE 'correct' END AS action
FROM a FULL JOIN w ON query = q""")
def color_reconcile(spark, d):
    domains = spark.createDataFrame(list(DOMAIN_COLORS.items()), "domain string, color string")
    brands = V.table(spark, d, "part").select("p_brand").distinct()
    tags = brands.select(F.col("p_brand").alias("tag"), F.concat(F.lit("#"), F.substring(F.md5("p_brand"), 1, 6)).alias("color"))
    drifted = F.when(F.col("domain") < "d", F.col("color")).otherwise("#000000")
    actual = domains.filter("domain <> 'tools'").select(F.concat(F.lit("path:"), "domain").alias("query"), drifted.alias("color"), F.lit("domain").alias("origin"))
    more = spark.createDataFrame([("path:gone", "#111111", "domain"), ("file:mine", "#222222", "manual")], "query string, color string, origin string")
    return reconcile.reconcile(actual.unionByName(more), reconcile.desired(tags, domains))


@query("""WITH t AS (SELECT p_partkey AS page, unnest(string_split(p_type, ' ')) AS tag FROM part)
SELECT tag, count(DISTINCT page) AS n_pages FROM t WHERE tag IN (SELECT unnest(string_split(p_type, ' ')) FROM part WHERE p_size > 3) AND tag NOT IN (SELECT tag FROM t WHERE tag < 'M') GROUP BY tag HAVING count(DISTINCT page) >= 3""")
def tag_audit(spark, d):
    part = V.table(spark, d, "part")
    tags = F.split("p_type", " ")
    vocabulary = part.filter("p_size > 3").select(F.explode(tags).alias("tag")).distinct()
    groups = part.select(F.explode(tags).alias("tag")).filter("tag < 'M'").distinct()
    return reconcile.audit_tags(part.select(F.col("p_partkey").alias("page"), tags.alias("tags")), vocabulary, groups)


@query("""SELECT o_orderkey AS task_id, o_orderdate::DATE AS due, o_orderpriority AS priority,
  CASE WHEN o_orderstatus = 'F' AND due < DATE '1998-01-01' AND due >= DATE '1997-12-25' THEN 'recently_completed' WHEN o_orderstatus <> 'F' AND due < DATE '1998-01-01' THEN 'overdue'
       WHEN o_orderstatus <> 'F' AND due = DATE '1998-01-01' THEN 'due_today' WHEN o_orderstatus <> 'F' AND due > DATE '1998-01-01' AND due <= DATE '1998-01-08' THEN 'upcoming' END AS bucket
FROM orders WHERE bucket IS NOT NULL""")
def task_briefing(spark, d):
    return reports.briefing(V.tasks(spark, d), V.TASKS_ON)


TODO = """WITH p AS (
    SELECT 'Order ' || o_custkey AS title, o_orderdate::DATE AS due, o_orderpriority AS priority, 'task' AS origin FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'ORDER  ' || o_custkey, NULL, '3-MEDIUM', 'action' FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'order ' || c_custkey, NULL, '5-LOW', 'carry' FROM customer WHERE c_acctbal < 0 AND c_custkey % 4 <> 0),
  q AS (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS norm, CASE WHEN due < DATE '{0}' THEN '1-overdue' WHEN priority[1] IN ('1', '2') THEN '2-high' WHEN due IS NULL THEN '4-carried' ELSE '3-normal' END AS l
        FROM p WHERE due IS NULL OR due < DATE '{1}')
SELECT norm, min(title) AS title, min(due) AS due, min(l) AS label, count(DISTINCT origin) AS n_origins FROM q GROUP BY norm"""


def _todo(spark, d, window):
    tasks = V.tasks(spark, d).filter("not done").select("title", "due", "priority", F.lit("task").alias("origin"))
    orders, customers = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    none = F.lit(None).cast("timestamp_ntz").alias("due")
    actions = orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("ORDER  "), F.col("o_custkey").cast("string")).alias("title"), none, F.lit("3-MEDIUM").alias("priority"), F.lit("action").alias("origin"))
    before = customers.filter("c_acctbal < 0").select(F.concat(F.lit("- [ ] order "), F.col("c_custkey").cast("string"), F.lit("\n- [x] done")).alias("text"))
    completed = customers.filter("c_custkey % 4 = 0").select(F.concat(F.lit("Order  "), F.col("c_custkey").cast("string")).alias("title"))
    carried = reports.carried_over(before, completed).select("title", none, F.lit("5-LOW").alias("priority"), F.lit("carry").alias("origin"))
    return reports.todo([tasks, actions, carried], *window)


@query(TODO.format("1998-01-01", "1998-01-02"))
def todo_daily(spark, d):
    return _todo(spark, d, reports.time_window("today", V.TASKS_ON))


@query(TODO.format("1997-12-29", "1998-01-05"))
def todo_weekly(spark, d):
    return _todo(spark, d, reports.time_window("this week", V.TASKS_ON))


@query("SELECT ts::DATE AS day, event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
def activity_daily(spark, d):
    return reports.activity(V.table(spark, d, "events"), F.to_date("ts"), "event_type", "user_id")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, coalesce(text, '')) AS transcript FROM conversations GROUP BY conv_id")
def session_transcripts(spark, d):
    return reports.transcripts(V.table(spark, d, "conversations"))


@query("""WITH c AS (SELECT date_trunc('week', ts)::DATE AS period, event_type AS kind, count(*) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY ALL)
SELECT *, n - lag(n) OVER (PARTITION BY kind ORDER BY period) AS delta FROM c""")
def insight_trends(spark, d):
    rows = reports.within(V.table(spark, d, "events"), "ts", reports.time_window("January 2024", V.AS_OF))
    return reports.trends(rows, F.to_date(F.date_trunc("week", "ts")), "event_type")


@query("""WITH c AS (SELECT ts::DATE AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL),
  s AS (SELECT *, avg(n) OVER w AS m, stddev_pop(n) OVER w AS sd, count(*) OVER w AS seen FROM c WINDOW w AS (PARTITION BY kind ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT day, kind, n, round((n - m) / sd, 6) AS z FROM s WHERE seen = 7 AND sd > 0 AND abs(round((n - m) / sd, 6)) >= 1.5""")
def signals(spark, d):
    return reports.signals(V.table(spark, d, "events"), F.to_date("ts"), "event_type")


@query("""WITH e AS (SELECT DISTINCT a.source, b.lang FROM documents a, (SELECT DISTINCT lang FROM documents) b), o AS (SELECT source, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL)
SELECT source, lang, coalesce(n, 0) AS n FROM e LEFT JOIN o USING (source, lang) WHERE coalesce(n, 0) < 5""")
def knowledge_gaps(spark, d):
    docs = V.table(spark, d, "documents")
    expected = docs.select("source").distinct().crossJoin(docs.select("lang").distinct())
    return reports.gaps(expected, docs.join(V.table(spark, d, "labels").filter("quality = 1"), "doc_id"), ["source", "lang"], 5)


OPINIONS = "o AS (SELECT doc_id, source AS subject, (quality - toxic)::DOUBLE AS value FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {OPINIONS}, s AS (SELECT subject, count(*) AS n, round(avg(value), 6) AS mean, round(count(*) / (count(*) + 10.0)::DOUBLE * (1 - stddev_pop(value) / 2), 6) AS confidence FROM o GROUP BY ALL)
SELECT *, CASE WHEN mean >= 0.7 THEN 'healthy' WHEN mean >= 0.5 THEN 'watch' ELSE 'at_risk' END AS label, CASE WHEN mean >= 0.7 THEN 'none' WHEN mean >= 0.5 THEN 'check in' ELSE 'escalate' END AS action FROM s""")
def sentiment_report(spark, d):
    return reports.sentiment(V.opinions(spark, d))


@query(f"WITH {OPINIONS} SELECT *, row_number() OVER (PARTITION BY subject ORDER BY abs(value) DESC, doc_id) AS rank FROM o QUALIFY rank <= 3")
def sentiment_evidence(spark, d):
    return reports.evidence(V.opinions(spark, d))


@query(f"""WITH {OPINIONS}, s AS (SELECT subject, round(avg(value) FILTER (doc_id % 365 < 180), 6) AS recent_mean, round(avg(value) FILTER (doc_id % 365 >= 180), 6) AS prior_mean FROM o GROUP BY ALL)
SELECT *, CASE WHEN recent_mean - prior_mean > 0.01 THEN 'up' WHEN recent_mean - prior_mean < -0.01 THEN 'down' WHEN recent_mean - prior_mean IS NOT NULL THEN 'flat' END AS trend FROM s""")
def sentiment_trend(spark, d):
    return reports.direction(V.opinions(spark, d), F.col("doc_id") % 365 < 180)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= '1997-12-22' AND o_orderdate < '1997-12-29' AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def win_report(spark, d):
    rows = reports.within(V.table(spark, d, "orders"), "o_orderdate", reports.time_window("last week", V.TASKS_ON))
    return reports.wins(rows.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("""SELECT l_suppkey AS subject, count(*) AS n, count(*) FILTER (delay > 0) AS n_late, round(count(*) FILTER (delay > 0) / count(*), 6) AS late_share, max(delay) AS worst_delay FROM (
  SELECT l_suppkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60 AS delay FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL HAVING count(*) FILTER (delay > 0) > 0""")
def critique_report(spark, d):
    promised = V.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(V.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return reports.critique(promised.select(F.col("l_suppkey").alias("subject"), (F.datediff("l_shipdate", "o_orderdate") - 60).alias("delay")))


@query("SELECT o_orderpriority AS kind, o_orderdate::DATE AS report_date, o_orderkey AS report_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1")
def latest_reports(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("report_date"), F.col("o_orderkey").alias("report_id"))
    return graph.newest(rows, "kind", "report_date", "report_id")


@query(f"""WITH {PACKET} SELECT 'blocked' AS "check", count(*) AS n, count(*) = 0 AS ok FROM documents WHERE NOT regexp_matches(text, '[0-9a-f]{{40}}') AND NOT contains(text, '|') AND NOT contains(text, '@') AND NOT contains(text, '!!') AND NOT contains(text, chr(10))
UNION ALL SELECT 'maintenance', count(*), count(*) = 0 FROM delta WHERE change_type IN ('moved', 'deleted')
UNION ALL SELECT 'empty', count(*), count(*) = 0 FROM inv WHERE coalesce(text, '') = '' UNION ALL SELECT 'repeated', count(*), count(*) = 0 FROM (SELECT path FROM inv GROUP BY path HAVING count(*) > 1)
UNION ALL SELECT 'stale_index', count(*), count(*) = 0 FROM inv WHERE NOT EXISTS (SELECT 1 FROM man WHERE old_path = path AND old_sha256 = sha256)""")
def preflight(spark, d):
    inv = V.inventory(spark, d)
    return packet.preflight({
        "blocked": packet.blocked(packet.routed(V.table(spark, d, "documents"))),
        "maintenance": V.delta(spark, d).filter("change_type in ('moved', 'deleted')"),
        "empty": inv.filter("length = 0"),
        "repeated": inv.groupBy("path").count().filter("count > 1"),
        "stale_index": retrieval.stale(inv, V.manifest(spark, d)),
    })


@query(f"""WITH {PACKET}, best AS (SELECT doc_id, score FROM cand WHERE rank = 1)
SELECT src.doc_id, coalesce(score, 0.0) AS score FROM src LEFT JOIN best USING (doc_id) WHERE coalesce(score, 0.0) <= 10""")
def packet_unmatched(spark, d):
    return packet.unmatched(V.delta_documents(spark, d).select("doc_id"), V.candidates(spark, d), 10.0)


@query(f"WITH {PACKET}, {BESIDE} SELECT * FROM beside")
def packet_neighbours(spark, d):
    return packet.neighbours(stage(V.candidates(spark, d), "packet"), V.page_edges(spark, d))


@query(f"""WITH {PACKET}, f AS (SELECT doc_id, item_id, rank, CASE item_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, doc_id % 7 = 0 AS needs_precision FROM cand),
  p AS (SELECT doc_id, bool_or(rank = 1 AND confidence = 'low') AS low, bool_or(needs_precision) AS imprecise FROM f GROUP BY ALL),
  c AS (SELECT doc_id, min(length(text) % 50) < max(length(text) % 50) AS contradicting FROM f JOIN benchmark USING (item_id) GROUP BY ALL)
SELECT doc_id, low, imprecise, coalesce(contradicting, false) AS contradicting, low OR imprecise OR coalesce(contradicting, false) AS raw FROM p LEFT JOIN c USING (doc_id)""")
def raw_fallback(spark, d):
    kind = F.when(F.col("item_id") % 3 == 0, "low").when(F.col("item_id") % 3 == 1, "medium").otherwise("high")
    found = stage(V.candidates(spark, d), "packet").select("doc_id", "item_id", "rank", kind.alias("confidence"), (F.col("doc_id") % 7 == 0).alias("needs_precision"))
    claims = V.table(spark, d, "benchmark").select("item_id", F.lit("length").alias("attribute"), (F.length("text") % 50).alias("value"))
    return retrieval.fallback(found, claims)


@query(f"""WITH {PACKET} SELECT DISTINCT item_id AS page, path, sha256 FROM cand JOIN inv USING (doc_id) WHERE item_id % 3 = 0""")
def reference_evidence(spark, d):
    pages = V.table(spark, d, "benchmark").select(F.col("item_id").alias("page"), F.when(F.col("item_id") % 3 == 0, "low").otherwise("high").alias("confidence"))
    paths = V.table(spark, d, "documents").select("doc_id", V.path().alias("path"))
    references = V.candidates(spark, d).select("doc_id", F.col("item_id").alias("page")).join(paths, "doc_id")
    return retrieval.referenced(pages, references, V.inventory(spark, d))


@query(f"SELECT doc_id, cast('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS dim, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL")
def document_embeddings(spark, d):
    return retrieval.embedded(V.table(spark, d, "documents"), "doc_id")


@query(r"""WITH e AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS heading, regexp_replace(url, '[#?].*$', '') AS target FROM pages),
  c AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS heading, regexp_replace(url, '[#?].*$', '') || CASE WHEN page_id % 17 = 0 THEN '/gone' ELSE '' END AS target FROM pages WHERE page_id % 10 <> 0)
SELECT *, 'add' AS action FROM (SELECT * FROM e EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM c EXCEPT SELECT * FROM e)""")
def catalog_changes(spark, d):
    pages = V.table(spark, d, "pages")
    heading, at = F.regexp_extract("url", "^https?://([^/]+)", 1).alias("heading"), graph.address(F.col("url"))
    listed = F.when(F.col("page_id") % 17 == 0, F.concat(at, F.lit("/gone"))).otherwise(at)
    return graph.catalog_changes(pages.select(heading, at.alias("target")), pages.filter("page_id % 10 <> 0").select(heading, listed.alias("target")))


@query(f"SELECT p_partkey::VARCHAR AS card_id, p_name AS title FROM part WHERE p_partkey IN (3, 5) OR list_has_all({TOKENS.format('p_name')}, ['widget', 'red'])")
def card_search(spark, d):
    all_cards = V.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("card_id"), F.col("p_name").alias("title"))
    return reports.cards(all_cards, ["3", "5"], "Widget, RED")


@query("""WITH o AS (SELECT source AS subject, avg(quality) AS quality, 1 - avg(toxic) AS civility FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
  m AS (SELECT 'quality' AS metric, subject, round(quality, 6) AS value FROM o UNION ALL SELECT 'civility', subject, round(civility, 6) FROM o)
SELECT metric, subject, value, row_number() OVER (PARTITION BY metric ORDER BY value, subject) AS rank, round((avg(value) OVER (PARTITION BY metric)) - value, 6) AS lacks FROM m QUALIFY rank <= 3""")
def improvement_opportunities(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", F.col("source").alias("subject")).join(V.table(spark, d, "labels"), "doc_id").groupBy("subject")
    each = rows.agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(1 - F.avg("toxic"), 6).alias("civility"))
    return reports.opportunities(each.unpivot("subject", ["quality", "civility"], "metric", "value"))


@query("""WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  n AS (SELECT user_id, ts, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, number""")
def user_sessions(spark, d):
    return sessions(V.table(spark, d, "events"))
