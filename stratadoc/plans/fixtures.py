"""Queries of the sources and sinks: each writes a small vault from the tables of regions and nations below the shared folder, and works on its files.

These two tables have the same few rows at every scale. What is written is
deleted by no query, as the frames returned read it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import date

from pyspark.sql import functions as F

from stratadoc.functions.tables import shared_dir, stage
from stratadoc.operators import graph, lint, packet, reconcile, reports, retrieval, state
from stratadoc.plans import ingest
from stratadoc.plans import vault as V
from stratadoc.plans.catalog import DELTA, INVENTORY, LINKS, query
from stratadoc.sources import files, sinks


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _nations(spark, d) -> list:
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()  # 25 rows


CONFIDENCE = {0: "high", 1: "low", 2: "certain"}


def page(key: int, name: str) -> str:
    """A page about a nation: frontmatter without a confidence for every fifth, links to the next nation and to one that is not there, a source, notes."""
    head = "" if key % 5 == 4 else f"confidence: {CONFIDENCE[key % 3]}\n"
    title = f"aliases: N{key}\n" if key % 2 else ""
    refs = "" if key % 7 == 6 else f"## References\n- [[src/{key}]]\n- [[src/{key + 20}]]\n"
    return f"---\nkey: {key}\n{head}{title}---\n# {name}\nnear [[NATION_{key + 1}]] and [[nowhere|x]]\n{refs}## Notes\nnote {key}\n"


def write_vault(spark, d, name: str = "vault") -> str:
    root = place(spark, name)
    for r in _nations(spark, d):
        sinks.write_text(spark, f"{root}/{r.r_name}/{r.n_name}.md", page(r.n_nationkey, r.n_name))
    return root


def write_sources(spark, d, name: str = "data") -> str:
    """Sources of the nations; every tenth is empty."""
    root = place(spark, name)
    for r in _nations(spark, d):
        sinks.write_text(spark, f"{root}/src/{r.n_nationkey}.md", "" if r.n_nationkey % 10 == 0 else f"about {r.n_name}\n")
    return root


NATIONS = r"""nr AS (SELECT n_nationkey AS key, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
  body AS (SELECT key, name, region, region || '/' || name || '.md' AS path, CASE WHEN key % 5 = 4 THEN NULL ELSE ['high', 'low', 'certain'][key % 3 + 1] END AS confidence FROM nr),
  pg AS (SELECT *, concat('---', chr(10), 'key: ', key, chr(10), CASE WHEN confidence IS NULL THEN '' ELSE concat('confidence: ', confidence, chr(10)) END,
    CASE WHEN key % 2 = 1 THEN concat('aliases: N', key, chr(10)) ELSE '' END, '---', chr(10), '# ', name, chr(10), 'near [[NATION_', key + 1, ']] and [[nowhere|x]]', chr(10),
    CASE WHEN key % 7 = 6 THEN '' ELSE concat('## References', chr(10), '- [[src/', key, ']]', chr(10), '- [[src/', key + 20, ']]', chr(10)) END, '## Notes', chr(10), 'note ', key, chr(10)) AS text FROM body)"""
SOURCES = "src AS (SELECT n_nationkey AS key, 'src/' || n_nationkey || '.md' AS path, CASE WHEN n_nationkey % 10 = 0 THEN '' ELSE concat('about ', n_name, chr(10)) END AS text FROM nation)"


@query(f"WITH {SOURCES} SELECT path, 'src' AS folder, strlen(text)::BIGINT AS length, sha256(text) AS sha256 FROM src")
def vault_inventory(spark, d):
    return files.inventory(spark, write_sources(spark, d)).select("path", "folder", "length", "sha256")


@query(f"""WITH {NATIONS} SELECT path, sha256(text) AS sha256, key::VARCHAR AS key, confidence, CASE WHEN key % 7 = 6 THEN 'Notes' ELSE 'References,Notes' END AS headings,
  'NATION_' || (key + 1) || ',nowhere' || CASE WHEN key % 7 = 6 THEN '' ELSE ',src/' || key || ',src/' || (key + 20) END AS links,
  CASE WHEN key % 7 = 6 THEN '' ELSE 'src/' || key || ',src/' || (key + 20) END AS refs, 'note ' || key AS notes FROM pg""")
def vault_pages(spark, d):
    p = files.pages(spark, write_vault(spark, d))
    meta = lambda k: F.try_element_at("frontmatter", F.lit(k)).alias(k)
    return p.select(
        "path", F.sha2("text", 256).alias("sha256"), meta("key"), meta("confidence"), F.array_join(F.transform("sections", lambda s: s["heading"]), ",").alias("headings"),
        F.array_join("links", ",").alias("links"), F.array_join("references", ",").alias("refs"), "notes",
    )


@query(f"WITH {NATIONS}, {SOURCES} SELECT 'data' AS collection, count(*) AS n_items, sum(length(text))::BIGINT AS n_chars FROM src WHERE text <> '' UNION ALL SELECT 'level-knowledge', count(*), sum(length(text))::BIGINT FROM pg")
def vault_collections(spark, d):
    return retrieval.index_status(files.collections(spark, {"data": write_sources(spark, d), "level-knowledge": write_vault(spark, d)}))


@query(f"WITH {NATIONS} SELECT 'level-knowledge' AS collection, path, name AS title FROM pg WHERE length(text) > 150")
def scoped_search(spark, d):
    both = files.collections(spark, {"data": write_sources(spark, d), "level-knowledge": write_vault(spark, d)})
    title = F.regexp_extract("text", r"(?m)^# (.*)$", 1).alias("title")
    return retrieval.in_collections(both, ["level-knowledge"]).filter("length(text) > 150").select("collection", "path", title)


@query(f"WITH {NATIONS} SELECT path, 'confidence' AS missing FROM pg WHERE confidence IS NULL UNION ALL SELECT path, 'aliases' FROM pg WHERE key % 2 = 0")
def vault_metadata_gaps(spark, d):
    return packet.metadata_gaps(files.pages(spark, write_vault(spark, d)), ["confidence", "key", "aliases"])


@query(f"WITH {NATIONS} SELECT path, confidence FROM pg WHERE confidence IS NULL OR confidence = 'certain'")
def vault_confidence(spark, d):
    return packet.bad_confidence(files.pages(spark, write_vault(spark, d)), files.CONFIDENCE)


@query(f"WITH {NATIONS} SELECT path, 'confidence' AS key, confidence AS value FROM pg WHERE confidence = 'certain'")
def vault_invalid_values(spark, d):
    return lint.invalid(files.pages(spark, write_vault(spark, d)), {"confidence": files.CONFIDENCE})


@query(f"WITH {NATIONS} SELECT path, 'References' AS missing FROM pg WHERE key % 7 = 6")
def vault_structure(spark, d):
    return lint.missing_sections(files.pages(spark, write_vault(spark, d)), ["References", "Notes"])


@query(f"WITH {NATIONS}, {SOURCES}, refs AS (SELECT path AS page, 'src/' || unnest([key, key + 20]) || '.md' AS path FROM pg WHERE key % 7 <> 6) SELECT path, page FROM refs WHERE path NOT IN (SELECT path FROM src)")
def vault_references(spark, d):
    cited = files.pages(spark, write_vault(spark, d)).select(F.col("path").alias("page"), F.explode(F.transform("references", lambda x: F.concat(x, F.lit(".md")))).alias("path"))
    return packet.dangling_references(cited, files.inventory(spark, write_sources(spark, d))).select("path", "page")


@query(f"""WITH {NATIONS} SELECT region || '/' || name AS src, 'NATION_' || (key + 1) AS dst, 'link' AS edge_type FROM pg UNION ALL SELECT region || '/' || name, 'nowhere', 'link' FROM pg
UNION ALL SELECT region || '/' || name, 'src/' || unnest([key, key + 20]), 'reference' FROM pg WHERE key % 7 <> 6""")
def vault_dependencies(spark, d):
    return ingest.dependencies(files.pages(spark, write_vault(spark, d)))


@query(f"WITH {NATIONS} SELECT name AS entity, substr(md5(name), 1, 16) AS entity_id, path FROM pg UNION ALL SELECT 'N' || key, substr(md5(name), 1, 16), path FROM pg WHERE key % 2 = 1")
def vault_entities(spark, d):
    return graph.entities(files.pages(spark, write_vault(spark, d)))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def registry_json(spark, d):
    path = place(spark, "registry") + "/registry.json"
    sinks.write_text(spark, path, json.dumps([{"id": r.n_nationkey, "name": r.n_name} for r in _nations(spark, d)], indent=1))
    return files.registry(spark, path).select(F.col("id").cast("int").alias("id"), "name")


@query("SELECT lower(n_name) AS tag, '#' || substr(md5(n_name), 1, 6) AS color FROM nation")
def tag_policy(spark, d):
    path = place(spark, "policy") + "/tagging.md"
    rows = [f"| {r.n_name.lower()} | `#{hashlib.md5(r.n_name.encode()).hexdigest()[:6].upper()}` |\n" for r in _nations(spark, d)]
    sinks.write_text(spark, path, "# Tags\n| tag | color |\n|---|---|\n" + "".join(rows))
    return files.tag_policy(spark, path)


@query("""SELECT 'path:' || n_name AS query, '#' || lpad(hex(n_nationkey + CASE WHEN n_nationkey % 4 = 0 THEN 1000 ELSE 0 END), 6, '0') AS color, true AS kept, true AS written, false AS again FROM nation WHERE n_nationkey % 6 <> 5""")
def graph_settings(spark, d):
    """Settings with a group a nation, into which other groups are put: some are gone, some have another color; written once, then left alone."""
    path = place(spark, "settings") + "/graph.json"
    keys = [(r.n_nationkey, r.n_name) for r in _nations(spark, d)]
    old = [{"query": f"path:{n}", "color": {"a": 1, "rgb": k}} for k, n in keys]
    sinks.write_text(spark, path, json.dumps({"scale": 2, "colorGroups": old}))
    wanted = spark.createDataFrame([(f"path:{n}", f"#{k + (0 if k % 4 else 1000):06x}") for k, n in keys if k % 6 != 5], "query string, color string")
    written, again = sinks.write_settings(spark, path, wanted), sinks.write_settings(spark, path, wanted)
    got = files.graph_settings(spark, path)
    return got.select("query", F.upper("color").alias("color"), (F.get_json_object("rest", "$.scale") == "2").alias("kept"), F.lit(written).alias("written"), F.lit(again).alias("again"))


@query("SELECT r_name AS heading, r_name || '/' || n_name AS target, true AS first, false AS second FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_update(spark, d):
    """The catalog is written when it lacks a page, and not again."""
    root = place(spark, "catalog")
    entries = graph.catalog_entries(files.pages(spark, write_vault(spark, d)))
    first, second = sinks.update_catalog(spark, entries, root), sinks.update_catalog(spark, entries, root)
    return sinks.read_current(spark, root, sinks.CATALOG).select("heading", "target", F.lit(first).alias("first"), F.lit(second).alias("second"))


@query("SELECT r_name AS heading, n_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def master_catalog(spark, d):
    path = place(spark, "index") + "/index.md"
    rows = sorted((r.r_name, r.n_name) for r in _nations(spark, d))
    text = "# Index\n" + "".join(f"## {h}\n" + "".join(f"- [[{n}|{n.title()}]]\n" for k, n in rows if k == h) for h in sorted({h for h, _ in rows}))
    sinks.write_text(spark, path, text)
    return files.catalog(spark, path)


@query("SELECT n_name || '.png' AS name, strlen(n_name)::BIGINT AS length, sha256(n_name) AS sha256, upper(n_name) AS description FROM nation")
def vault_images(spark, d):
    root = place(spark, "images")
    for r in _nations(spark, d):
        sinks.write_text(spark, f"{root}/{r.n_name}.png", r.n_name)
    got = files.images(spark, root, lambda content: F.upper(content.cast("string")))
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256", "description")


@query(f"WITH {INVENTORY} SELECT path, sha256 FROM inv")
def bootstrap_manifest(spark, d):
    """The corpus recorded as accepted: a version written and read back."""
    root = place(spark, "manifest")
    sinks.write_version(state.bootstrap(V.inventory(spark, d)), root)
    return sinks.read_current(spark, root, state.MANIFEST)


@query(f"WITH {DELTA} SELECT path, sha256, 2::BIGINT AS n_runs FROM delta WHERE change_type IN ('new', 'changed')")
def retry_sources(spark, d):
    """What a run that failed before its acceptance detected is detected again by the next."""
    root = place(spark, "manifest")
    sinks.write_version(V.manifest(spark, d), root)
    runs = [state.proceeding(state.delta(V.inventory(spark, d), sinks.read_current(spark, root, state.MANIFEST))).select("path", "sha256") for _ in range(2)]
    return runs[0].unionByName(runs[1]).groupBy("path", "sha256").agg(F.count("*").alias("n_runs"))


@query(r"""SELECT * FROM (VALUES ('1-blocked', 'inbox', false, 0), ('2-fails', 'inbox', true, 0), ('2-fails', 'detect', true, 0), ('2-fails', 'packet', true, 0), ('2-fails', 'preflight', true, 0), ('2-fails', 'review', false, 0),
  ('3-invalid', 'inbox', true, 0), ('3-invalid', 'detect', true, 0), ('3-invalid', 'packet', true, 0), ('3-invalid', 'preflight', true, 0), ('3-invalid', 'review', true, 0), ('3-invalid', 'validate', false, 0),
  ('4-good', 'inbox', true, 26), ('4-good', 'detect', true, 26), ('4-good', 'packet', true, 26), ('4-good', 'preflight', true, 26), ('4-good', 'review', true, 26), ('4-good', 'validate', true, 26), ('4-good', 'refresh', true, 26), ('4-good', 'accept', true, 26),
  ('5-idle', 'inbox', true, 26), ('5-idle', 'detect', true, 26), ('5-idle', 'packet', false, 26)) AS t(run, stage, ok, n_accepted)""")
def ingest_run(spark, d):
    """Five runs over one vault: a blocked inbox, a review that fails, one that breaks a rule, a good one, and one with nothing to do."""
    data, where = write_sources(spark, d), [place(spark, k) for k in ("manifest", "log", "wiki")]
    good = "---\nconfidence: high\n---\n# One\n## References\n- [[src/1]]\n- [[Knowledge/idea]]\n## Notes\nmine\n"
    written = lambda text: lambda packet: spark.createDataFrame([("team/one.md", text)], ingest.WIKI)

    def fails(packet):
        raise RuntimeError("no reviewer")

    sinks.write_text(spark, f"{data}/Inbox/idea.md", "no rule")
    rows = []
    for name, review in (("1-blocked", fails), ("2-fails", fails), ("3-invalid", written(good.replace("src/1", "src/none"))), ("4-good", written(good)), ("5-idle", fails)):
        run = ingest.ingest(spark, data, *where, review, date(2024, 1, 2))
        n = sinks.read_current(spark, where[0], state.MANIFEST).count()
        rows += [(name, s, ok, n) for s, ok in run.stages]
        if name == "1-blocked":
            sinks.write_text(spark, f"{data}/Inbox/idea.md", "one\ntwo\n")
    return spark.createDataFrame(rows, "run string, stage string, ok boolean, n_accepted int")


@query(f"WITH {NATIONS} SELECT path, sha256(CASE WHEN key % 3 = 0 THEN 'new ' || key ELSE text END) AS sha256 FROM pg UNION ALL SELECT 'more.md', sha256('more')")
def page_rewrite(spark, d):
    """Every third page is rewritten in place, one is created, all others stay."""
    root = place(spark, "wiki")
    pages = files.pages(spark, write_vault(spark, d)).select("path", "text", F.try_element_at("frontmatter", F.lit("key")).alias("key"))
    sinks.write_version(pages.select("path", "text"), root)
    new = pages.filter("cast(key as int) % 3 = 0").select("path", F.concat(F.lit("new "), "key").alias("text"))
    old = sinks.read_current(spark, root, ingest.WIKI)
    sinks.rewrite_pages(old, new.unionByName(spark.createDataFrame([("more.md", "more")], ingest.WIKI)), root)
    return sinks.read_current(spark, root, ingest.WIKI).select("path", F.sha2("text", 256).alias("sha256"))


@query("SELECT r_name AS kind, max(d) AS report_date, count(*) AS n FROM region, (SELECT unnest([DATE '2024-01-01', DATE '2024-02-01']) AS d) GROUP BY r_name")
def dated_reports(spark, d):
    """Two reports of each kind, the first written twice: each has its place, and the newest is known."""
    root, regions = place(spark, "reports"), V.table(spark, d, "region")
    for r in regions.collect():  # 5 rows
        for on in (date(2024, 1, 1), date(2024, 1, 1), date(2024, 2, 1)):
            sinks.dated_report(regions.filter(F.col("r_name") == r.r_name), root, r.r_name, on)
    got = spark.read.parquet(root)
    n = got.groupBy("kind").agg(F.count("*").alias("n"))
    return graph.newest(got, "kind", "report_date", "r_regionkey").select("kind", "report_date").join(n, "kind")


@query("SELECT n_name AS title, 2::BIGINT AS n_history, 3::BIGINT AS n_log FROM nation WHERE n_nationkey < 10")
def appended_and_overwritten(spark, d):
    """A list is overwritten, a history and a log are appended to."""
    root, nations = place(spark, "lists"), V.table(spark, d, "nation").select(F.col("n_name").alias("title"), "n_nationkey")
    for least in (20, 10):
        sinks.planning(nations.filter(F.col("n_nationkey") < least), f"{root}/daily")
        sinks.append_history(nations, f"{root}/history")
    for n in range(3):
        sinks.append_log(spark, f"{root}/log", date(2024, 1, 1 + n), "ingest", n, n)
    history = spark.read.parquet(f"{root}/history").groupBy("title").agg(F.count("*").alias("n_history"))
    return spark.read.parquet(f"{root}/daily").select("title").join(history, "title").crossJoin(spark.read.parquet(f"{root}/log").agg(F.count("*").alias("n_log")))  # one row


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def activity_months(spark, d):
    """Messages go to the folder of their month."""
    path = place(spark, "activity")
    events = V.table(spark, d, "events").select("ts", F.col("event_type").alias("kind"), "user_id")
    sinks.append_activity(events, path)
    return spark.read.option("recursiveFileLookup", False).parquet(path).groupBy(F.col("month").cast("string").alias("month"), "kind").agg(F.count("*").alias("n"))


@query("""SELECT CASE event_type WHEN 'click' THEN 'sent' WHEN 'view' THEN 'mention' ELSE 'ping' END AS kind, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE ts::DATE = DATE '2024-01-03' GROUP BY ALL""")
def chat_day(spark, d):
    """One day's messages of the three kinds."""
    e = V.table(spark, d, "events").select("ts", F.col("user_id").alias("user"), F.lit("c").alias("channel"), F.col("props").alias("text"), "event_type")
    found = reports.chat_activity(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), e.filter("event_type not in ('click', 'view')"), date(2024, 1, 3))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("user").alias("n_users"))


@query("SELECT o_orderkey AS meeting_id FROM orders WHERE o_orderdate::DATE = DATE '1997-01-15' AND o_orderstatus = 'F'")
def meetings_today(spark, d):
    meetings = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").alias("ended_at"), (F.col("o_orderstatus") == "F").alias("has_summary"))
    return reports.meetings_to_export(meetings, date(1997, 1, 15)).select("meeting_id")


@query(f"""WITH {DELTA}, e AS (SELECT 'page/' || o_orderkey % 100 AS src, old_path AS dst FROM man JOIN orders ON o_orderkey = length(old_path)),
  mv AS (SELECT old_path, path FROM delta WHERE change_type = 'moved'), gone AS (SELECT old_path FROM delta WHERE change_type = 'deleted')
SELECT src, coalesce(mv.path, dst) AS dst, 'reference' AS edge_type FROM e LEFT JOIN mv ON dst = mv.old_path WHERE dst NOT IN (SELECT old_path FROM gone)""")
def renamed_edges(spark, d):
    orders = V.table(spark, d, "orders").select((F.col("o_orderkey") % 100).cast("string").alias("n"), F.col("o_orderkey").alias("k"))
    man = V.manifest(spark, d)
    edges = man.join(orders, F.length("path") == F.col("k")).select(F.concat(F.lit("page/"), "n").alias("src"), F.col("path").alias("dst"), F.lit("reference").alias("edge_type"))
    return state.renamed(edges, V.delta(spark, d))


@query("SELECT DISTINCT item_id, sha256(text) AS sha256 FROM benchmark WHERE item_id IN (SELECT o_orderkey % 300 FROM orders WHERE o_orderkey < 120)")
def bounded_reading(spark, d):
    """A reviewer reads only what the packet lists."""
    listed = V.table(spark, d, "orders").filter("o_orderkey < 120").select((F.col("o_orderkey") % 300).alias("item_id"))
    return packet.bounded(V.table(spark, d, "benchmark"), listed, "item_id").select("item_id", F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {LINKS}, fx AS (SELECT DISTINCT page_id, href FROM links WHERE target NOT IN (SELECT target FROM addr) AND page_id % 2 = 0)
SELECT 'snapshot' AS step, page_id::VARCHAR AS page FROM fx GROUP BY page_id UNION ALL SELECT 'untouched', page_id::VARCHAR FROM pages WHERE page_id % 10 = 1
UNION ALL SELECT 'remaining', page_id::VARCHAR FROM fx WHERE page_id % 4 = 0""")
def fix_cycle(spark, d):
    """Selected fixes: the pages are copied first; pages outside the selection that changed, and issues that remain, are found."""
    pages, found = V.table(spark, d, "pages"), V.links(spark, d)
    broken = graph.broken(found, pages).select(F.lit("broken_link").alias("rule"), F.col("page_id").cast("string").alias("page"), F.col("href").alias("detail")).distinct()
    fixed = stage(broken.filter("cast(page as long) % 2 = 0"), "fixed")
    as_paths = pages.select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"), "page_id")
    path = place(spark, "snapshot")
    sinks.snapshot(as_paths, fixed.select(F.col("page").alias("path")), path)
    before = as_paths.select("path", F.sha2("text", 256).alias("sha256"))
    after = as_paths.select("path", F.sha2(F.when(F.col("page_id") % 10 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    changed = lint.untouched(before, after, fixed.select(F.col("page").alias("path"))).select("path").distinct()
    again = broken.filter("cast(page as long) % 4 = 0")
    steps = [spark.read.parquet(path).select(F.lit("snapshot").alias("step"), F.col("path").alias("page")), changed.select(F.lit("untouched").alias("step"), F.col("path").alias("page"))]
    return steps[0].unionByName(steps[1]).unionByName(lint.remaining(fixed, again).select(F.lit("remaining").alias("step"), "page"))


@query("""WITH n AS (SELECT n_name AS domain, row_number() OVER (ORDER BY n_name) AS rank FROM nation WHERE n_nationkey % 2 = 0),
  f AS (SELECT color, row_number() OVER (ORDER BY color) AS rank FROM (SELECT '#0000' || lpad(i::VARCHAR, 2, '0') AS color FROM range(14) AS t(i)) WHERE color NOT IN (SELECT '#0000' || lpad(r_regionkey::VARCHAR, 2, '0') FROM region))
SELECT domain, color FROM n LEFT JOIN f USING (rank)""")
def next_colors(spark, d):
    palette = [f"#0000{i:02d}" for i in range(14)]
    used = V.table(spark, d, "region").select(F.concat(F.lit("#0000"), F.lpad(F.col("r_regionkey").cast("string"), 2, "0")).alias("color"))
    return reconcile.next_color(V.table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("domain")), palette, used)


PROMISES = """pr AS (SELECT l_suppkey AS subject, o_orderdate::DATE AS made, o_orderdate::DATE + 60 AS due, CASE WHEN l_shipdate::DATE < DATE '1998-01-02' THEN l_shipdate::DATE END AS done
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  ms AS (SELECT l_suppkey AS subject, l_shipdate::DATE AS day FROM lineitem WHERE l_shipdate::DATE < DATE '1998-01-02' GROUP BY ALL)"""


@query(f"""WITH {PROMISES}, w AS (SELECT DATE '1997-12-26' AS a, DATE '1998-01-02' AS z),
  gaps AS (SELECT subject, day, date_diff('day', lag(day) OVER (PARTITION BY subject ORDER BY day), day) AS gap FROM ms),
  f AS (SELECT 'missed' AS finding, subject, count(*) AS n, max(date_diff('day', due, z)) AS worst FROM pr, w WHERE due >= a AND due < z AND (done IS NULL OR done >= z) GROUP BY ALL
    UNION ALL SELECT 'delayed', subject, count(*), max(date_diff('day', due, done)) FROM pr, w WHERE done >= a AND done < z AND done > due GROUP BY ALL
    UNION ALL SELECT 'overpromised', subject, count(*) FILTER (made >= a AND made < z) - count(*) FILTER (done >= a AND done < z), NULL FROM pr, w GROUP BY ALL
    UNION ALL SELECT 'lapsed', subject, count(*), max(gap) FROM gaps, w WHERE day >= a AND day < z AND gap > 14 GROUP BY ALL)
SELECT DATE '1998-01-01' AS run_date, finding, subject, n, worst::BIGINT AS worst FROM f WHERE n > 0""")
def critique_findings(spark, d):
    """The week's findings, appended to the history and read from there."""
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("day")).join(V.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("made")), F.col("l_orderkey") == F.col("o_orderkey"))
    known = F.col("day") < F.lit(date(1998, 1, 2))
    promises = rows.select(F.col("l_suppkey").alias("subject"), "made", F.date_add("made", 60).alias("due"), F.when(known, F.col("day")).alias("done"))
    path = place(spark, "critique-history")
    sinks.append_history(reports.findings(promises, rows.filter(known).select(F.col("l_suppkey").alias("subject"), "day"), V.TASKS_ON), path)
    return spark.read.parquet(path)
