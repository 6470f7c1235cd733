"""The gated ingest run: the manifest advances only after every stage before it has succeeded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions.tables import stage
from stratadoc.operators import graph, lint, packet, retrieval, state
from stratadoc.sources import files, sinks

WIKI = "path string, text string"
#: Keys that the frontmatter of a page has to have, and sections of its body.
REQUIRED, SECTIONS = ("confidence",), ("References",)
#: Score at and below which a source's best page is no match.
FLOOR = 10.0


@dataclass
class Packet:
    """All that a reviewer may read: sources (path, sha256, text), candidate pages (path, text) and what is known of them."""

    sources: DataFrame
    pages: DataFrame
    candidates: DataFrame
    ambiguities: DataFrame
    unmatched: DataFrame
    cues: DataFrame | None
    preflight: DataFrame


@dataclass
class Run:
    """What a run did: (stage, ok) in order, and whether the manifest moved."""

    stages: list[tuple[str, bool]] = field(default_factory=list)
    accepted: bool = False
    note: str = ""


Review = Callable[[Packet], DataFrame]


def bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def route_inbox(spark: SparkSession, data: str, routes=packet.ROUTES) -> list[str]:
    """Moves the files of ``data``/Inbox to the folders that the rules give them, and returns those that it could not.

    Blocked are files that no rule matches, empty ones, and those whose place is taken.
    """
    if not sinks.exists(spark, f"{data}/Inbox"):
        return []
    found = packet.routed(files.texts(spark, f"{data}/Inbox"), "text", routes).select("path", "target").collect()  # an inbox, not the corpus
    blocked = []
    for row in found:
        fs, old = sinks._fs(spark, f"{data}/Inbox/{row.path}")
        _, new = sinks._fs(spark, f"{data}/{row.target}/{row.path}")
        if row.target is None or fs.exists(new):
            blocked.append(row.path)
            continue
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            blocked.append(row.path)
    return sorted(blocked)


def dependencies(parsed: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of parsed pages: their links to pages and their references to sources, without suffixes."""
    edge = lambda column, kind: parsed.select(bare(F.col("path")).alias("src"), F.explode(column).alias("dst"), F.lit(kind).alias("edge_type"))
    return edge("references", "reference").unionByName(edge(F.array_except("links", "references"), "link")).withColumn("dst", bare(F.col("dst"))).distinct()


def prepare(spark: SparkSession, sources: DataFrame, wiki: DataFrame, vocabulary: DataFrame | None = None, blocked: DataFrame | None = None) -> Packet:
    """The packet of these sources (path, sha256, text): their candidate pages by search and by the graph, and what is uncertain."""
    pages = wiki.select("path", F.coalesce("text", F.lit("")).alias("text"))
    named = pages.withColumnRenamed("path", "page")
    found = stage(packet.candidates(sources, named, source="path", page="page"), "packet-candidates")
    edges = dependencies(files.parse(pages)).filter("edge_type = 'link'").select(F.concat("src", F.lit(".md")).alias("src"), F.concat("dst", F.lit(".md")).alias("dst"))
    both = packet.with_graph(found, edges.join(pages.select(F.col("path").alias("dst")), "dst", "left_semi"), "path", "page")
    both = stage(both, "packet-pages")
    checks = {"not_utf8": sources.filter(F.col("text").contains("�"))}
    if blocked is not None:
        checks["blocked"] = blocked
    return Packet(
        sources=sources,
        pages=packet.bounded(pages, both.select(F.col("page").alias("path")), "path"),
        candidates=both,
        ambiguities=packet.ambiguities(found, "path"),
        unmatched=packet.unmatched(sources, found, FLOOR, "path"),
        cues=packet.cues(sources, vocabulary, "path") if vocabulary is not None else None,
        preflight=packet.preflight(checks),
    )


def findings(old: DataFrame, new: DataFrame, sources: DataFrame, readable: DataFrame | None = None) -> dict[str, DataFrame]:
    """What speaks against the reviewed pages, by check; all frames must be empty.

    ``old`` and ``new`` are parsed pages, ``sources`` the inventory, ``readable``
    the pages of the packet: no other existing page may be rewritten. A reference
    names a source by its path, with or without ``.md``, or a page.
    """
    cited = new.select(F.col("path").alias("page"), F.explode("references").alias("path")).withColumn("path", bare(F.col("path")))
    after = old.join(new.select("path"), "path", "left_anti").select("path").unionByName(new.select("path").distinct())
    known = sources.select("path").unionByName(after).select(bare(F.col("path")).alias("path")).distinct()
    name = F.element_at(F.split(bare(F.col("path")), "/"), -1)
    own = after.join(new.select("path").distinct(), "path", "left_semi").select(name.alias("entity_id")).distinct()
    entities = after.select(name.alias("entity_id")).join(own, "entity_id", "left_semi")
    edges = dependencies(new).filter("edge_type = 'reference'").withColumn("src", F.concat("src", F.lit(".md")))
    nodes = known.select(F.col("path").alias("node")).unionByName(after.select(F.col("path").alias("node")))
    out = {
        "notes": packet.touched_notes(old.join(new.select("path"), "path", "left_semi"), new),
        "metadata": packet.metadata_gaps(new, list(REQUIRED)),
        "confidence": packet.bad_confidence(new, files.CONFIDENCE),
        "structure": lint.missing_sections(new, list(SECTIONS)),
        "references": packet.dangling_references(cited, known),
        "redaction": packet.redactions(new, "path"),
        "repeated": new.groupBy("path").count().filter("count > 1"),
        "dependencies": graph.validate(entities, edges, nodes).filter("n > 0"),
    }
    if readable is not None:
        out["outside"] = new.join(old.select("path"), "path", "left_semi").join(readable.select("path"), "path", "left_anti").select("path")
    return out


def failing(found: dict[str, DataFrame]) -> list[str]:
    """The checks that have findings, in their order; all are made in one job."""
    out = None
    for name, rows in found.items():
        one = rows.limit(1).select(F.lit(name).alias("check"))
        out = one if out is None else out.unionByName(one)
    bad = {r.check for r in out.collect()}  # a row a check
    return [name for name in found if name in bad]


def refresh_state(pages: DataFrame, changed: DataFrame, root: str) -> bool:
    """Brings the dependency graph and the search index (path, dim, w) up to date: the graph first, then the vectors of changed pages alone.

    False, and nothing further is done, if an edge of the new graph starts at no page.
    """
    spark = pages.sparkSession
    parsed = files.parse(pages)
    edges = stage(dependencies(parsed), "dependencies")
    if edges.join(pages.select(bare(F.col("path")).alias("src")), "src", "left_anti").head(1):
        return False
    sinks.write_version(edges, f"{root}/dependencies")
    index = sinks.read_current(spark, f"{root}/index", "path string, dim long, w double")
    kept = index.join(changed.select("path"), "path", "left_anti").join(pages.select("path"), "path", "left_semi")
    fresh = retrieval.embedded(pages.join(changed.select("path").distinct(), "path", "left_semi"), "path")
    sinks.write_version(kept.unionByName(fresh), f"{root}/index")
    return True


def ingest(
    spark: SparkSession, data: str, manifest: str, log: str, wiki: str, review: Review, on: date,
    refresh: Callable[[], bool] = lambda: True, vocabulary: DataFrame | None = None, routes=packet.ROUTES,
) -> Run:
    """Prepare the inbox, detect, make the packet, review, validate, refresh, accept.

    The delta is written once, and everything after it reads that table: what is
    reviewed, and what is accepted, has the hash that was detected. A file that
    changes meanwhile is left for the next run. A stage that fails ends the run;
    nothing is accepted then, so the same sources come up again. The catalog,
    dependency graph and index beside the wiki are written only if pages changed;
    ``refresh`` is for what else depends on them.
    """
    run = Run()

    def done(name: str, ok: bool, note: str = "") -> bool:
        run.stages.append((name, ok))
        run.note = run.note if ok else note
        return ok

    blocked = route_inbox(spark, data, routes)
    if not done("inbox", not blocked, "blocked: " + ", ".join(blocked)):
        return run
    before = sinks.read_current(spark, manifest, state.MANIFEST)
    listed = stage(files.inventory(spark, data), "inventory")
    found = stage(state.delta(listed, before), "delta")
    if not done("detect", not state.needs_maintenance(found), "moved or deleted sources need maintenance"):
        return run
    delta = state.proceeding(found)
    sources = files.texts(spark, data).join(delta.select("path", "sha256"), ["path", "sha256"], "left_semi")
    sources = stage(sources.select("path", "sha256", "text"), "packet-sources")
    reviewed = delta.join(sources.select("path"), "path", "left_semi")
    pages = sinks.read_current(spark, wiki, WIKI)
    if not done("packet", bool(sources.head(1)), "nothing new"):
        return run
    ready = prepare(spark, sources, pages, vocabulary)
    if not done("preflight", not ready.preflight.filter("not ok").head(1), "preflight: " + ", ".join(r.check for r in ready.preflight.filter("not ok").collect())):
        return run
    try:
        written = stage(review(ready).select("path", "text"), "reviewed")
    except Exception as error:
        done("review", False, str(error)[:200])
        return run
    done("review", True)
    old, new = files.parse(pages), files.parse(written)
    bad = failing(findings(old, new, listed, ready.pages))
    if not done("validate", not bad, "the reviewed pages are not valid: " + ", ".join(bad)):
        return run
    changed = written.join(pages.withColumnRenamed("text", "was"), "path", "left").filter("was is null or was <> text").select("path", "text")
    n = changed.count()
    if n:
        changed = stage(changed, "changed")
        sinks.rewrite_pages(pages, changed, wiki)
        after = sinks.read_current(spark, wiki, WIKI)
        sinks.update_catalog(spark, graph.catalog_entries(after), f"{wiki}-catalog")
        if not done("refresh", refresh_state(after, changed, f"{wiki}-state") and refresh(), "derived state could not be refreshed"):
            return run
    sinks.write_version(state.accepted(before, reviewed), manifest)
    run.accepted = done("accept", True)
    sinks.append_log(spark, log, on, "ingest", sources.count(), n)
    return run


def bootstrap(spark: SparkSession, data: str, manifest: str) -> None:
    """Records the present corpus as accepted without a review."""
    sinks.write_version(state.bootstrap(files.inventory(spark, data)), manifest)
