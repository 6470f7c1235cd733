"""The ingest packet: routing, candidates, ambiguities, cues, and the checks before and after a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadoc.functions import text as T
from stratadoc.functions.tables import small
from stratadoc.operators import retrieval

#: Routing rules in order of priority: the first whose pattern a text matches gives its folder.
ROUTES = (("[0-9a-f]{40}", "Assets"), (r"\|", "Resources"), ("@", "Meetings"), ("!!", "Personal"), (r"\n", "Knowledge"))
#: What may not leave: rules in place of an undocumented list.
REDACTIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"\+[0-9][0-9() .-]{7,}[0-9]",
    "key": r"[0-9a-f]{32,}",
}
CANDIDATES, MARGIN = 5, 0.05
#: Tags of a vocabulary that are broadcast at most; beyond it they are joined.
BROADCAST_TAGS = 500_000


def routed(docs: DataFrame, text: str = "text", routes=ROUTES) -> DataFrame:
    """Adds ``target``: a chain of conditions, so no join; null where no rule matches."""
    target = F.lit(None).cast("string")
    for pattern, folder in reversed(routes):
        target = F.when(F.col(text).rlike(pattern), folder).otherwise(target)
    return docs.withColumn("target", target)


def blocked(routed_docs: DataFrame) -> DataFrame:
    return routed_docs.filter("target is null")


def candidates(sources: DataFrame, pages: DataFrame, k: int = CANDIDATES, source: str = "doc_id", page: str = "item_id") -> DataFrame:
    """(source, page, score, fused, rank): the k best pages of each source by terms and vectors together; ``score`` is that by terms."""
    return retrieval.matched(sources, pages, k, source=source, page=page).select(source, page, "score", "fused", "rank")


def with_graph(found: DataFrame, edges: DataFrame, source: str = "doc_id", page: str = "item_id") -> DataFrame:
    """(source, page, score, rank, origin): the packet's pages, those found by search and those that the graph puts beside them."""
    beside = neighbours(found, edges, source, page).select(source, page, F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), F.lit("graph").alias("origin"))
    return found.select(source, page, "score", "rank", F.lit("search").alias("origin")).unionByName(beside)


def ambiguities(found: DataFrame, source: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """Sources whose best two candidates are closer by their terms than the relative margin, or of which the second has more, or neither any."""
    order = W.partitionBy(source).orderBy("rank")
    led = found.withColumn("next_score", F.lead("score").over(order)).filter("rank = 1 and next_score is not null")
    gap = F.when(F.col("score") > 0, F.round(F.try_divide(F.col("score") - F.col("next_score"), F.col("score")), 6)).otherwise(0.0)
    return led.withColumn("margin", gap).filter(F.col("margin") < margin)


def unmatched(sources: DataFrame, found: DataFrame, floor: float, source: str = "doc_id") -> DataFrame:
    """(source, score): sources without a candidate above the floor, queued like ambiguous ones; without any, the score is 0."""
    best = found.filter("rank = 1").select(source, "score")
    return sources.select(source).join(best, source, "left").select(source, F.coalesce("score", F.lit(0.0)).alias("score")).filter(F.col("score") <= floor)


def neighbours(found: DataFrame, edges: DataFrame, source: str = "doc_id", page: str = "item_id") -> DataFrame:
    """(source, page, via): pages one link away from a source's candidates that are not candidates themselves.

    ``edges`` is (src, dst); a page met from several candidates comes from the best ranked.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    met = found.select(source, "rank", F.col(page).alias("src")).join(both, "src").groupBy(source, F.col("dst").alias(page)).agg(F.min_by("src", "rank").alias("via"))
    return met.join(found.select(source, page), [source, page], "left_anti").select(source, page, "via")


def cues(sources: DataFrame, vocabulary: DataFrame, source: str = "doc_id") -> DataFrame:
    """(source, tag, n): controlled tags that occur among a source's terms; other terms are dropped where they are read."""
    tags = small(vocabulary.select(F.lower("tag").alias("term"), "tag").distinct(), BROADCAST_TAGS, "tags")
    words = sources.select(source, F.explode(T.tokens(F.col("text"))).alias("term"))
    return words.join(tags, "term").groupBy(source, "tag").agg(F.count("*").alias("n"))


def preflight(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n, ok): one row a check; rows of its frame are findings."""
    frames = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("ok")) for name, d in checks.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bounded(rows: DataFrame, packet: DataFrame, key: str) -> DataFrame:
    """What a reviewer may read: only what the packet lists."""
    return rows.join(packet.select(key).distinct(), key, "left_semi")


def page_action(sources: DataFrame, found: DataFrame, enrich: float, create: float = 0.0, source: str = "doc_id") -> DataFrame:
    """enrich, none or create for each source, by its best candidate's score: a deterministic stand-in for a review."""
    best = found.filter("rank = 1").select(source, "score")
    action = F.when(F.col("score") >= enrich, "enrich").when(F.col("score") > create, "none").otherwise("create")
    return sources.select(source).join(best, source, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("action", action)


def metadata_gaps(pages: DataFrame, required: list[str]) -> DataFrame:
    """(path, missing): required keys that a page's frontmatter lacks."""
    keys = F.coalesce(F.map_keys("frontmatter"), F.array().cast("array<string>"))
    return pages.select("path", F.explode(F.array_except(F.array(*map(F.lit, required)), keys)).alias("missing"))


def dangling_references(references: DataFrame, sources: DataFrame) -> DataFrame:
    """References (page, path) to sources that do not exist."""
    return references.join(sources.select("path"), "path", "left_anti")


def bad_confidence(pages: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    value = F.try_element_at("frontmatter", F.lit("confidence"))
    return pages.select("path", value.alias("confidence")).filter(F.col("confidence").isNull() | ~F.col("confidence").isin(*allowed))


def touched_notes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages (path, notes) whose protected notes are not what they were; a page that is gone has lost them."""
    a = after.select(F.col("path").alias("p"), F.sha2(F.coalesce("notes", F.lit("")), 256).alias("after"))
    b = before.select("path", F.sha2(F.coalesce("notes", F.lit("")), 256).alias("before"))
    return b.join(a, b["path"] == a["p"], "left").filter(~F.col("before").eqNullSafe(F.col("after"))).select("path", "before", "after")


def redactions(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=REDACTIONS) -> DataFrame:
    """(key, rule, n): findings of each rule in one pass over the text."""
    counted = F.array(*[F.struct(F.lit(name).alias("rule"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("long").alias("n")) for name, p in rules.items()])
    return docs.select(key, F.explode(counted).alias("r")).select(key, "r.rule", "r.n").filter("n > 0")


def redacted(text: Column, rules=REDACTIONS) -> Column:
    for name, p in rules.items():
        text = F.regexp_replace(text, p, f"[{name}]")
    return text
