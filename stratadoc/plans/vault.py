"""The driver tables in the roles that the operators need: an inventory, a manifest before it, pages, tasks, claims."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.operators import graph, lint, packet, retrieval, state

AS_OF = date(2024, 12, 31)
TASKS_ON = date(1998, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def path():
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def inventory(spark, d) -> DataFrame:
    return state.inventory(table(spark, d, "documents"), path(), F.col("text"))


def manifest(spark, d) -> DataFrame:
    """What was accepted before: some documents not yet there, some with another text, some at another path, some gone since."""
    docs = table(spark, d, "documents")
    id_ = F.col("doc_id")
    was = F.when(id_ % 13 == 0, F.concat(F.lit("old/"), id_.cast("string"), F.lit(".md"))).otherwise(path())
    text = F.when(id_ % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    there = docs.filter(id_ % 11 != 0).select(was.alias("path"), F.sha2(text, 256).alias("sha256"))
    gone = docs.filter(id_ % 17 == 0).select(F.concat(F.lit("gone/"), id_.cast("string")).alias("path"), F.sha2(F.concat(F.lit("gone"), id_.cast("string")), 256).alias("sha256"))
    return there.unionByName(gone)


def delta(spark, d) -> DataFrame:
    return state.delta(inventory(spark, d), manifest(spark, d))


def delta_documents(spark, d) -> DataFrame:
    """The new and changed documents themselves."""
    docs = table(spark, d, "documents").withColumn("path", path())
    return docs.join(state.proceeding(delta(spark, d)).select("path"), "path", "left_semi")


def candidates(spark, d) -> DataFrame:
    return packet.candidates(delta_documents(spark, d), table(spark, d, "benchmark"))


def site(spark, d) -> DataFrame:
    """The pages with a link to another one of them in two of three, for want of real ones: to the page with half its id."""
    p = table(spark, d, "pages")
    other = p.select(F.col("page_id").alias("to"), F.col("url").alias("to_url"))
    linked = p.join(other, (F.expr("page_id div 2") == F.col("to")) & (F.col("page_id") % 3 != 0), "left")
    link = F.when(F.col("to_url").isNull(), "").otherwise(F.concat(F.lit('<a href="'), "to_url", F.lit('">')))
    return linked.select("page_id", "url", F.concat("html", link).alias("html"))


def links(spark, d) -> DataFrame:
    return graph.html_links(site(spark, d))


def similar(spark, d) -> DataFrame:
    return graph.similar(table(spark, d, "documents"))


def clusters(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    prints = graph.fingerprints(docs)
    confirmed = graph.similar(docs, prints=prints).filter("status = 'confirmed'").select("a", "b")
    return graph.components(confirmed.unionByName(graph.copies(prints)))


def wiki(spark, d) -> DataFrame:
    """Pages with a title, a language and a date of their last update."""
    p = table(spark, d, "pages")
    return p.select(
        F.col("page_id").alias("page"), "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("html", '<meta name="author" content="([^"]*)"', 1).alias("author"),
        F.date_sub(F.lit(AS_OF), (F.col("page_id") % 200).cast("int")).alias("updated"),
    )


def issues(spark, d) -> DataFrame:
    pages, found = table(spark, d, "pages"), links(spark, d)
    w = wiki(spark, d)
    return lint.issues({
        "broken_link": graph.broken(found, pages).select(F.col("page_id").alias("page"), F.col("href").alias("detail")).distinct(),
        "orphan": graph.orphans(found, pages).select(F.col("page_id").alias("page"), F.col("url").alias("detail")),
        "missing_metadata": lint.missing_metadata(w, ["title", "lang", "author"]).select("page", F.col("missing").alias("detail")),
        "stale": lint.stale(w, AS_OF).select("page", F.col("age_days").alias("detail")),
    })


def tasks(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("Order "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderdate").alias("due"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderpriority").alias("priority"))


def opinions(spark, d) -> DataFrame:
    """(doc_id, subject, value): labelled documents as statements about their source."""
    l, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "source")
    return docs.join(l, "doc_id").select("doc_id", F.col("source").alias("subject"), (F.col("quality") - F.col("toxic")).cast("double").alias("value"))


def collections(spark, d) -> DataFrame:
    parts = [("data", "documents", "text"), ("level-knowledge", "pages", "html"), ("level-playbook", "benchmark", "text")]
    frames = [table(spark, d, t).select(F.lit(c).alias("collection"), F.col(x).alias("text")) for c, t, x in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def search(spark, d, method) -> DataFrame:
    return method(table(spark, d, "documents"), table(spark, d, "benchmark"))


def page_edges(spark, d) -> DataFrame:
    """Links between the pages of the benchmark, for want of real ones: each page links to the one with half its number."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("src"), F.expr("item_id div 2").alias("dst"))


def answers(spark, d) -> DataFrame:
    """Questions from the benchmark, page titles as the catalog, documents as the raw sources; pages claim a language by their title."""
    w = wiki(spark, d)
    kind = F.when(F.col("page") % 3 == 0, "low").when(F.col("page") % 3 == 1, "medium").otherwise("high")
    catalog = w.select(F.col("page").alias("doc_id"), F.col("title").alias("text"), kind.alias("confidence"))
    claims = w.select(F.col("page").alias("doc_id"), F.lit("lang").alias("attribute"), F.col("lang").alias("value"))
    questions = table(spark, d, "benchmark").withColumn("needs_precision", F.col("item_id") % 7 == 0)
    return retrieval.answer(questions, catalog, table(spark, d, "documents"), claims)
