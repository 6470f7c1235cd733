"""Color groups as an explicit change set, and the audit of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PAGES = 3


def desired(tag_colors: DataFrame, domain_colors: DataFrame) -> DataFrame:
    """(query, color, origin) of the policy's tags and the present domains."""
    tags = tag_colors.select(F.concat(F.lit("tag:#"), "tag").alias("query"), "color", F.lit("tag").alias("origin"))
    return tags.unionByName(domain_colors.select(F.concat(F.lit("path:"), "domain").alias("query"), "color", F.lit("domain").alias("origin")))


def reconcile(actual: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, old_color, new_color, action): add, correct, remove or keep.

    Only groups of domains are removed when they are not wanted any more; manual
    groups stay. A dry run is this frame without a sink.
    """
    a = actual.select("query", F.col("color").alias("old_color"), F.col("origin").alias("old_origin"))
    w = wanted.select(F.col("query").alias("q"), F.col("color").alias("new_color"))
    both = a.join(w, a["query"] == w["q"], "full").withColumn("query", F.coalesce("query", "q"))
    action = (
        F.when(F.col("old_color").isNull(), "add").when(F.col("new_color").isNull() & (F.col("old_origin") == "domain"), "remove")
        .when(F.col("new_color").isNull(), "keep").when(F.col("old_color") == F.col("new_color"), "keep").otherwise("correct")
    )
    return both.withColumn("action", action).select("query", "old_color", F.when(F.col("action") == "keep", F.col("old_color")).otherwise(F.col("new_color")).alias("new_color"), "action")


def applied(changes: DataFrame) -> DataFrame:
    """The groups after the change set; applying it again changes nothing."""
    return changes.filter("action <> 'remove'").select("query", F.col("new_color").alias("color"))


def audit_tags(tagged: DataFrame, vocabulary: DataFrame, groups: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(tag, n_pages): controlled tags on so many pages and more that have no color group. It assigns nothing."""
    counted = tagged.select("page", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("page").alias("n_pages")).filter(F.col("n_pages") >= least)
    return counted.join(vocabulary.select("tag"), "tag", "left_semi").join(groups.select("tag"), "tag", "left_anti")


def next_color(domains: DataFrame, palette: list[str], used: DataFrame) -> DataFrame:
    """(domain, color): new domains by name get the palette's colors that are not in use, in order."""
    from pyspark.sql import Window as W

    spark = domains.sparkSession
    free = spark.createDataFrame(list(enumerate(palette)), "n int, color string").join(used.select("color"), "color", "left_anti")
    free = free.select("color", F.row_number().over(W.orderBy("n")).alias("rank"))
    new = domains.select("domain", F.row_number().over(W.orderBy("domain")).alias("rank"))
    return new.join(free, "rank", "left").select("domain", "color")
