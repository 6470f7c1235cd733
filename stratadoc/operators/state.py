"""Change capture by content hash, acceptance, and the gates between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "path string, sha256 string"


def inventory(docs: DataFrame, path: Column, text: Column) -> DataFrame:
    """(path, sha256, length) of a table of texts; the text itself goes no further than the hash."""
    return docs.select(path.alias("path"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha256"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("length"))


def delta(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, sha256, old_path, old_sha256, change_type): new, changed, unchanged, moved or deleted.

    One shuffle of both sides by path; only the paths on one side alone are then
    paired by hash to find moves. Copies share a hash, so pairs are made by rank:
    each deleted path explains one new path at most.
    """
    now = current.select("path", "sha256")
    then = manifest.select(F.col("path").alias("old_path"), F.col("sha256").alias("old_sha256"))
    both = now.join(then, now["path"] == then["old_path"], "full")
    change = (
        F.when(F.col("old_path").isNull(), "new").when(F.col("path").isNull(), "deleted")
        .when(F.col("sha256") == F.col("old_sha256"), "unchanged").otherwise("changed")
    )
    both = both.withColumn("change_type", change)
    hash_ = F.coalesce("sha256", "old_sha256")
    single = both.filter("change_type in ('new', 'deleted')").withColumn("rank", F.row_number().over(W.partitionBy(hash_, "change_type").orderBy(F.coalesce("path", "old_path"))))
    new = single.filter("change_type = 'new'").select("path", "sha256", "rank")
    gone = single.filter("change_type = 'deleted'").select("old_path", "old_sha256", F.col("rank").alias("old_rank"))
    paired = new.join(gone, (new["sha256"] == gone["old_sha256"]) & (new["rank"] == gone["old_rank"]), "full")
    kind = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "new").otherwise("moved")
    cols = ["path", "sha256", "old_path", "old_sha256"]
    return both.filter("change_type in ('changed', 'unchanged')").select(*cols, "change_type").unionByName(paired.select(*cols, kind.alias("change_type")))


def proceeding(found: DataFrame) -> DataFrame:
    """Only new and changed sources go on."""
    return found.filter("change_type in ('new', 'changed')")


def needs_maintenance(found: DataFrame) -> bool:
    """Whether a source was moved or deleted: the run stops for maintenance and takes nothing as new."""
    return bool(found.filter("change_type in ('moved', 'deleted')").head(1))


def accepted(manifest: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The manifest advanced by exactly the reviewed delta."""
    gone = reviewed.filter("old_path is not null").select(F.col("old_path").alias("path"))
    again = reviewed.filter("path is not null").select("path")
    kept = manifest.select("path", "sha256").join(gone.unionByName(again).distinct(), "path", "left_anti")
    return kept.unionByName(reviewed.filter("path is not null").select("path", "sha256"))


def bootstrap(current: DataFrame) -> DataFrame:
    """The corpus as it is, accepted without a review."""
    return current.select("path", "sha256")


def gates(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds ``may_run``: all stages of the run before this one are ok. The first may always run."""
    before = W.partitionBy(run).orderBy("stage_no").rowsBetween(W.unboundedPreceding, -1)
    return stages.withColumn("may_run", F.coalesce(F.bool_and(F.coalesce("ok", F.lit(False))).over(before), F.lit(True)))


def renamed(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type) with the paths of moved sources brought up to date; those of deleted ones go."""
    moves = found.filter("change_type = 'moved'").select(F.col("old_path").alias("was"), F.col("path").alias("now"))
    gone = found.filter("change_type = 'deleted'").select(F.col("old_path").alias("dst"))
    out = edges.join(gone, "dst", "left_anti")
    for side in ("src", "dst"):
        out = out.join(moves, out[side] == moves["was"], "left").withColumn(side, F.coalesce("now", side)).drop("was", "now")
    return out.select("src", "dst", "edge_type")
