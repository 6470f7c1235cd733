"""Sinks. These, and the manifest's, are the only functions with side effects."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions.tables import filesystem as _fs
from stratadoc.operators import graph

CATALOG = "heading string, target string"
#: Color groups of a settings file at most.
GROUPS = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Writes a small file whole: beside its place first, then moved there in one step.

    Without ``replace`` it is an error if there is a file already.
    """
    fs, fresh = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    _, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    out = fs.create(fresh, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE if replace else hadoop.Options.Rename.NONE
    context = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(fresh), fs.makeQualified(target), how)
    except Exception:
        fs.delete(fresh, False)
        raise


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file whole; nothing if there is none."""
    if not exists(spark, path):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and folder of the version that is valid: the one with the highest commit."""
    fs, p = _fs(spark, f"{root}/commits")
    if not fs.exists(p):
        return None
    numbers = [int(n) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit()]
    return (max(numbers), read_text(spark, f"{root}/commits/{max(numbers):012d}")) if numbers else None


def read_current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The valid version; an empty table before the first one."""
    at = current(spark, root)
    if at is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{at[1]}")


def write_version(frame: DataFrame, root: str) -> str:
    """Writes a new version beside the old ones, then its commit: a file with the next number, which appears whole or not at all.

    A run that stops before that leaves the version before valid. Of two writers
    that start from the same version the second fails.
    """
    spark = frame.sparkSession
    at = current(spark, root)
    version = f"v-{uuid.uuid4().hex}"
    frame.write.parquet(f"{root}/{version}")
    write_text(spark, f"{root}/commits/{(at[0] if at else 0) + 1:012d}", version, replace=False)
    return version


def rewrite_pages(old: DataFrame, new: DataFrame, root: str) -> str:
    """Pages in place: a page in ``new`` replaces the one at its path or is created; all others stay."""
    cols = old.columns
    kept = old.join(new.select("path"), "path", "left_anti")
    return write_version(kept.unionByName(new.select(*cols)), root)


def dated_report(report: DataFrame, root: str, kind: str, on: date) -> str:
    path = f"{root}/kind={kind}/report_date={on.isoformat()}"
    report.write.mode("overwrite").parquet(path)
    return path


def planning(frame: DataFrame, path: str) -> None:
    """Daily and weekly lists: overwritten, not dated."""
    frame.write.mode("overwrite").parquet(path)


def append_log(spark: SparkSession, path: str, on: date, operation: str, processed: int, changed: int, notes: str = "") -> None:
    """One line for each operation; nothing in the log is ever rewritten."""
    spark.createDataFrame([(on, operation, processed, changed, notes)], "date date, operation string, files_processed long, pages_changed long, notes string").coalesce(1).write.mode("append").parquet(path)


def append_history(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def append_activity(frame: DataFrame, path: str) -> None:
    """Entries go to the folder of their month."""
    frame.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("month").write.mode("append").partitionBy("month").parquet(path)


def write_if_changed(frame: DataFrame, current: DataFrame, path: str) -> bool:
    """Writes only real changes; tells whether it wrote."""
    same = not frame.exceptAll(current).head(1) and not current.exceptAll(frame).head(1)
    if not same:
        frame.write.mode("overwrite").parquet(path)
    return not same


def write_settings(spark: SparkSession, path: str, groups: DataFrame) -> bool:
    """Puts the color groups (query, color) into a settings file if they are not what it has; tells whether it wrote.

    Every other setting, what else a group that stays has, and the order of such
    groups are kept. More than GROUPS groups are an error: the file is one object.
    """
    rows = groups.select("query", "color").distinct().limit(GROUPS + 1).collect()
    if len(rows) > GROUPS:
        raise ValueError(f"more than {GROUPS} color groups")
    wanted = {r.query: int(r.color.lstrip("#"), 16) for r in rows}
    settings = json.loads(read_text(spark, path) or "{}")
    before = settings.get("colorGroups") or []
    after = []
    for g in before:
        if (rgb := wanted.pop(g.get("query"), None)) is not None:
            after.append({**g, "color": {**(g.get("color") or {"a": 1}), "rgb": rgb}})
    after += [{"query": q, "color": {"a": 1, "rgb": rgb}} for q, rgb in sorted(wanted.items())]
    if after == before:
        return False
    write_text(spark, path, json.dumps({**settings, "colorGroups": after}, ensure_ascii=False, indent=2))
    return True


def update_catalog(spark: SparkSession, entries: DataFrame, root: str) -> bool:
    """Writes the catalog (heading, target) anew if it lacks an entry or lists one in vain; tells whether it wrote."""
    entries = entries.select("heading", "target").distinct()
    if not graph.catalog_changes(entries, read_current(spark, root, CATALOG)).head(1):
        return False
    write_version(entries, root)
    return True


def snapshot(pages: DataFrame, selected: DataFrame, path: str) -> None:
    """Copies the pages that are about to change."""
    pages.join(selected.select("path").distinct(), "path", "left_semi").write.parquet(path)
