"""Tables in the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filesystem(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset a local session gets a temporary folder, recorded in the
    setting; any other raises an error, as executors do not see each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratadoc-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to a new table in the shared folder and reads it back.

    A lost executor then costs only the tasks that read from the table, and a
    plan that uses it twice computes it once. ``used`` collects the paths of
    tables that are to be deleted by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, used: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in used:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    used.clear()


def small(df: DataFrame, most: int, name: str = "small", used: list[str] | None = None) -> DataFrame:
    """``df`` as a table of its own, marked for broadcast only if its counted rows are at most ``most``."""
    kept = stage(df, name, used)
    return F.broadcast(kept) if kept.count() <= most else kept


def running(df: DataFrame, order: list, sums: dict, name: str = "running") -> DataFrame:
    """Adds to each row, for every ``sums`` item, the total of its column over all rows before it in ``order``.

    The rows are range-sorted and written with the number of their range; the
    totals of the ranges are summed up, and a window runs within each range only,
    so no task holds the whole order. Rows that are equal in ``order`` share a range.
    """
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), name)
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])  # one row a partition
    ahead = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = rows.join(F.broadcast(ahead), "__range")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


#: Rows of hot keys that are broadcast at most.
HOT_KEYS = 100_000


def with_hot(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Joins ``rows`` to ``table``, which has one row a key and in ``count`` how many rows the key has.

    Keys that hold more than 1/HOT_KEYS of all rows are at most HOT_KEYS: they
    are broadcast, so that their rows stay where they are. The others are joined
    by a shuffle in which no key is large.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    least = max(1000, (total or 0) / HOT_KEYS)
    if (most or 0) <= least:
        return rows.join(table, key, how)
    hot = F.col(count) > least
    marked = rows.join(F.broadcast(table.filter(hot).withColumn("__hot", F.lit(True))), key, "left")
    found = marked.filter("__hot").drop("__hot")
    rest = marked.filter("__hot is null").select(*rows.columns).join(table.filter(~hot), key, how)
    return found.unionByName(rest)
