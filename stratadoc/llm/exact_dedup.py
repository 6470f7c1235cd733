r"""Exact deduplication by progressive refinement, with DataFrame functions only.

Two texts are equal when they are identical after every character of
``[\x20\x09-\x0D]`` is deleted. Rows are told apart in rounds, cheapest first:
by the length of the normalised text, then by a hash of its first characters,
then by SHA-256 of the whole. A row that is alone in its group after a round
leaves; only the survivors' contents are hashed in full.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null ``doc_id`` comes after all others; rows that repeat an id and its
text all belong to the group, and ``kept`` marks every row with the kept id
(``deduplicated`` returns only one of them); columns beside ``doc_id`` and
``text`` are ignored here and carried through by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.llm._shared import SPACE, stage, table, text_or_empty, with_hot

#: Characters under the prefix hash.
PREFIX = 64
#: The keys of surviving groups are broadcast up to this many rows (of 16 bytes).
BROADCAST_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def _measured(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, n_points, len, prefix[, sha]) of each row; the text itself is not kept."""
    norm = docs.select("doc_id", text_or_empty().alias("t")).withColumn("n", normalised(F.col("t")))
    return norm.select(
        "doc_id",
        F.length("t").cast("long").alias("n_points"),
        F.length("n").cast("long").alias("len"),
        F.xxhash64(F.substring("n", 1, PREFIX)).alias("prefix"),
        *([F.sha2("n", 256).alias("sha")] if whole else []),
    )


def _surviving(measured: DataFrame) -> DataFrame:
    """The (len, prefix) pairs that more than one row has."""
    lengths = measured.groupBy("len").agg(F.count("*").alias("rows")).filter("rows > 1").select("len")
    return (
        measured.join(F.broadcast(lengths) if lengths.count() <= BROADCAST_KEYS else lengths, "len", "left_semi")
        .groupBy("len", "prefix").agg(F.count("*").alias("rows")).filter("rows > 1").select("len", "prefix")
    )


def _bounded(keys: DataFrame) -> DataFrame:
    keys = stage(keys, "dedup-keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _last_null(col: Column) -> Column:
    """Orders ids ascending under max(), null below all: max(-id) is the smallest id."""
    return -col


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The digest of every text is asked for here, so it is taken in the one scan
    and the rounds decide which rows are grouped by it. Of equal texts the row
    with the most code points in its original text stays, then the smallest id.
    """
    measured = stage(_measured(docs, True), "dedup-measured")
    keys = _bounded(_surviving(measured)).withColumn("hit", F.lit(True))
    rows = measured.join(keys, ["len", "prefix"], "left")
    found = stage(
        rows.filter("hit").groupBy("sha")
        .agg(F.max(F.struct("n_points", _last_null(F.col("doc_id")).alias("neg"))).alias("best"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("sha", (-F.col("best.neg")).alias("keep_id"), "group_size"),
        "dedup-groups",
    )
    # A row whose (len, prefix) pair is its own joins nothing: its key is null and is spread by its id.
    single = rows.filter("hit is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    multi = (
        with_hot(rows.filter("hit").select("doc_id", "sha"), found, "sha", "group_size", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.expr("group_size is null or doc_id <=> keep_id").alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
    return single.unionByName(multi)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows alone in their (length, prefix) group pass through without a shuffle;
    only the survivors' texts are hashed in full and brought together.
    """
    cols = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    t = F.coalesce(F.col("row.text"), F.lit(""))
    keys = _bounded(_surviving(stage(_measured(docs, False), "dedup-measured"))).withColumn("hit", F.lit(True))
    marked = (
        row.withColumn("n", normalised(t))
        .withColumn("len", F.length("n").cast("long")).withColumn("prefix", F.xxhash64(F.substring("n", 1, PREFIX)))
        .join(keys, ["len", "prefix"], "left")
    )
    order = F.struct(F.length(t), -F.col("row.doc_id"))
    best = (
        marked.filter("hit").select(F.sha2("n", 256).alias("sha"), "row", order.alias("o"))
        .groupBy("sha").agg(F.max_by("row", "o").alias("row"))
    )
    return marked.filter("hit is null").select(*cols).unionByName(best.select(*cols))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY sha) AS group_size,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY pts DESC, doc_id NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha AS text_sha256
FROM r
"""
