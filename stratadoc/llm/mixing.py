r"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a hash. Document after document gets
a virtual finish time: the words of its source up to and including it, divided
by the source's target. A source that is smaller than its target is run through
again, up to three times. All sources' documents are range-sorted by it, running
totals over the ranges tell how many words the mix has before each, and it is
truncated where these reach the total budget. In this order the shares of the
sources fit the weights at every point of the mix. As the targets add up to the
budget it is spent at virtual time 1, at which one document of each source is in
service: it queues with the words that are served by then, so that each source
takes its target and not up to a document more or less.

Defined results: a null text has no words; sources go by code point with null
as the last source of its own; equal hashes are ordered by id, then by text
hash, and rows that are equal in all of these share one place in the queue in
any order; documents without words are taken 0 times; an empty table gives an
empty mix. Columns beside ``doc_id``, ``text`` and ``source`` are ignored, and
carried through by ``mixed``, in which rows that repeat an id, a text and a
source all get the most words that one of them takes, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadoc.llm._shared import WORD, running, stage, table, text_or_empty

#: Weights of the sources in order, repeating; passes over a source at most.
WEIGHTS = (5.0, 2.0, 1.0)
PASSES = 3
#: Rows of a source that share a block of the hash order, about; blocks of a source at most.
BLOCK_ROWS = 256
MOST_BLOCKS = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place): place is the shuffled order, a 60-bit number of an md5."""
    text = text_or_empty()
    md5 = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/mix")))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(md5, 1, 15), 16, 10).cast("long").alias("place"),
        F.xxhash64(text).alias("tie"),
    )


def targets(by_source: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Adds weight and target to (source, source_size): one row per source.

    Shares in proportion to the weights, stopped at ``passes`` times the size:
    in order of size over weight the first sources are the stopped ones, so one
    running sum finds the level at which the rest share what is left.
    """
    at = running(by_source, [F.col("source").asc_nulls_last()], {"at": F.lit(1)}, "mix-order")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rated = at.withColumn("weight", pick).drop("at").withColumn("ratio", F.col("source_size") / F.col("weight"))
    rated = running(rated, [F.col("ratio"), F.col("source").asc_nulls_last()], {"less_size": F.col("source_size"), "less_weight": F.col("weight")}, "mix-ratios")
    rated = stage(rated, "mix-rated")
    total, weight = rated.agg(F.sum("source_size"), F.sum("weight")).first()
    left_words, left_weight = F.lit(total or 0) - passes * F.col("less_size"), F.lit(weight or 0.0) - F.col("less_weight")
    level = rated.filter(left_words <= passes * F.col("ratio") * left_weight).agg(F.max(left_words / left_weight)).first()[0]
    target = F.least(F.lit(level or 0.0) * F.col("weight"), (passes * F.col("source_size")).cast("double"))
    return rated.select("source", "source_size", "weight", target.alias("target"))


def queue(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(doc_id, source, size, tie, source_size, target, ahead): ahead is what its source queues before it.

    The running sum goes over blocks of the hash order: sums of the blocks, then
    a sum over the blocks of a source, then one within each block. So no task
    holds a source, however large it is.
    """
    rows = stage(sizes(docs), "mix-sizes")
    by_source = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    most = by_source.agg(F.max("rows")).first()[0] or 1
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * BLOCK_ROWS < most:
        blocks *= 2
    width = (1 << 60) // blocks
    rows = rows.withColumn("block", F.expr(f"place div {width}"))
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    offsets = sums.select(
        "source", "block",
        F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    goals = targets(by_source.select("source", "source_size"), weights, passes)
    plan = stage(offsets.join(goals, offsets["source"].eqNullSafe(goals["source"])).select(offsets["source"], "block", "offset", "source_size", "weight", "target"), "mix-plan")
    within = W.partitionBy("source", "block").orderBy("place", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = rows["source"].eqNullSafe(plan["source"]) & (rows["block"] == plan["block"])
    return rows.join(plan, same).select("doc_id", rows["source"], "size", "place", "tie", "source_size", "weight", "target", (F.col("offset") + F.col("inner")).alias("ahead"))


def served(queued: DataFrame, passes: int) -> DataFrame:
    """(round, words, finish) of each document and pass: the words served by virtual time 1, and its virtual finish time."""
    start = lambda e: F.lit(e) * F.col("source_size") + F.col("ahead")
    one = lambda e: F.struct(
        F.lit(e).alias("round"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - start(e))).alias("words"),
        F.try_divide(start(e) + F.col("size"), F.col("target")).alias("finish"),
    )
    return queued.withColumn("__e", F.explode(F.array(*[one(e) for e in range(passes)]))).select(*queued.columns, "__e.*").filter("words > 0")


def fair_queue(queued: DataFrame, passes: int = PASSES) -> DataFrame:
    """The mix: rows of ``queued`` by pass, with their finish time, the words before them in it, and the words it takes of them."""
    budget = queued.agg(F.sum("size")).first()[0] or 0
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("place"), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    line = running(served(queued, passes), order, {"before": F.col("words")}, "mix-queue")
    return line.withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("before"))).filter("words > 0")


def mix(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    q = stage(queue(docs, weights, passes).withColumn("row", F.monotonically_increasing_id()), "mix-placed")
    taken = fair_queue(q.drop("weight"), passes).groupBy("row").agg(F.sum("words").alias("taken"))
    return q.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mix itself in order of virtual finish time: ``docs`` rows, one for each pass that takes them.

    A document that is taken in part appears with its first words only. Rows
    without words take no part.
    """
    line = fair_queue(stage(queue(docs, weights, passes), "mix-placed"), passes)
    taken = line.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("q_id"), F.col("source").alias("q_source"), F.col("tie").alias("q_tie"), "round")
    taken = taken.agg(F.max("words").alias("words"), F.max("size").alias("size"), F.min("finish").alias("finish"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    row = row.withColumn("tie", F.xxhash64(text)).withColumn("id", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    joined = row.join(taken, (row["id"] == taken["q_id"]) & (row["tie"] == taken["q_tie"]) & row["row.source"].eqNullSafe(F.col("q_source")))
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("words").cast("int")), "")
    cols = [F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("row.text")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*cols, F.col("finish").alias("__finish"), F.col("q_source").alias("__s")).orderBy("__finish", "__s").drop("__finish", "__s")


def op4_fair_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         cast('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/mix'), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (SELECT *, source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s),
c AS (
  SELECT *, (total - coalesce(3 * sum(source_size) OVER w, 0))::DOUBLE AS left_words, weights - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(left_words / left_weight) AS level FROM c WHERE left_words <= 3 * ratio * left_weight),
t AS (SELECT source, source_size, coalesce(least(level * weight, (3 * source_size)::DOUBLE), 0.0) AS target FROM c, l),
q AS (
  SELECT d.doc_id, d.source, place, size, source_size, target, round(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT doc_id, source, place, greatest(0, least(size, budget - (p * source_size + ahead))) AS words, (p * source_size + ahead + size) / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS p) WHERE budget > p * source_size + ahead AND size > 0),
f AS (
  SELECT doc_id, least(words, (SELECT sum(size) FROM d) - coalesce(sum(words) OVER w, 0)) AS words FROM e
  WINDOW w AS (ORDER BY finish, source NULLS LAST, place, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT doc_id, sum(greatest(0, words))::BIGINT AS taken FROM f GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (doc_id)
"""
