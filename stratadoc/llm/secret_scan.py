r"""Secret scans with corpus-wide ownership, with DataFrame functions only.

Patterns propose candidates in each text. The hash of each candidate's value is
then counted over the whole corpus by the repositories and owners it occurs in:
a value that several owners have is a copied example, one that a single owner
has looks like a live credential of that owner.

Base kinds are ``assign``, ``access`` and ``hex``; ``vendor`` spans (tokens with
a vendor's prefix, JSON web tokens, key block headers) are added to them.

Defined results: null texts count as empty and have no spans; a null repository
or owner is one of its own; repeated rows each get a row, but count once towards
ownership as the counts are of distinct repositories and owners; an empty table
gives an empty result; columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.llm._shared import stage, table, text_or_empty, with_hot

# The patterns of the kinds, in the order in which equal starts are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----"
KINDS = ("assign", "access", "hex", "vendor")
BASE = 3
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: From so many distinct owners on, a value is an example that is copied about.
SHARED_OWNERS = 2


#: Sums of an array of numbers up to and with each place, by doubling steps: n log n, and no row leaves its task.
SUMS = "aggregate(sequence(0, 30), {a}, (acc, k) -> if(size(acc) > shiftleft(1, k), transform(acc, (x, i) -> x + if(i >= shiftleft(1, k), acc[i - shiftleft(1, k)], 0)), acc))"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``spans``, an array of (start, end, kind, match), ordered by start and kind, to column ``t``.

    The pieces between matches are what a split by the pattern leaves, so the end
    of a match is the sum of all pieces and matches up to it.
    """
    patterns = (ASSIGN, ACCESS, HEX, VENDOR)
    for k, p in enumerate(patterns):
        docs = docs.withColumn(f"m{k}", F.expr(f"regexp_extract_all(t, {_literal(p)}, 0)"))
    for k, p in enumerate(patterns):
        steps = f"transform(slice(split(t, {_literal(p)}, -1), 1, size(m{k})), (x, i) -> length(x) + length(m{k}[i]))"
        docs = docs.withColumn(f"e{k}", F.expr(f"if(size(m{k}) = 0, cast(array() as array<int>), {SUMS.format(a=steps)})"))
    parts = [f"transform(m{k}, (m, i) -> named_struct('start', e{k}[i] - length(m), 'end', e{k}[i], 'kind', {k}, 'match', m))" for k in range(len(patterns))]
    keep = (
        f"filter({parts[0]}, x -> length(regexp_extract(x.match, {_literal(ASSIGN)}, 2)) >= {ASSIGN_LEAST})",
        f"filter({parts[1]}, x -> length(x.match) >= {ACCESS_LEAST})", parts[2], parts[3],
    )
    return docs.withColumn("spans", F.expr(f"array_sort(concat({', '.join(keep)}))"))


def _joined(spans: str) -> str:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: its counts and spans by kind, and how its candidates are owned.

    ``n_live``: candidates whose value one owner alone has; ``n_shared``: those of
    ``SHARED_OWNERS`` owners and more; ``most_repositories``: the largest number of
    repositories that one of its values occurs in.
    """
    rows = docs.select("doc_id", F.col(repository).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), text_or_empty().alias("t"))
    value = f"CASE WHEN x.kind = 0 THEN regexp_extract(x.match, {_literal(ASSIGN)}, 2) ELSE x.match END"
    found = stage(
        candidates(rows).select(
            "doc_id", "repo", "owner",
            *[F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))],
            F.sha2(F.expr(_joined(f"filter(spans, x -> x.kind < {BASE})")), 256).alias("base_sha256"),
            F.expr(_joined("spans")).alias("spans"),
            F.expr(f"transform(spans, x -> sha2({value}, 256))").alias("hashes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "secret-spans",
    )
    each = found.filter("size(hashes) > 0").select("row", "repo", "owner", F.explode("hashes").alias("hash"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_rows"))
    repos = each.groupBy("hash", "repo").agg(F.lit(1).alias("x")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    owned = stage(owners.join(repos, "hash"), "secret-owners")
    per_row = (
        with_hot(each.select("row", "hash"), owned, "hash", "n_rows")
        .groupBy("row").agg(
            F.count_if(F.col("n_owners") < SHARED_OWNERS).alias("n_live"),
            F.count_if(F.col("n_owners") >= SHARED_OWNERS).alias("n_shared"),
            F.max("n_repos").alias("most_repositories"),
        )
    )
    with_any = found.filter("size(hashes) > 0").join(per_row, "row")
    none = found.filter("size(hashes) = 0").select("*", *[F.lit(0).cast("long").alias(c) for c in ("n_live", "n_shared", "most_repositories")])
    return none.unionByName(with_any).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_vendor", "base_sha256", "spans", "n_live", "n_shared", "most_repositories"
    )


def op10_secret_ownership(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
