"""Text expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and digits make tokens; everything else separates them.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text (null: none)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf); counted on the map side before the shuffle."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def md5_number(text: Column) -> Column:
    """The first 32 bits of an md5 as a number: an order that any engine can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dimension(term: Column) -> Column:
    """A number below 64 from the first 32 bits of an md5: ``md5_number(term) % 64``, from the two digits that decide it."""
    return F.conv(F.substring(F.md5(term), 7, 2), 16, 10).cast("int") % 64


def frontmatter(text: Column) -> Column:
    """Map of the ``key: value`` lines between the two leading ``---`` lines; null without such a block."""
    block = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:\s][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    return F.when(text.rlike(r"\A---\r?\n[\s\S]*?\r?\n---"), F.map_from_entries(F.array_distinct(pairs)))


def sections(text: Column) -> Column:
    """Array of (heading, body) of the ``## `` sections."""
    parts = F.slice(F.split(F.coalesce(text, F.lit("")), r"(?m)^## "), 2, 1 << 20)
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("heading"), F.regexp_replace(p, r"\A[^\n]*\n?\s*|\s+\z", "").alias("body")))


def section(text: Column, heading: str) -> Column:
    """Body of the first section with this heading; null if there is none."""
    return F.get(F.filter(sections(text), lambda s: s["heading"] == heading), F.lit(0))["body"]


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|label]]`` in order."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]\|]+)"), F.lit(1))
