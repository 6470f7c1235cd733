"""Sources: files of a vault as DataFrames. Everything is read by Spark, from any store it knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions import text as T
from stratadoc.functions.tables import filesystem

# Search collections and their folders; domains and their colors; page kinds of clients.
COLLECTIONS = {"data": "Data", "level-knowledge": "Level Knowledge", "level-playbook": "Level Playbook"}
DOMAIN_COLORS = {
    "clients": "#4d8fcc", "team": "#5ca65c", "decisions": "#9a5cbf", "tools": "#5ca6a6",
    "analytics": "#c4607a", "processes": "#c4a060", "organization": "#cc7a4d",
}
CLIENT_PAGES = ("overview", "issues", "trends", "sentiment", "wins")
CONFIDENCE = ("high", "medium", "low")


def _below(spark: SparkSession, path: Column, root: str) -> Column:
    """A path relative to ``root``; Spark writes ``file:///x`` in some places and ``file:/x`` in others."""
    fs, p = filesystem(spark, root)
    whole = fs.makeQualified(p).toString().rstrip("/")
    return F.regexp_replace(path, "^([A-Za-z]+):///", "$1:/").substr(F.lit(len(whole) + 2), F.lit(1 << 30))


def _decoded(path: Column) -> Column:
    """An encoded path as it is; unlike in a form, ``+`` stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, mtime) of all files below ``root``.

    Spark's scans skip files without bytes, but its listing has them: they are
    those listed and not read, and have no mtime.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    listed = DataFrame(spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    read = files.select(_below(spark, F.col("path"), root).alias("path"), "content", F.col("modificationTime").alias("mtime"))
    empty = listed.select(_below(spark, _decoded(F.col("value")), root).alias("path")).join(files.filter("length > 0").select(_below(spark, F.col("path"), root).alias("path")), "path", "left_anti")
    return read.filter("length(content) > 0").unionByName(empty.select("path", F.lit(b"").alias("content"), F.lit(None).cast("timestamp").alias("mtime")))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Hash inventory of all files below ``root``, empty ones too: path, folder, length, mtime, sha256. An empty folder gives no rows."""
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).alias("folder")
    return contents(spark, root).select("path", folder, F.octet_length("content").cast("long").alias("length"), "mtime", F.sha2("content", 256).alias("sha256"))


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text, sha256) of all files below ``root``, the hash being that of the very bytes that the text is made of."""
    return contents(spark, root, pattern).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"))


def pages(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Whole Markdown pages with what is parsed of them: frontmatter, sections, links, references, notes."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = _below(spark, _decoded(F.col("_metadata.file_path")), root)
    return parse(raw.select(path.alias("path"), F.col("value").alias("text")))


def parse(raw: DataFrame) -> DataFrame:
    """Adds frontmatter, sections, wikilinks, references and notes to (path, text)."""
    text = F.coalesce("text", F.lit(""))
    return raw.select(
        "path", "text", T.frontmatter(text).alias("frontmatter"), T.sections(text).alias("sections"), T.wikilinks(text).alias("links"),
        T.wikilinks(F.coalesce(T.section(text, "References"), F.lit(""))).alias("references"), T.section(text, "Notes").alias("notes"),
    )


def collections(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """All collections in one table with a ``collection`` column to prune by."""
    frames = [pages(spark, root).withColumn("collection", F.lit(name)) for name, root in roots.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Entities or edges kept as JSON, one array or one object a file."""
    return spark.read.json(path, multiLine=True)


def tag_policy(spark: SparkSession, path: str) -> DataFrame:
    """(tag, color) from the rows of a Markdown table ``| tag | #rrggbb |``."""
    lines = spark.read.text(path)
    pattern = r"^\|\s*([^|\s][^|]*?)\s*\|\s*`?(#[0-9a-fA-F]{6})`?\s*\|"
    return lines.filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("tag"), F.lower(F.regexp_extract("value", pattern, 2)).alias("color"))


def graph_settings(spark: SparkSession, path: str) -> DataFrame:
    """(query, color, rest): color groups of a graph settings file; ``rest`` keeps the whole file as it was."""
    raw = spark.read.text(path, wholetext=True)
    groups = F.from_json(F.get_json_object("value", "$.colorGroups"), "array<struct<query:string,color:struct<a:int,rgb:long>>>")
    return raw.select(F.explode(groups).alias("g"), F.col("value").alias("rest")).select("g.query", F.concat(F.lit("#"), F.lpad(F.lower(F.hex("g.color.rgb")), 6, "0")).alias("color"), "rest")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(heading, target) of the links of a master catalog, under the section they stand in."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(T.sections(F.col("value"))).alias("s")).select(F.col("s.heading").alias("heading"), F.explode(T.wikilinks(F.col("s.body"))).alias("target"))


def images(spark: SparkSession, root: str, describe=None) -> DataFrame:
    """Path, length and hash of images; ``describe`` is a column function of the bytes for an extractor, if there is one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,gif,webp}").load(root)
    text = describe(F.col("content")) if describe else F.lit(None).cast("string")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), text.alias("description"))
