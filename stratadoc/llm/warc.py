r"""WARC fixity audit with Merkle trees.

Every record of a replica is hashed; records stand in archives in the order of
their offsets, and runs of ``FAN`` neighbours are hashed together, level by level,
up to one root for all archives. Two replicas with the same root are the same.
Otherwise only the children of nodes that differ are compared, so a fault is
found in as many steps as the tree has levels, however large the replica is.

``catalog`` lays out a table of pages as records: which archive, which offset.
``write_archives`` writes records as gzipped WARC files; ``read_archives`` reads
any, plain or with one or more records in a gzip member, in one pass that holds
one record at a time.

Defined results: nulls count as empty text; a page without an id comes last in
its archive; rows that are equal in all columns are records of their own, each
with its place; an empty table gives an empty audit; records that a replica has
and the catalog has not are ``extra`` and have no place; other columns are
ignored. What is no record in a file (other bytes, a record without a length, a
record or a gzip member that ends too early) is a row with an ``error`` and the
hash of its bytes, and reading goes on at the next record or member. A file is
one row of the scan, so it has at most 2 GB; a larger one fails the job.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratadoc.llm._shared import ARROW_BYTES, bound_batches, discard, shared_dir, stage, table, task

#: Children of a node, records in an archive on average, and places in it (FAN**3: its tree has three levels).
FAN, RECORDS, PLACES = 16, 512, 4096
#: The simulated replica of the query: one record in so many is damaged, one in so many is lost.
DAMAGED, LOST = 1009, 3001


def catalog(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """(page_id, url, archive, place, start, length, hash): pages as records of archives.

    Pages are dealt to archives by a hash of their id and address, so that none
    grows with the table, and stand in it by id. An archive that gets more than
    PLACES records continues in places after the last archive's.
    """
    n = max(1, -(-pages.count() // records))
    key = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("url", F.lit(""))))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", record().alias("record"),
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n).alias("archive"),
    ).select("page_id", "url", "archive", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    order = W.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "hash")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    placed = rows.select("*", (F.row_number().over(order) - 1).cast("long").alias("at"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("place", F.expr(f"((at div {PLACES}) * {n} + archive) * {PLACES} + at % {PLACES}")).drop("at")


def record_id(column: str = "page_id"):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def record(end: bool = True):
    """A page (page_id, url, html) as a response record, with or without the two empty lines after it."""
    body = F.coalesce(F.col("html"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nWARC-Record-ID: "), record_id(),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n" if end else ""),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files of at most PLACES records."""
    pages.select(record(False)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", PLACES).option("compression", "gzip").text(path)


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The levels of a tree over (replica, node, hash), leaves first; ``node`` is the place at level 0."""
    out = [leaves]
    for _ in range(levels):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", (c["node"] % FAN).cast("string"), c["hash"])), ",")
        up = out[-1].groupBy("replica", F.expr(f"node div {FAN}").alias("up")).agg(joined.alias("all"))
        out.append(stage(up.select("replica", F.col("up").alias("node"), F.sha2("all", 256).alias("hash")), "warc-level"))
    return out


def mismatching(levels: list[DataFrame], first: str = "a", second: str = "b") -> DataFrame:
    """(node, hash_a, hash_b) of the leaves that differ, by descent from the roots."""
    suspects = None
    for level in reversed(levels):
        if suspects is not None:
            level = level.withColumn("up", F.expr(f"node div {FAN}")).join(suspects, "up", "left_semi")
        a = level.filter(F.col("replica") == first).select(F.col("node").alias("node_a"), F.col("hash").alias("hash_a"))
        b = level.filter(F.col("replica") == second).select(F.col("node").alias("node_b"), F.col("hash").alias("hash_b"))
        differ = a.join(b, a["node_a"] == b["node_b"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        differ = stage(differ.select(F.coalesce("node_a", "node_b").alias("node"), "hash_a", "hash_b"), "warc-differ")
        suspects = differ.select(F.col("node").alias("up"))
    return differ


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """The catalog ``original`` with each record's status in ``replica`` (place, hash and, if it has one, uri).

    The status is ok, damaged or lost, or extra for rows whose place is null or not in the catalog.
    """
    uri = F.col("uri") if "uri" in replica.columns else F.lit(None).cast("string")
    replica = stage(replica.select("place", "hash", uri.alias("uri")), "warc-replica")
    places = original.select("place")
    extra = replica.join(places, "place", "left_anti")
    replica = replica.join(places, "place", "left_semi")
    last = original.agg(F.max("place")).first()[0]
    depth = 1
    while last is not None and last >= FAN**depth:
        depth += 1
    leaves = original.select(F.lit("a").alias("replica"), F.col("place").alias("node"), "hash").unionByName(replica.select(F.lit("b").alias("replica"), F.col("place").alias("node"), "hash"))
    differ = mismatching(tree(stage(leaves, "warc-leaves"), depth))
    found = differ.select("node", F.when(F.col("hash_b").isNull(), "lost").otherwise("damaged").alias("found"), F.col("hash_b").alias("replica_hash"))
    rows = original.join(found, original["place"] == found["node"], "left")
    status = F.coalesce("found", F.lit("ok"))
    out = rows.select("page_id", "url", "archive", "start", "length", "hash", status.alias("status"), F.when(status == "ok", F.col("hash")).otherwise(F.col("replica_hash")).alias("replica_hash"))
    absent = [F.lit(None).cast(original.schema[c].dataType).alias(c) for c in ("archive", "start", "length", "hash")]
    return out.unionByName(extra.select(F.lit(None).cast("long").alias("page_id"), F.col("uri").alias("url"), *absent, F.lit("extra").alias("status"), F.col("hash").alias("replica_hash")))


def damaged(pages: DataFrame) -> DataFrame:
    """Pages of a second replica for the query: the same, some of them damaged or lost."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit("fault "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    html = F.coalesce(F.col("html"), F.lit(""))
    stored = F.when(at % DAMAGED == 0, F.concat(F.lit("#"), F.substring(html, 2, 1 << 30))).otherwise(html)
    return pages.filter(at % LOST != 1).withColumn("html", stored)


def placed_by_id(read: DataFrame, placed: DataFrame) -> DataFrame:
    """(place, hash, uri) of the records read: a record is known by its id and address, of equal ones by its number."""
    by = lambda h: W.partitionBy("record_id", "uri").orderBy(h)
    known = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = read.select(known("record_id"), known("uri"), "hash").withColumn("n", F.row_number().over(by("hash")))
    want = placed.select(record_id().alias("record_id"), F.coalesce("url", F.lit("")).alias("uri"), "place", "hash")
    want = want.withColumn("n", F.row_number().over(by("hash"))).drop("hash")
    return rows.join(want, ["record_id", "uri", "n"], "left").select("place", "hash", "uri")


def op6_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Catalogs the pages, writes a faulty replica of them as WARC files, reads these and audits what they hold."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    placed = stage(catalog(pages), "warc-pages")
    path = f"{shared_dir(spark)}/warc-files-{uuid.uuid4().hex}"
    write_archives(damaged(pages), path)
    read = stage(placed_by_id(read_archives(spark, path, blocks=False), placed), "warc-read")
    discard(spark, [path])
    return audit(placed, read)


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         cast('0x' || substr(md5(coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')), 1, 8) AS BIGINT)
           % greatest(1, (SELECT ceil(count(*) / 512.0)::BIGINT FROM pages)) AS archive,
         cast('0x' || substr(md5('fault ' || coalesce(page_id::VARCHAR, '')), 1, 8) AS BIGINT) AS fault
  FROM pages),
q AS (SELECT *, CASE WHEN fault % 1009 = 0 THEN '#' || substr(html, 2) ELSE html END AS stored FROM p),
r AS (
  SELECT *, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'Content-Length: ') AS head,
         concat(chr(13), chr(10), chr(13), chr(10)) AS gap
  FROM q),
s AS (SELECT page_id, url, archive, fault, strlen(concat(head, strlen(html), gap, html, gap))::BIGINT AS length,
             sha256(concat(head, strlen(html), gap, html, gap)) AS hash, sha256(concat(head, strlen(stored), gap, stored, gap)) AS other FROM r)
SELECT page_id, url, archive,
       coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, url, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       length, hash, CASE WHEN fault % 3001 = 1 THEN 'lost' WHEN hash <> other THEN 'damaged' ELSE 'ok' END AS status,
       CASE WHEN fault % 3001 = 1 THEN NULL ELSE other END AS replica_hash
FROM s
"""


class _Buffer:
    """Bytes from pieces, of which the front is dropped; ``at`` is the offset of what is left."""

    def __init__(self, pieces):
        self.pieces, self.bytes, self.at = iter(pieces), bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.bytes += piece
        return True

    def fill(self, n: int) -> bool:
        while len(self.bytes) < n:
            if not self.more():
                return False
        return True

    def find(self, what: bytes, start: int = 0) -> int:
        while (k := self.bytes.find(what, start)) < 0:
            start = max(start, len(self.bytes) - len(what) + 1)
            if not self.more():
                return -1
        return k

    def take(self, n: int) -> bytes:
        out = bytes(self.bytes[:n])
        del self.bytes[:n]
        self.at += n
        return out


#: Bytes read at a time.
PIECE = 1 << 18
_EMPTY = b"\r\n\r\n"


def records(pieces):
    """(offset, bytes, headers, place of the block in the bytes, error) of each record in the pieces of a stream.

    Bytes that are no record go up to the next start of one, with empty headers and an error.
    """
    data = _Buffer(pieces)
    while data.fill(1):
        if data.fill(2) and data.bytes[:2] == b"\r\n":
            data.take(2)
            continue
        at, error, headers, begin, stop = data.at, "no record", {}, 0, 0
        data.fill(5)
        if data.bytes.startswith(b"WARC/") and (end := data.find(_EMPTY)) >= 0:
            lines = data.bytes[:end].decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = headers.get("content-length", "")
            begin, error = end + 4, "no length"
            if size.isascii() and size.isdigit():
                stop = begin + int(size)
                error = None if data.fill(stop) else "truncated record"
        if error is None:
            data.fill(stop + 4)
            whole = data.take(stop + 4 if data.bytes[stop : stop + 4] == _EMPTY else stop)
            yield at, whole, headers, slice(begin, stop), None
            continue
        k = data.find(_EMPTY + b"WARC/", 1)
        yield at, data.take(len(data.bytes) if k < 0 else k + 4), {}, slice(0, 0), error


def _inflated(data, at: int, end: list):
    """Pieces of the gzip member at ``at``; ``end`` gets the offset behind it, and an error if there is one."""
    stream, pos = zlib.decompressobj(31), at
    try:
        while not stream.eof and pos < len(data):
            yield stream.decompress(data[pos : pos + PIECE])
            pos = min(pos + PIECE, len(data))
    except zlib.error as error:
        end[:] = [pos, f"damaged member: {error}"]
        return
    end[:] = [pos - len(stream.unused_data), None if stream.eof else "truncated member"]


def parse(data):
    """(start, within, bytes, headers, place of the block, error) of each record of a WARC file.

    ``start`` is the offset of the record, or of the gzip member in whose content it stands at ``within``.
    """
    view, at = memoryview(data), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        for start, *rest in records(view[k : k + PIECE] for k in range(0, len(view), PIECE)):
            yield start, 0, *rest
        return
    data = bytes(view)
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            end: list = []
            for row in records(_inflated(view, at, end)):
                yield at, *row
            if not end[1]:
                at = end[0]
                continue
            error = end[1]
        else:
            error = "no member"
        stop = data.find(b"\x1f\x8b\x08", at + 1)
        stop = len(data) if stop < 0 else stop
        yield at, 0, data[at:stop], {}, slice(0, 0), error
        at = stop


_READ = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("within", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()),
    ("hash", pa.string()), ("error", pa.string()), ("block", pa.binary()),
])
_READ_SQL = "path string, start long, within long, length long, record_id string, uri string, hash string, error string, block binary"


def _read(blocks: bool):
    @task("warc")
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for start, within, raw, headers, block, error in parse(content.as_buffer()):
                    body = raw[block] if blocks and error is None else None
                    rows.append((path, start, within, len(raw), headers.get("warc-record-id"), headers.get("warc-target-uri"), hashlib.sha256(raw).hexdigest(), error, body))
                    held += len(body or b"") + 200
                    if held > ARROW_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)

    return run


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record of the WARC files below ``path``; each file is read by one task.

    ``length`` and ``hash`` are those of the record itself, uncompressed; without ``blocks`` the contents stay behind.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(_read(blocks), _READ_SQL)
