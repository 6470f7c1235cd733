"""Lexical, vector and hybrid retrieval; every search is a bounded top-k for each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stratadoc.functions import text as T
from stratadoc.functions.tables import stage

K1, B = 1.2, 0.75
RRF = 60
DIMENSIONS = 64
#: Queries, and terms of queries, sent to every task at a time; postings of pages.
QUERY_VECTORS, QUERY_TERMS, POSTINGS = 10_000, 5_000_000, 2_000_000
#: Length of each of the two lists that a hybrid search fuses.
FIRST = 50
#: Scores of sources and pages held at a time.
CELLS = 4_000_000


def top(scored: DataFrame, query: str, doc: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, ties by id; Spark cuts each partition to k before the shuffle."""
    order = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all elements of a column of lists."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the hashed dimensions of a batch of texts, and their norms (1 of empty ones)."""
    row, dim = _lists(column)
    out = np.bincount(row * DIMENSIONS + dim, minlength=len(column) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float64)
    norm = np.sqrt((out * out).sum(1))
    return out, np.where(norm > 0, norm, 1.0)


def _given(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they are, and their norms."""
    out = _lists(column)[1].astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return out, np.maximum(np.linalg.norm(out, axis=1), 1e-300)


class _Best:
    """The k best rows of each query so far: scores, and the ids that go with them."""

    def __init__(self, queries: int, k: int):
        self.k, self.step = k, max(16, CELLS // max(1, queries) - k)
        self.score = np.full((queries, k), -np.inf)
        self.who = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of each query (rows) and id (columns); those of -inf do not count, ties go to the smaller id."""
        scores, ids = np.concatenate([self.score, scores], 1), np.concatenate([self.who, np.broadcast_to(ids, scores.shape)], 1)
        at = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.score, self.who = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)

    def batch(self, queries: np.ndarray, schema: pa.Schema):
        q, r = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(self.who[q, r]), pa.array(self.score[q, r])], schema=schema)


def _closest(shipped, k: int, vectors_of, least: float, same: bool, schema: pa.Schema):
    def run(batches):
        """Of a task's rows the k closest to each query, which alone leave it."""
        ids, vectors, norms = shipped.value
        best = _Best(len(ids), k)
        for whole in batches:
            for a in range(0, len(whole), best.step):
                batch = whole.slice(a, best.step)
                own, norm = vectors_of(batch.column(1))
                doc = batch.column(0).to_numpy(zero_copy_only=False)
                cosines = np.round((vectors @ own.T) / norm[None] / norms[:, None], 6)
                cosines[cosines <= least] = -np.inf
                if not same:
                    cosines[ids[:, None] == doc[None]] = -np.inf
                best.add(cosines, doc)
        yield best.batch(ids, schema)

    return run


def _counted(shipped):
    def run(batches):
        """Of each text the query terms it has, as their numbers, how often, and its length in tokens."""
        keys = shipped.value
        for batch in batches:
            row, term = _lists(batch.column("terms"))
            at = np.minimum(np.searchsorted(keys, term), max(len(keys) - 1, 0))
            hit = keys[at] == term if len(keys) else np.zeros(len(term), bool)
            cell, tf = np.unique(row[hit] * max(len(keys), 1) + at[hit], return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(batch) + 1) * max(len(keys), 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % max(len(keys), 1), tf)]
            lengths = pa.array(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, lengths], names=[batch.schema.names[0], "keys", "tfs", "dl"])

    return run


def _weighed(shipped, k: int, schema: pa.Schema):
    def run(batches):
        """Of a task's texts the k best of each query by BM25."""
        ids, start, count, asking, idf, mean = shipped.value
        best = _Best(len(ids), k)
        for whole in batches:
            for a in range(0, len(whole), best.step):
                batch = whole.slice(a, best.step)
                row, key = _lists(batch.column("keys"))
                tf, dl = _lists(batch.column("tfs"))[1].astype(np.float64), batch.column("dl").to_numpy()[row]
                weight = idf[key] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)))
                n = count[key]
                at = np.repeat(start[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = asking[at] * len(batch) + np.repeat(row, n)
                score = np.round(np.bincount(cell, np.repeat(weight, n), len(ids) * len(batch)).reshape(len(ids), len(batch)), 4)
                best.add(np.where(score > 0, score, -np.inf), batch.column(0).to_numpy(zero_copy_only=False))
        yield best.batch(ids, schema)

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, doc, score, rank): the k best of all texts for each query. Ids are whole numbers.

    One scan counts the terms of the queries in each text, and nothing else of it
    goes on; the second reads these counts, and only a task's k best of each
    query leave it. Queries are sent to the tasks in blocks of at most
    QUERY_VECTORS and about QUERY_TERMS of their terms.
    """
    spark = docs.sparkSession
    hashes = F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("terms")
    asked = stage(queries.filter(F.col(query).isNotNull()).select(F.col(query).cast("long").alias(query), F.array_distinct(hashes).alias("terms")), "query-terms")
    n, total = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // QUERY_VECTORS), -(-(total or 0) // QUERY_TERMS))
    sql = f"{query} long, {doc} long, score double"
    schema = to_arrow_schema(spark.createDataFrame([], sql).schema)
    texts = docs.select(F.col(doc).cast("long").alias(doc), hashes)
    out = None
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids = mine.column(0).to_numpy()
        row, term = _lists(pa.concat_arrays(mine.column(1).chunks)) if len(ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, at = np.unique(term, return_inverse=True)
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=len(keys))
        counted = stage(texts.mapInArrow(_counted(spark.sparkContext.broadcast(keys)), f"{doc} long, keys array<int>, tfs array<int>, dl int"), "term-counts")
        size, tokens = counted.agg(F.count("*"), F.sum("dl")).first()
        found = counted.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df")).toArrow()  # a row a query term
        df = np.zeros(len(keys))
        df[found["key"].to_numpy()] = found["df"].to_numpy()
        idf = np.log(1 + (size - df + 0.5) / (df + 0.5))
        shipped = spark.sparkContext.broadcast((ids, np.cumsum(count) - count, count, row[order], idf, (tokens or 1) / max(size, 1)))
        part = counted.filter(F.col(doc).isNotNull() & (F.size("keys") > 0)).mapInArrow(_weighed(shipped, k, schema), sql)
        out = part if out is None else out.unionByName(part)
    return top(out, query, doc, k)


def _searched(rows: DataFrame, queries: DataFrame, names: tuple[str, str, str], k: int, vectors_of, least: float, same: bool) -> DataFrame:
    """(query, row, cosine, rank) of (id, vector) rows: they are scanned once for QUERY_VECTORS queries, which are sent to every task."""
    spark = rows.sparkSession
    sql = f"{names[0]} long, {names[1]} long, {names[2]} double"
    schema = to_arrow_schema(spark.createDataFrame([], sql).schema)
    wanted = stage(queries, "query-vectors")
    n = -(-wanted.count() // QUERY_VECTORS) or 1
    out = None
    for part in range(n):
        mine = wanted.filter(F.pmod(F.xxhash64(wanted.columns[0]), F.lit(n)) == part).toArrow().combine_chunks()  # about QUERY_VECTORS rows
        ids = mine.column(0).to_numpy()
        column = pa.concat_arrays(mine.column(1).chunks) if len(ids) else pa.array([], mine.schema.field(1).type)
        shipped = spark.sparkContext.broadcast((ids, *vectors_of(column)))
        found = rows.mapInArrow(_closest(shipped, k, vectors_of, least, same, schema), sql)
        out = found if out is None else out.unionByName(found)
    return top(out, names[0], names[1], k, names[2])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): the k other vectors that are closest to each query by cosine, compared with all.

    Only a task's k best of each query leave it. Rows without a vector take no part.
    """
    own = lambda d: d.filter("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return _searched(own(vectors), own(queries), ("query_id", "vec_id", "score"), k, _given, -2.0, False)


def hashed(docs: DataFrame, key: str) -> DataFrame:
    """(key, dim, w): term counts hashed to DIMENSIONS; the default embedding where no model is plugged in."""
    dims = docs.select(key, F.explode(T.tokens(F.col("text"))).alias("term")).select(key, T.dimension(F.col("term")).cast("long").alias("dim"))
    return dims.groupBy(key, "dim").agg(F.count("*").cast("double").alias("w"))


def dims() -> Column:
    """The hashed dimension of every token of ``text``: what a task makes a vector of."""
    return F.transform(T.tokens(F.col("text")), T.dimension).alias("dims")


def closest(docs: DataFrame, queries: DataFrame, first: int, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, doc, cosine, rank): the ``first`` texts of all that are closest to each query by hashed vectors. Ids are whole numbers."""
    own = lambda d, key: d.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), dims())
    return _searched(own(docs, doc), own(queries, query), (query, doc, "cosine"), first, _hashed, 0.0, True)


class Index:
    """Terms, weights and vectors of a block of pages, by which a task scores its sources."""

    def __init__(self, pages: pa.Table, postings: pa.Table, page: str):
        self.ids = pages[page].combine_chunks()
        order = np.asarray(pa.compute.array_sort_indices(self.ids))
        self.ids = self.ids.take(pa.array(order))
        place = {x: i for i, x in enumerate(self.ids.to_pylist())}
        term, at = postings["term"].to_numpy(), np.array([place[x] for x in postings[page].to_pylist()], np.int64)
        by = np.argsort(term, kind="stable")
        self.keys, start, count = np.unique(term[by], return_index=True, return_counts=True)
        self.start, self.count, self.pages = start, count, at[by]
        self.idf = postings["idf"].to_numpy()[by][start] if len(by) else np.zeros(0)
        self.vectors, self.norms = _hashed(pages["dims"].combine_chunks().take(pa.array(order)))

    def scores(self, batch) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the idf of shared terms, and cosines, of each source and page."""
        n, width = len(batch), len(self.ids)
        row, term = _lists(batch.column("terms"))
        score = np.zeros((n, width))
        if len(self.keys) and len(term):
            at = np.minimum(np.searchsorted(self.keys, term), len(self.keys) - 1)
            hit = self.keys[at] == term
            row, at = row[hit], at[hit]
            count = self.count[at]
            place = np.repeat(self.start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            cell = np.repeat(row, count) * width + self.pages[place]
            score = np.round(np.bincount(cell, np.repeat(self.idf[at], count), n * width).reshape(n, width), 4)
        own, norm = _hashed(batch.column("dims"))
        return score, np.round((own @ self.vectors.T) / norm[:, None] / self.norms[None], 6)


def _ranked(values: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank) of the ``first`` largest positive values of each row, ties by column."""
    best = np.argsort(-values, axis=1, kind="stable")[:, :first]
    row, rank = np.indices(best.shape)
    on = np.take_along_axis(values, best, 1) > 0
    return row[on], best[on], rank[on] + 1


def _matched(shipped, first: int, k: int | None, schema: pa.Schema):
    def run(batches):
        index = shipped.value
        step = max(1, CELLS // max(1, len(index.ids)))
        for whole in batches:
            for a in range(0, len(whole), step):
                batch = whole.slice(a, step)
                score, cosine = index.scores(batch)
                fused = np.zeros(score.shape)
                for values in (score, cosine):
                    row, col, rank = _ranked(values, first)
                    fused[row, col] += 1 / (RRF + rank)
                fused = np.round(fused, 8)
                row, col, rank = _ranked(fused, k or 2 * first)
                columns = [batch.column(0).take(pa.array(row)), index.ids.take(pa.array(col)), score[row, col], cosine[row, col], fused[row, col], rank]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def matched(sources: DataFrame, pages: DataFrame, k: int, first: int = FIRST, source: str = "doc_id", page: str = "item_id") -> DataFrame:
    """(source, page, score, cosine, fused, rank): the k pages that fit each of many sources best.

    ``score`` sums the idf of all terms that both have, ``cosine`` compares their
    hashed vectors; the ``first`` pages of either list are fused by their ranks.
    The pages' index is sent to the tasks in blocks of about POSTINGS postings,
    so the sources are scanned once a block and, with one block, never shuffled.
    """
    spark = sources.sparkSession
    read = stage(pages.select(page, F.array_distinct(F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t))).alias("terms"), dims()), "page-terms")
    each = read.select(page, F.explode("terms").alias("term"))
    n, total = read.count(), read.agg(F.sum(F.size("terms"))).first()[0] or 0
    idf = each.groupBy("term").agg(F.log(1 + F.lit(n) / F.count("*")).alias("idf"))
    postings = each.join(idf, "term")
    blocks = max(1, -(-total // POSTINGS))
    types = {c: d.schema[c].dataType.simpleString() for d, c in ((sources, source), (pages, page))}
    sql = f"{source} {types[source]}, {page} {types[page]}, score double, cosine double, fused double, rank int"
    schema = to_arrow_schema(spark.createDataFrame([], sql).schema)
    rows = sources.select(source, F.array_distinct(F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t))).alias("terms"), dims())
    out = None
    for b in range(blocks):
        mine = F.pmod(F.xxhash64(page), F.lit(blocks)) == b
        index = Index(read.filter(mine).select(page, "dims").toArrow(), postings.filter(mine).toArrow(), page)
        part = rows.mapInArrow(_matched(spark.sparkContext.broadcast(index), first, k if blocks == 1 else None, schema), sql)
        out = part if out is None else out.unionByName(part)
    if blocks == 1:
        return out
    # Each block gave its best by either list; the lists of all pages are made of these.
    place = lambda c: F.row_number().over(W.partitionBy(source).orderBy(F.col(c).desc(), page))
    share = lambda c, r: F.when((F.col(c) > 0) & (F.col(r) <= first), 1 / (RRF + F.col(r))).otherwise(0.0)
    lists = out.withColumn("r1", place("score")).withColumn("r2", place("cosine"))
    fused = lists.withColumn("fused", F.round(share("score", "r1") + share("cosine", "r2"), 8)).filter("fused > 0")
    return top(fused.select(source, page, "score", "cosine", "fused"), source, page, k, "fused")


def embedded(docs: DataFrame, key: str, model=None) -> DataFrame:
    """(key, dim, w) of each text; ``model`` is a column function from a text to an array of numbers, if there is one.

    Only dimensions that are not 0 are kept, as with the default.
    """
    if model is None:
        return hashed(docs, key)
    dims = docs.select(key, F.posexplode(model(F.coalesce("text", F.lit(""))))).select(key, F.col("pos").cast("long").alias("dim"), F.col("col").cast("double").alias("w"))
    return dims.filter("w <> 0")


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 5, first: int = FIRST, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, doc, score, rank): the ``first`` documents by terms and the ``first`` by hashed vectors, each of all, fused by their ranks."""
    by_terms = bm25(docs, queries, first, doc, query).select(query, doc, F.col("rank").alias("r1"))
    by_vectors = closest(docs, queries, first, doc, query).select(query, doc, F.col("rank").alias("r2"))
    share = lambda r: F.coalesce(1 / (RRF + F.col(r)), F.lit(0.0))
    fused = by_terms.join(by_vectors, [query, doc], "full").select(query, doc, F.round(share("r1") + share("r2"), 8).alias("score"))
    return top(fused, query, doc, k)


def in_collections(pages: DataFrame, names: list[str]) -> DataFrame:
    """A filter on the partition column, so other collections are not read."""
    return pages.filter(F.col("collection").isin(names))


def index_status(collections: DataFrame) -> DataFrame:
    return collections.groupBy("collection").agg(F.count("*").alias("n_items"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def stale(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Sources whose hash is not the indexed one: what has to be embedded again."""
    i = indexed.select(F.col("path").alias("at"), F.col("sha256").alias("indexed"))
    return current.join(i, (current["path"] == i["at"]) & (current["sha256"] == i["indexed"]), "left_anti")


def answer(questions: DataFrame, catalog: DataFrame, raw: DataFrame, claims: DataFrame, k: int = 5, query: str = "item_id") -> DataFrame:
    """(query, doc_id, score, rank, tier): evidence from the catalog's pages, and from the raw sources where these do not do.

    ``questions`` has needs_precision, ``catalog`` confidence, ``claims`` what pages
    say of an attribute. The raw sources are read for questions without a page
    and for those that ``fallback`` marks.
    """
    tier1 = stage(bm25(catalog, questions, k, query=query), "tier")
    sure = catalog.select("doc_id", "confidence").distinct()
    found = tier1.join(sure, "doc_id").join(questions.select(query, "needs_precision"), query)
    enough = fallback(found, claims, query, "doc_id").filter("not raw").select(query)
    tier2 = bm25(raw, questions.join(enough, query, "left_anti"), k, query=query)
    return tier1.withColumn("tier", F.lit("catalog")).unionByName(tier2.withColumn("tier", F.lit("raw")))


def fallback(found: DataFrame, claims: DataFrame, query: str = "doc_id", page: str = "item_id") -> DataFrame:
    """(query, low, imprecise, contradicting, raw): whether the raw sources have to be read for a question, and why.

    ``found`` has query, page, rank, confidence and needs_precision; ``claims``
    has page, attribute and value. Raw sources are read if the best page's
    confidence is low, if the question needs more precision, or if two of the
    pages found differ in the value of an attribute.
    """
    per = found.groupBy(query).agg(
        F.coalesce(F.bool_or((F.col("rank") == 1) & (F.col("confidence") == "low")), F.lit(False)).alias("low"),
        F.coalesce(F.bool_or("needs_precision"), F.lit(False)).alias("imprecise"),
    )
    differ = (
        found.select(query, page).join(claims.filter("value is not null").select(page, "attribute", "value"), page)
        .groupBy(query, "attribute").agg((F.min("value") < F.max("value")).alias("differs"))
        .groupBy(query).agg(F.bool_or("differs").alias("contradicting"))
    )
    out = per.join(differ, query, "left").withColumn("contradicting", F.coalesce("contradicting", F.lit(False)))
    return out.withColumn("raw", F.col("low") | F.col("imprecise") | F.col("contradicting"))


def referenced(pages: DataFrame, references: DataFrame, sources: DataFrame) -> DataFrame:
    """(page, path, sha256): the sources behind pages of low confidence, by the pages' own references."""
    low = pages.filter("confidence = 'low'").select("page")
    return references.select("page", "path").distinct().join(low, "page", "left_semi").join(sources.select("path", "sha256"), "path").select("page", "path", "sha256")
