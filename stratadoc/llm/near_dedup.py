r"""Near-duplicate detection by ProbMinHash, banding and verification.

A text is its set of shingles of five words, each weighted 1 + ln(occurrences).
Each shingle is a Poisson process whose rate is its weight: its arrivals come at
exponentially distributed distances, each at a random register, and a register
keeps the shingle of its earliest arrival. A process ends as soon as its next
arrival is later than all registers of the text. Two registers agree with the
probability Jaccard similarity of the weighted shingles. That can be far below
the Jaccard similarity of the shingle sets where shingles repeat, so a text with
repeated shingles has a second signature, with all weights 1, whose registers
agree with the similarity of the sets. Texts without have one, as both are equal.

``BANDS`` bands of ``ROWS`` registers of each signature give candidate buckets: a
pair of sets at 0.8 is in no common bucket with probability at most
(1 - 0.8^6)^28 = 2e-4. Candidates are verified
exactly: documents are linked if the Jaccard similarity of their shingle sets is
0.8 or more. Classes are the connected components of the links.

Equal texts (the same words) are one node, so large groups of copies cost one
row. A bucket's members are compared with its pivot, its smallest node, and not
with each other. Where that leaves the members of a bucket in several classes,
the members of all such buckets with one pivot are compared in blocks: each task
gets two blocks of at most about ``BLOCK`` texts and ``BLOCK_CHARS`` characters
(one text at least), counts all their common shingles by a matrix product, and
returns a spanning forest of the links it finds. So no link
within a bucket is lost, pairs are never rows, and no task holds a group.

Defined results: a text of one to four words is one shingle of all its words;
null and empty texts have no shingles and are equal to each other; rows that
repeat an id are one document: each of its texts is compared, and all are in one
class; rows without an id are found only as copies of equal texts, and a class
of these alone has no id; an empty table gives an empty result; other columns are ignored, and carried
through by ``representatives``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm._shared import SPACE, bound_batches, chunks, discard, stage, table, task, with_hot
from stratadoc.operators.graph import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
#: Characters of text worked on together.
CHUNK = 1 << 20
#: Texts in a block and their characters, about, and columns of a block's matrix.
BLOCK, BLOCK_CHARS, COLUMNS = 128, 1 << 24, 8192
#: Pairs with one pivot that are joined to one copy of its text.
PAIRS = 2000
#: Ids of candidates are broadcast up to this many (of 8 bytes); beyond it they are joined.
BROADCAST_IDS = 2_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(each: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, hash and weight of each distinct shingle."""
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number)) for words in each for w in words]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))[np.array(flat)]
    lengths = np.array([len(w) for w in each])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    count = np.where(lengths >= WORDS, lengths - WORDS + 1, (lengths > 0).astype(np.int64))
    text = np.repeat(np.arange(len(each)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    size = np.minimum(lengths, WORDS)[text]
    padded = np.concatenate([hashed, np.zeros(WORDS, np.uint64)])
    h = np.zeros(len(text), np.uint64)
    for k in range(WORDS):
        h = np.where(k < size, _mix(h * _A + padded[at + k]), h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
    times = np.diff(np.append(new, len(h)))
    return text[new], h[new], 1 + np.log(times)


def signatures(n: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures of n texts; rows of texts without shingles are 0."""
    earliest = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    x = np.zeros(len(h))
    round_ = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(h):
            round_ += np.uint64(1)
            r = _mix(h + round_ * _A)
            x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
            register = ((_mix(r ^ _C) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            at = text * registers + register
            np.minimum.at(earliest, at, x)
            won = x == earliest[at]
            kept[at[won]] = h[won]
            limit = earliest.reshape(n, registers).max(1)
            on = x < limit[text]
            text, h, weight, x = text[on], h[on], weight[on], x[on]
    return kept.reshape(n, registers)


def buckets(signature: np.ndarray) -> np.ndarray:
    """The bucket of each band, which also tells the band."""
    h = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = _mix(h * _A + signature[:, k::ROWS][:, :BANDS])
        h = _mix(h + np.arange(BANDS, dtype=np.uint64) * _B)
    return h.view(np.int64)


def candidate_buckets(n: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of each text the buckets of its weighted signature, and of the one without weights where that differs."""
    out = list(buckets(signatures(n, text, h, weight)))
    repeats = np.unique(text[weight > 1])
    if len(repeats):
        own = np.isin(text, repeats)
        plain = buckets(signatures(len(repeats), np.searchsorted(repeats, text[own]), h[own], np.ones(own.sum())))
        for i, row in zip(repeats, plain):
            out[i] = np.union1d(out[i], row)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])


@task("near_dedup")
def _sign(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        keys, bands = [], []
        for a, b in chunks(texts, CHUNK):
            each = [t.encode().split() for t in texts[a:b]]
            keys += [hashlib.md5(b" ".join(w)).digest() for w in each]
            with np.errstate(over="ignore"):
                text, h, weight = shingles(each)
            found = candidate_buckets(len(each), text, h, weight)
            bands += [row.tolist() if w else [] for row, w in zip(found, each)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED)


def shingle_set(text: str) -> set[tuple]:
    words = text.encode().split()
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(WORDS)]))


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


@task("near_dedup")
def _verify(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    last, held = None, set()
    for batch in batches:
        out = []
        for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            if b is not last and b != last:
                last, held = b, shingle_set(b)
            out.append(jaccard(shingle_set(a), held))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], schema=schema)


def verified(pairs: DataFrame, texts: DataFrame, used: list[str]) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b), by their whole texts; a pivot ``b`` of many pairs gets a copy of its text for every PAIRS of them."""
    counts = stage(pairs.groupBy("b").agg(F.count("*").alias("n")), "near-pivots", used)
    copies = F.expr(f"(n - 1) div {PAIRS} + 1")
    dealt = with_hot(pairs, counts, "b", "n").select("a", "b", F.pmod(F.xxhash64("a"), copies).alias("copy"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(counts, "b").select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    left = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(right, ["b", "copy"])
    return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long, similarity double"), "near-verified", used)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("node").alias("of"), "label")
    return members.join(own, members["node"] == own["of"], "left").drop("of").withColumn("label", F.coalesce("label", "node"))


def _unresolved(labelled: DataFrame, used: list[str]) -> DataFrame:
    """(pivot, node, label) of the buckets of three and more whose members are in several classes."""
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("n > 2 and x < y")
    mixed = stage(mixed.select("bucket", "n"), "near-mixed", used)
    return stage(with_hot(labelled, mixed, "bucket", "n").groupBy("pivot", "node").agg(F.min("label").alias("label")), "near-unresolved", used)


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` and each of ``b`` have in common; sets are arrays of distinct numbers."""
    out = np.zeros((len(a), len(b)))
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    keep_a, keep_b = np.isin(left, both), np.isin(right, both)
    row_a, row_b = row_a[keep_a], row_b[keep_b]
    col_a, col_b = np.searchsorted(both, left[keep_a]), np.searchsorted(both, right[keep_b])
    for k in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - k)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        on_a, on_b = (col_a >= k) & (col_a < k + width), (col_b >= k) & (col_b < k + width)
        x[row_a[on_a], col_a[on_a] - k] = 1
        y[row_b[on_b], col_b[on_b] - k] = 1
        out += x @ y.T
    return out


def _compare_blocks(frame):
    """Links between different classes in two blocks of texts, of which only a spanning forest is returned."""
    texts = frame["text"].tolist()
    with np.errstate(over="ignore"):
        text, h, _ = shingles([t.encode().split() for t in texts])
    sets = np.split(h, np.searchsorted(text, np.arange(1, len(texts))))
    one, two = int(frame["one"].iloc[0]), int(frame["two"].iloc[0])
    block = frame["block"].to_numpy()
    rows, cols = np.flatnonzero(block == one), np.flatnonzero(block == two)
    links = []
    if len(rows) and len(cols):
        both = common([sets[i] for i in rows], [sets[i] for i in cols])
        size = np.array([len(x) for x in sets])
        union = size[rows][:, None] + size[cols][None] - both
        label = frame["label"].to_numpy()
        near = (both >= 1) & (both / np.maximum(union, 1) >= SIMILARITY) & (label[rows][:, None] != label[cols][None])
        up: dict = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        node = frame["node"].to_numpy()
        for i, j in zip(*np.nonzero(near)):
            x, y = root(label[rows[i]]), root(label[cols[j]])
            if x != y:
                up[x] = y
                links.append((int(node[rows[i]]), int(node[cols[j]])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def compared_in_blocks(members: DataFrame, texts: DataFrame, used: list[str]) -> DataFrame:
    """Links (a, b) between different classes among (pivot, node, label), of nodes with the same pivot."""
    lengths = texts.select("node", F.length("text").alias("chars")).groupBy("node").agg(F.max("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int")
    sizes = stage(members.join(lengths, "node").groupBy("pivot").agg(blocks.alias("blocks")), "near-group-sizes", used)
    dealt = members.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pair = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, block) as one, greatest(k, block) as two))")
    rows = dealt.select("pivot", "node", "label", "block", F.explode(pair).alias("p")).select("pivot", "node", "label", "block", "p.one", "p.two")
    with_text = rows.join(texts.dropDuplicates(["node"]), "node")
    return stage(with_text.groupBy("pivot", "one", "two").applyInPandas(_compare_blocks, "a long, b long"), "near-block-links", used)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), class_size, kept.

    ``class_size`` counts the class's rows; ``kept`` marks the row with the class's id.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark, used = docs.sparkSession, []
    bound_batches(spark)
    signed = stage(docs.mapInArrow(_sign, "doc_id long, key binary, bands array<long>"), "near-signed")
    # Ids with several texts: their nodes are numbered by the text, and linked.
    several = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y")
    several = stage(several.select("doc_id"), "near-several", used)
    any_several = bool(several.head(1))
    base = signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    number = F.coalesce("least", F.xxhash64("key"))
    if any_several:
        base = base.join(several.select(F.col("doc_id").alias("least"), F.lit(True).alias("shared")), "least", "left")
        number = F.when(F.col("shared"), F.xxhash64("key")).otherwise(number)
    nodes = stage(base.select("key", number.alias("node"), "least", "rows", "bands"), "near-nodes", used)
    each = nodes.filter("least is not null").select("node", F.explode("bands").alias("bucket"))
    shared = stage(each.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "near-buckets", used)
    members = stage(with_hot(each, shared, "bucket", "n").select("bucket", "node", "pivot"), "near-members", used)
    ids = members.select("node").distinct()
    if any_several:
        ids = ids.join(nodes.select("node", "key", F.col("least").alias("doc_id")), "node")
    else:
        ids = ids.select("node", F.col("node").alias("doc_id"))
    ids = stage(ids, "near-candidates", used)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id")
    if any_several:
        words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
        texts = texts.filter(F.unhex(F.md5(F.array_join(words, " "))) == F.col("key"))
    texts = stage(texts.select("node", "text"), "near-texts", used)
    pairs = stage(members.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "near-pairs", used)
    links = verified(pairs, texts, used).filter(F.col("similarity") >= SIMILARITY).select("a", "b")
    if any_several:
        own = signed.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(nodes.select("key", "node"), "key")
        first = own.groupBy("doc_id").agg(F.min("node").alias("b"))
        links = stage(links.unionByName(own.join(first, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")), "near-all-links", used)
    labels = components(links)
    rest = _unresolved(stage(_labelled(members, labels), "near-labelled", used), used)
    if rest.head(1):
        links = links.unionByName(compared_in_blocks(rest, texts, used))
        labels = components(links)
    placed = nodes.select("key", "node", "least", "rows").join(labels.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    placed = stage(placed.select("key", "least", "rows", F.coalesce("label", "node").alias("label")), "near-placed", used)
    sizes = placed.groupBy("label").agg(F.sum("rows").alias("class_size"), F.min("least").alias("class_id"), F.count("*").alias("n"))
    sizes = stage(sizes, "near-sizes", used)
    by_key = stage(with_hot(placed, sizes, "label", "n").select("key", "rows", "class_id", "class_size"), "near-classes")
    discard(spark, used)
    return with_hot(signed.select("doc_id", "key"), by_key, "key", "rows").select("doc_id", "class_id", "class_size", F.expr("doc_id <=> class_id").alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, all columns as they were.

    Rows that repeat the kept id all stay, as do rows without an id (in the
    pipeline the exact stage has left one row of each text).
    """
    found = stage(classes(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__dropped")).distinct(), "near-dropped")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drop = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    kept = row.join(drop, row["row.doc_id"] == drop["__dropped"], "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_probminhash(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
