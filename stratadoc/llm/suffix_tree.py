r"""LM scoring with a probabilistic suffix tree over bytes.

A text is read as its words (lower-cased in A-Z) with one space between, and
one end. The tree predicts each byte from the longest context before it that it
has a node for, of up to ``DEPTH`` bytes; at a text's start the context is the
end mark. Counts come from all training texts: each partition counts its
(context, next byte) windows, the sums are made by one shuffle.

A context becomes a node if it occurs ``LEAST`` times and its divergence test
passes: the information its next-byte distribution has beyond that of the next
shorter context, over all its occurrences, reaches ``DIVERGENCE`` (nats). All
suffixes of a node are nodes, as are contexts of one and two bytes that occur
``LEAST`` times. A node names every next byte it was seen with; its distribution
is smoothed by its parent's with ``MASS`` virtual counts per kind of next byte.
These are counts and not shares, so the tree grows with the corpus.

The tree is never gathered: windows are dealt out by the ``SHARD`` bytes before
the predicted one, which they share with all suffixes of two bytes and more that
their nodes have. Only the counts of windows of three bytes, at most 256^3, are
sent to every task. Each task gives its windows, those of texts held out too, their log
probabilities. Windows of at least ``P_HEAD`` of all, so at most 1/P_HEAD, are
broadcast with theirs; the others are joined to theirs.

Beside it stands the base score by the words' own frequencies. Words that are
rarer than ``P_WORD`` are joined to their counts; the others, at most 1/P_WORD,
are broadcast.

Training texts are those whose crc32(doc_id as text) mod 10 is not 0. Defined
results: null and empty texts are one end alone; rows that repeat an id and a
text are alike and each get their row; without training texts all counts are 0,
the base is log10(0.1/0.1) = 0 a token, and all bytes are equally likely; columns
beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm._shared import bound_batches, chunks, stage, table, task

FOLDS = 10
DEPTH = 5
SHARD = 3
LEAST, DIVERGENCE, MASS = 2, 5.0, 0.5
P_WORD, P_HEAD = 5e-7, 2e-7
END = b"\n"
#: Characters read together; distinct words and windows that a task holds before it hands them on.
CHUNK, MOST_WORDS, MOST_WINDOWS = 1 << 21, 500_000, 3_000_000


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only, and splits at the six ASCII space characters only, as bytes do."""
    return (text or "").encode().lower().split()


def streams(each: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts each after DEPTH marks, where each text begins, and the windows' places."""
    parts = [END * DEPTH + b" ".join(w) + END for w in each]
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    predicted = np.ones(len(data), bool)
    predicted[(starts[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return data, starts, np.flatnonzero(predicted)


def windows(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """DEPTH bytes and the one after them as one number, the oldest byte highest."""
    wide = data.astype(np.int64)
    out = np.zeros(len(places), np.int64)
    for k in range(DEPTH, -1, -1):
        out = out << 8 | wide[places - k]
    return out


class Table:
    """Numbers to floats by open addressing, with lookups of whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == -1
            _, one = np.unique(s[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[s[put]], self.values[s[put]] = keys[todo[put]], values[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo = todo[left]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the values of these (0 of others)."""
        slot = self._slot(keys)
        have = self.keys[slot]
        found = have == keys
        value = np.where(found, self.values[slot], np.float32(0))
        todo = np.flatnonzero(~found & (have != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            have = self.keys[slot[todo]]
            hit = todo[have == keys[todo]]
            found[hit], value[hit] = True, self.values[slot[hit]]
            todo = todo[(have != keys[todo]) & (have != -1)]
        return found, value


def _mask(n: int) -> int:
    return (1 << (8 * n)) - 1


class Tree:
    """The nodes' next bytes and back-off weights, in log10."""

    def __init__(self, nexts: list[tuple[np.ndarray, np.ndarray]], nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """By depth: (context and next byte, count) and (context, count, kinds of next bytes)."""
        zero = np.zeros(256)
        zero[nexts[0][0]] = nexts[0][1]
        total = max(zero.sum(), 1)
        self.zero = np.log10((zero + 1) / (total + 256)).astype(np.float32)
        # Divergence tests, shallow to deep (below SHARD all stay, as no task knows all that is above); then the suffixes of what stays.
        stay: list[np.ndarray] = [np.zeros(1, np.int64)]
        for d in range(1, DEPTH + 1):
            ctx, count, _ = nodes[d]
            key, n = nexts[d]
            if not len(ctx):
                stay.append(ctx)
                continue
            shorter_key, shorter_n = nexts[d - 1]
            _, shorter_count, _ = nodes[d - 1]
            shorter_ctx = nodes[d - 1][0]
            own = count[np.searchsorted(ctx, key >> 8)]
            at = np.searchsorted(shorter_key, key & _mask(d)) if len(shorter_key) else np.zeros(len(key), np.int64)
            q = shorter_n[np.minimum(at, len(shorter_key) - 1)] / shorter_count[np.searchsorted(shorter_ctx, (key >> 8) & _mask(d - 1))]
            gain = n * np.log(n / own / q)
            information = np.bincount(np.searchsorted(ctx, key >> 8), gain, len(ctx))
            stay.append(ctx[information >= DIVERGENCE] if d >= SHARD else ctx)
        for d in range(DEPTH, 1, -1):
            stay[d - 1] = np.union1d(stay[d - 1], stay[d] & _mask(d - 1))
        keys, values = [], []
        parent_key, parent_log = np.sort(nexts[0][0]), self.zero[np.sort(nexts[0][0])].astype(np.float64)
        parent_ctx, parent_back = np.zeros(1, np.int64), np.zeros(1)
        chain = [(parent_key, parent_log, parent_ctx, parent_back)]
        for d in range(1, DEPTH + 1):
            ctx, count, kinds = nodes[d]
            sel = np.isin(ctx, stay[d], assume_unique=True)
            ctx, count, kinds = ctx[sel], count[sel], kinds[sel]
            key, n = nexts[d]
            sel = np.isin(key >> 8, ctx)
            key, n = key[sel], n[sel]
            mass = MASS * kinds
            at = np.searchsorted(ctx, key >> 8)
            parent = self._log(chain, key & _mask(d), d - 1)
            log = np.log10((n + mass[at] * 10**parent) / (count[at] + mass[at]))
            # What the named next bytes leave is shared out as the parent shares it among the others.
            named = np.bincount(at, 10**log, len(ctx))
            others = np.bincount(at, 10**parent, len(ctx))
            back = np.log10(np.maximum(1 - named, 1e-9) / np.maximum(1 - others, 1e-9))
            chain.append((key, log, ctx, back))
            keys += [key | d << 56, ctx | (16 + d) << 56]
            values += [log, back]
        self.table = Table(np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(values) if values else np.zeros(0))
        self.size = [len(c[2]) for c in chain], [len(c[0]) for c in chain]

    def _log(self, chain, key: np.ndarray, d: int) -> np.ndarray:
        """log10 of the last byte of each key after the d bytes before it, from the levels made so far."""
        out, todo = np.zeros(len(key)), np.arange(len(key))
        for k in range(d, 0, -1):
            own, log, ctx, back = chain[k]
            q = key[todo] & _mask(k + 1)
            if len(own):
                at = np.minimum(np.searchsorted(own, q), len(own) - 1)
                hit = own[at] == q
                out[todo[hit]] += log[at[hit]]
                todo, q = todo[~hit], q[~hit]
            if len(ctx):
                at = np.minimum(np.searchsorted(ctx, q >> 8), len(ctx) - 1)
                hit = ctx[at] == q >> 8
                out[todo[hit]] += back[at[hit]]
        out[todo] += self.zero[key[todo] & 255]
        return out

    def logs(self, window: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window, by the longest suffix that is a node."""
        out = np.zeros(len(window), np.float32)
        todo, w = np.arange(len(window)), window
        for d in range(DEPTH, 0, -1):
            found, value = self.table.get((w & _mask(d + 1)) | d << 56)
            out[todo] += value
            rest = ~found
            todo, w = todo[rest], w[rest]
            if not len(todo):
                return out
            out[todo] += self.table.get(((w >> 8) & _mask(d)) | (16 + d) << 56)[1]
        out[todo] += self.zero[w & 255]
        return out

    def scores(self, each: list[list[bytes]]) -> np.ndarray:
        data, starts, places = streams(each)
        logs = self.logs(windows(data, places)).astype(np.float64)
        first = starts[:-1] - DEPTH * np.arange(len(each))
        return np.add.reduceat(logs, first) if len(each) else np.zeros(0)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def training():
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS) != 0


_COUNTS = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
#: Rows of one batch handed on.
ROWS = 100_000


def _batches(columns: list[list], schema: pa.Schema):
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS], t) for c, t in zip(columns, schema.types)], schema=schema)


@task("suffix_tree")
def _count(batches):
    """Of a task's texts: windows and words with their counts in training texts, so 0 for windows of others alone. The END word counts the texts."""
    seen, found, held = Counter(), [], 0

    def hand_words():
        columns = [[None] * len(seen), list(seen), list(seen.values())]
        yield from _batches(columns, _COUNTS)
        seen.clear()

    def hand_windows():
        keys, n = merged(found)
        found.clear()
        for i in range(0, len(keys), ROWS):
            part = slice(i, i + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.nulls(len(keys[part]), pa.binary()), pa.array(n[part])], schema=_COUNTS)

    for batch in batches:
        texts, trains = [t or "" for t in batch.column("text").to_pylist()], batch.column("train").to_pylist()
        for a, b in chunks(texts, CHUNK):
            both: tuple[list, list] = ([], [])
            for t, train in zip(texts[a:b], trains[a:b]):
                both[train].append(words(t))
            for w in both[1]:
                seen.update(w)
            if both[1]:
                seen[END] += len(both[1])
            for train, each in enumerate(both):
                if each:
                    data, _, places = streams(each)
                    keys, n = np.unique(windows(data, places), return_counts=True)
                    found.append((keys, n * train))
                    held += len(keys)
            if held > MOST_WINDOWS:
                found[:] = [merged(found)]
                held = len(found[0][0])
                if held > MOST_WINDOWS // 2:
                    yield from hand_windows()
                    held = 0
            if len(seen) > MOST_WORDS:
                yield from hand_words()
    if found:
        yield from hand_windows()
    if seen:
        yield from hand_words()


_LOGS = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("log", pa.float32())])


def levels(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """By depth the (context and next byte, count) and the (context, count, kinds) of contexts that occur LEAST times."""
    nexts, nodes = [], []
    for d, (key, n) in enumerate(parts):
        ctx, at = np.unique(key >> 8, return_inverse=True)
        count, kinds = np.bincount(at, n, len(ctx)).astype(np.int64), np.bincount(at, minlength=len(ctx))
        often = (count >= LEAST) | (d == 0)
        nexts.append((key[often[at]], n[often[at]]))
        nodes.append((ctx[often], count[often], kinds[often]))
    return nexts, nodes


def _learned(shipped):
    @task("suffix_tree")
    def run(batches):
        """Of all windows with the same SHARD bytes before the predicted one: their log10 probabilities."""
        parts = [(b.column("gram").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not sum(len(k) for k, _ in parts):
            return
        grams, n = merged(parts)
        seen = n > 0
        own = [merged([(grams[seen] & _mask(d + 1), n[seen])]) for d in range(SHARD, DEPTH + 1)]
        logs = Tree(*levels(shipped.value + own)).logs(grams)
        for i in range(0, len(grams), ROWS):
            part = slice(i, i + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(grams[part]), pa.array(n[part]), pa.array(logs[part])], schema=_LOGS)

    return run


class Lookup:
    """What scoring needs on every worker: the log probabilities of the frequent windows, and the terms of the frequent words."""

    def __init__(self, head: Table, tokens: int, distinct: int, frequent: dict[bytes, int]):
        self.head = head
        self.scale = tokens + 0.1 * (distinct + 1)
        self.terms = {w: math.log10((c + 0.1) / self.scale) for w, c in frequent.items() if w != END}
        self.end = math.log10((frequent.get(END, 0) + 0.1) / self.scale)
        self.end_known = int(END in frequent)


_ROWS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("word", pa.binary()), ("n", pa.int32()), ("of", pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]))])
_ROWS_SQL = "doc_id long, tie long, word binary, n int, of struct<n_tokens:long,n_known:long,base:double,score:double>"


def _keys(grams: np.ndarray) -> pa.Array:
    """END and the six bytes of each window: a key that no word has."""
    wide = np.empty((len(grams), DEPTH + 2), np.uint8)
    wide[:, 0] = END[0]
    for k in range(DEPTH + 1):
        wide[:, 1 + k] = grams >> (8 * (DEPTH - k)) & 255
    ends = np.arange(len(grams) + 1, dtype=np.int32) * (DEPTH + 2)
    return pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(ends), pa.py_buffer(wide)])


def _score(shipped):
    @task("suffix_tree")
    def run(batches):
        look = shipped.value
        terms = look.terms
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts, CHUNK):
                each = [words(t) for t in texts[a:b]]
                data, starts, places = streams(each)
                window = windows(data, places)
                found, logs = look.head.get(window)
                scores = np.add.reduceat(logs.astype(np.float64), starts[:-1] - DEPTH * np.arange(len(each)))
                rest, of = window[~found], np.repeat(np.arange(a, b), np.diff(starts) - DEPTH)[~found]
                out: list[list] = [[], [], [], [], []]
                add = [c.append for c in out]
                ties = [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in texts[a:b]]
                for doc, tie, w, s in zip(ids[a:b], ties, each, scores):
                    base, known = look.end, look.end_known
                    for word, n in Counter(w).items():
                        term = terms.get(word)
                        if term is None:
                            add[0](doc), add[1](tie), add[2](word), add[3](n), add[4](None)
                        else:
                            base += n * term
                            known += n
                    # The row of the text itself: its key holds a space, which no word has, so it joins nothing and is spread evenly.
                    add[0](doc), add[1](tie), add[2](b" %d %d" % (doc or 0, tie)), add[3](0)
                    add[4]({"n_tokens": len(w) + 1, "n_known": known, "base": base, "score": float(s)})
                yield from _batches(out, _ROWS)
                docs, tied = batch.column("doc_id"), pa.array(ties, pa.int64())
                for i in range(0, len(rest), ROWS):
                    at = of[i : i + ROWS]
                    one = pa.array(np.ones(len(at), np.int32))
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(at)), tied.take(pa.array(at - a)), _keys(rest[i : i + ROWS]), one, pa.nulls(len(at), _ROWS.field("of").type)], schema=_ROWS)

    return run


def learn(docs: DataFrame) -> tuple[Lookup, DataFrame, int]:
    """The lookup, the table (word, c, log) of word counts and of the other windows, and the number of training tokens."""
    spark = docs.sparkSession
    bound_batches(spark, 4)
    counted = docs.select("text", training().alias("train")).mapInArrow(_count, "gram long, word binary, n long")
    counts = stage(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")), "lm-counts")
    by_word = counts.filter("word is not null").select("word", F.col("n").alias("c"), F.lit(None).cast("float").alias("log"))
    tokens, distinct = by_word.agg(F.sum("c"), F.count("*")).first()
    tokens = tokens or 0
    frequent = by_word.filter((F.col("c") >= P_WORD * tokens) | (F.col("word") == F.lit(END))).toArrow()
    frequent = dict(zip(frequent["word"].to_pylist(), frequent["c"].to_pylist()))
    grams = counts.filter("gram is not null").select("gram", "n")
    short = grams.filter("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(_mask(SHARD))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = short["key"].to_numpy(), short["n"].to_numpy()
    shallow = spark.sparkContext.broadcast([merged([(key & _mask(d + 1), n)]) for d in range(SHARD)])  # at most 256^SHARD
    dealt = grams.repartition(F.shiftright("gram", 8).bitwiseAND(F.lit(_mask(SHARD))))
    logs = stage(dealt.mapInArrow(_learned(shallow), "gram long, n long, log float"), "lm-logs")
    often = F.col("n") >= max(1, P_HEAD * int(n.sum()))
    head = logs.filter(often).select("gram", "log").toArrow()
    rest = logs.filter(~often).select(F.concat(F.lit(END), F.unhex(F.lpad(F.hex("gram"), 2 * DEPTH + 2, "0"))).alias("word"), F.lit(None).cast("long").alias("c"), "log")
    return Lookup(Table(head["gram"].to_numpy(), head["log"].to_numpy()), tokens, distinct, frequent), by_word.unionByName(rest), tokens


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    look, by_key, tokens = learn(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(look)  # bounded by the shares above
    rows = docs.mapInArrow(_score(shipped), _ROWS_SQL)
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(look.scale)) * F.col("n")
    rows = rows.join(by_key, "word", "left")
    one = (
        rows.groupBy("doc_id", "tie").agg(
            F.sum(F.when(F.col("of").isNotNull(), 1)).alias("copies"),
            F.sum("of.n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("of.n_known", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).cast("long").alias("n_known"),
            F.sum(F.when(F.col("log").isNull(), F.coalesce("of.base", term))).alias("base_score"),
            F.sum(F.coalesce("of.score", F.col("n") * F.col("log").cast("double"))).alias("score"),
        )
    )
    # Rows that repeat an id and a text came together: each gets its share.
    return one.select(
        "doc_id", (~training()).alias("held_out"),
        *[F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_known")],
        F.lit(tokens).cast("long").alias("train_tokens"),
        *[(F.col(c) / F.col("copies")).alias(c) for c in ("base_score", "score")],
        F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy"),
    ).drop("copy")


def op8_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
